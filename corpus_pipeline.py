"""The corpus pipeline: stages that filter, clean, deduplicate and pack ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``. ``run`` writes each stage's rows as Parquet and rereads them for the next.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm import linededup, minhash, packing, quality, toxicity
from quarry.llm.common import forget, table, written

#: Scores from which a document is rejected as toxic, and below which as poor.
TOXIC, GOOD = 0.5, 0.3
TOKENIZER, CONTEXT = "word_bpe_49k.json", 2048
#: Words whose ids a worker keeps: fewer than when packing alone, as executors hold what earlier stages left too.
CACHED_WORDS = 250_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC; null and empty texts have no hits and stay, repeated rows are treated alike."""
    return toxicity.keep_clean(docs, toxicity.fit_lexicon(docs, table(spark, sf_dir, "labels")), TOXIC)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is GOOD or more; null texts are scored as empty ones, repeated rows are treated alike."""
    return quality.keep_good(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")), GOOD)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str, emptied: bool = True) -> DataFrame:
    """All documents, without passages that an earlier one has; n_chars follows the text.

    Without ``emptied`` those go of which nothing is left, such as whole copies; texts that came empty or null stay.
    """
    names = docs.columns
    text = f"c{names.index('text')}"
    plain = linededup.dedup_lines(docs, removed_col="removed").toDF(*[f"c{i}" for i in range(len(names))], "removed")
    left = plain if emptied else plain.where((F.col("removed") == 0) | F.col(text).rlike(r"\S"))
    out = left.drop("removed").toDF(*names)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in names else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, likeness 0.8 or more), that of least id.

    Rows without an id, or without words, stay; of rows that repeat id and text one stays.
    """
    found = minhash.near_duplicates(docs, words=5, percent=80)
    gone = found.groupBy("doc_id").agg(F.max("kept").alias("kept")).where(~F.col("kept")).select("doc_id")
    names = docs.columns
    own, text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.join(gone.withColumnRenamed("doc_id", own), own, "left_anti").dropDuplicates([own, text]).toDF(*names)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in sequences of CONTEXT tokens; null and empty texts are one token, every row is packed."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), CONTEXT, cached_words=CACHED_WORDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_poor),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("best-fit packing", pack_sequences),
]
#: SQL can't express learned classifiers and sketches; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; whole copies, which the line dedup empties, are left out after it. No documents give no rows."""
    made = docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir, emptied=False) if stage is drop_repeated_lines else stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            before, docs = docs, written(made, name.replace(" ", "-"))
            forget(before)
    return made
