"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm import bpe, chat, embed, linededup, minhash, packing, quality, sql, tokencount, toxicity, winnow
from quarry.llm.common import fold_of, table

RANKS = "byte_bpe_multi_50k.tiktoken"
WORDS = "word_bpe_49k.json"
CONTEXT = 2048


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by byte-level BPE and back: counts and digests. Null texts are empty; every row keeps a row."""
    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip_digest(bpe.bpe_encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decode=True))


def _scored(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text by the rule ensemble. Null and empty texts have a score too; every row keeps a row."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return _scored(quality.score_quality(docs, model), 0.3)


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness. Null texts are empty; rows without an id have an empty next text."""
    rows = winnow.compare_edited(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), winnow.as_text(F.col("fingerprint")).alias("fingerprint"),
        winnow.as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the passages that stood before, and how many code points went. Null texts stay null; every row stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs, removed_col="removed_chars").select("doc_id", "text", "removed_chars")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back. Null texts and roles are empty; repeated turns stay."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.format_chat(turns.unionByName(own)), in_order=True)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every text stands in sequences of CONTEXT tokens. Null and empty texts are one token; every row is packed."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS), CONTEXT)


def op7_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies of all texts. Texts without words are linked with nothing; every row keeps a row."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, totals and truncated totals for every encoded length. Null and empty texts have length 0."""
    docs = table(spark, sf_dir, "documents")
    encoded = bpe.bpe_encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return tokencount.suffix_sums(tokencount.length_histogram(bpe.token_counts(encoded)))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near vectors of equal label. Unusable vectors are linked with nothing; every row keeps a row."""
    return embed.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text by the lexicon. Null and empty texts have the least score; every row keeps a row."""
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.fit_lexicon(docs, table(spark, sf_dir, "labels"))
    return _scored(toxicity.score_toxicity(docs, lexicon), 0.5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_byte_bpe, op2_quality_rules, op3_winnowing, op4_line_dedup, op5_chat_format, op6_best_fit_packing, op7_setsketch_near_dedup, op8_token_counts, op9_embedding_near_dedup, op10_toxicity_lexicon)}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": sql.LINE_DEDUP, "op5_chat_format": sql.CHAT, "op7_setsketch_near_dedup": sql.NEAR_DEDUP, "op9_embedding_near_dedup": sql.NEAR_VECTORS}
