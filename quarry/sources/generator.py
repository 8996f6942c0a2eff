"""A seeded corpus whose words follow Zipf's law; the same rows on any number of partitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SEED = 42


def uniform(*keys: Column, seed: int = SEED) -> Column:
    """A double in [0, 1) of 53 bits, from a hash of the keys."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / float(1 << 53)


def zipf_cdf(spark: SparkSession, words: int) -> DataFrame:
    """(id, cdf): share of draws at or below each rank, the chance of rank i being in proportion to 1 / (i + 1).

    Sums run within blocks of 1,024 ranks and over the blocks' totals.
    """
    from pyspark.sql import Window

    ids = spark.range(words).withColumn("p", 1.0 / (F.col("id") + 1)).withColumn("block", F.floor(F.col("id") / 1024))
    every = Window.orderBy("block")
    sums = ids.groupBy("block").agg(F.sum("p").alias("b")).select("block", (F.sum("b").over(every) - F.col("b")).alias("base"))
    total = ids.agg(F.sum("p").alias("total"))
    own = Window.partitionBy("block").orderBy("id")
    return ids.withColumn("run", F.sum("p").over(own)).join(F.broadcast(sums), "block").crossJoin(F.broadcast(total)).select("id", ((F.col("base") + F.col("run")) / F.col("total")).alias("cdf"))


def vocabulary(lines: list[str] | None = None, words: int = 50_000) -> list[str]:
    """``words`` words: those of a word list, lower-cased, of 3 to 12 ASCII letters and unlike the one before, then ``term0``, ``term1`` and so on."""
    kept: list[str] = []
    for w in (x.strip().lower() for x in lines or []):
        if 3 <= len(w) <= 12 and w.isascii() and w.isalpha() and (not kept or kept[-1] != w):
            kept.append(w)
    return (kept + [f"term{i}" for i in range(max(0, words - len(kept)))])[:words]


def generate(spark: SparkSession, docs: int, words: int = 50_000, shortest: int = 60, longest: int = 199, seed: int = SEED, partitions: int | None = None, word_list: list[str] | None = None) -> DataFrame:
    """(doc_id, name, text): ``docs`` documents of shortest to longest words.

    A word is the first whose share of draws, summed up to it as in ``zipf_cdf``, reaches a uniform number. The
    sums and words, which ``words`` bounds, go to every executor.
    """
    shares = np.cumsum(1.0 / np.arange(1, words + 1))
    known = spark.sparkContext.broadcast((shares / shares[-1], np.array(vocabulary(word_list, words), object)))

    @F.pandas_udf("string")
    def text(u: pd.Series) -> pd.Series:
        cdf, names = known.value
        return pd.Series([" ".join(names[np.minimum(np.searchsorted(cdf, x, "left"), len(names) - 1)]) for x in u])

    ids = spark.range(0, docs, 1, partitions) if partitions else spark.range(docs)
    n = shortest + F.floor(uniform(F.col("id"), F.lit(-1), seed=seed) * (longest - shortest + 1)).cast("int")
    draws = F.transform(F.sequence(F.lit(1), n), lambda p: uniform(F.col("id"), p, seed=seed))
    return ids.select(F.col("id").alias("doc_id"), F.format_string("doc%07d.txt", F.col("id")).alias("name"), text(draws).alias("text"))


def write_tsv(docs: DataFrame, path: str) -> None:
    """Lines ``name<TAB>text``."""
    docs.select(F.concat_ws("\t", "name", "text").alias("value")).write.mode("overwrite").text(path)
