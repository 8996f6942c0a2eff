"""Physical choices as columns: intersection algorithm, work estimate, fan-out."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

GALLOP_RATIO = 16
BLOCK = 64
DECODE_VS_SCORE = 5.0
PARALLEL_MIN_WORK = 1500.0


def algorithm(a: Column, b: Column) -> Column:
    """Gallop where the longer side has 16 times the shorter one's entries or more, else Merge."""
    return F.when(F.greatest(a, b) >= F.least(a, b) * GALLOP_RATIO, F.lit("Gallop")).otherwise(F.lit("Merge"))


def choose(a: int, b: int) -> str:
    """The same of two numbers."""
    return "Gallop" if max(a, b) >= GALLOP_RATIO * min(a, b) else "Merge"


def estimated_work(dfs: Column, n: Column) -> Column:
    """Entries decoded and scored, from an array of document counts sorted upwards, taking words as independent; 0 for none."""
    start = F.struct(F.element_at(dfs, 1).cast("double").alias("c"), F.element_at(dfs, 1).cast("double").alias("w"))

    def step(acc: Column, df: Column) -> Column:
        w = acc["w"] + F.least(df.cast("double"), acc["c"] * BLOCK) / F.lit(DECODE_VS_SCORE)
        return F.struct((acc["c"] * df / n).alias("c"), w.alias("w"))

    total = F.aggregate(F.slice(dfs, F.lit(2), F.greatest(F.size(dfs) - 1, F.lit(0))), start, step, lambda acc: acc["w"])
    return F.when(F.size(dfs) == 0, F.lit(0.0)).otherwise(total)


def fan_out(work: Column, shards: int) -> Column:
    return F.when((F.lit(shards) > 1) & (work >= PARALLEL_MIN_WORK), F.lit("Parallel")).otherwise(F.lit("Sequential"))
