"""BM25 in 32-bit floats: every quotient and logarithm, double in Spark, is cast back at once."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

K1, B = 1.2, 0.75


def f32(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def idf(n_docs: Column, df: Column) -> Column:
    """ln(1 + (N - df + 0.5) / (df + 0.5)); never negative, finite for df = 0."""
    ratio = f32((f32(n_docs) - f32(df) + f32(0.5)) / (f32(df) + f32(0.5)))
    return f32(F.log((f32(1.0) + ratio).cast("double")))


def norm(length: Column, avg: Column) -> Column:
    return f32(K1) * (f32(1 - B) + f32(f32(B) * f32(length) / f32(avg)))


def contribution(idf_: Column, tf: Column, length: Column, avg: Column) -> Column:
    t = f32(tf)
    return f32(idf_ * t * f32(K1 + 1.0) / (t + norm(length, avg)))


def ordered_sum(parts: Column) -> Column:
    """Float sum of array<struct<ord, c>> in the order of ord, from 0: neither partitions nor arrival change a bit."""
    return F.aggregate(F.array_sort(parts), f32(0.0), lambda acc, x: acc + x["c"])
