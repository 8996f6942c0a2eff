"""Connected components of large graphs, by alternating star contractions in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import forget, written


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): the least node that it reaches.

    Null ends and loops are left out; repeated edges are harmless; no edges give
    no rows. Each round links larger neighbours to the least one, then
    smaller ones, until nothing changes: a logarithmic number of rounds. Each
    round's edges are written, only their count and checksum reach the driver.
    """
    now = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, mark = written(now, "edges"), None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if (state["n"], state["s"]) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        mark = (state["n"], state["s"])
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = _least(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        before, now = now, written(small.where(F.col("u") != F.col("v")).distinct(), "edges")
        forget(before)
