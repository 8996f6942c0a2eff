"""Search over contiguous shards of documents, with corpus-wide statistics; results equal the unsharded ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.operators.index import TextIndex
from quarry.operators.search import scores


#: Ids of a range by which shards are found.
RANGE = 65_536


def shard_of(doc_id: Column, size: int) -> Column:
    return F.floor(doc_id / size).cast("int")


def docs_per_shard(docs: DataFrame, size: int) -> DataFrame:
    return docs.groupBy(shard_of(F.col("doc_id"), size).alias("shard")).agg(F.count("*").alias("docs"))


def bases(per_shard: DataFrame) -> DataFrame:
    """(shard, docs, base): the first global id of each shard. A row for each shard, so one task suffices."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return per_shard.select("shard", "docs", F.coalesce(F.sum("docs").over(before), F.lit(0)).cast("long").alias("base"))


def locate(ids: DataFrame, shard_bases: DataFrame) -> DataFrame:
    """(doc_id, shard, local_id): the last shard whose base isn't above the id; empty shards are passed over, ids beyond the last document have no row.

    Shards and ids meet by ranges of RANGE ids, so neither many shards nor large ones are held by a task.
    """
    full = shard_bases.where("docs > 0").select("shard", "base", (F.col("base") + F.col("docs")).alias("stop"))
    spans = full.select("*", F.explode(F.sequence(F.floor(F.col("base") / RANGE), F.floor((F.col("stop") - 1) / RANGE))).alias("range"))
    met = ids.select("doc_id", F.floor(F.col("doc_id") / RANGE).alias("range")).join(spans, "range")
    return met.where("doc_id >= base AND doc_id < stop").select("doc_id", "shard", (F.col("doc_id") - F.col("base")).alias("local_id"))


def per_shard_topk(index: TextIndex, queries: DataFrame, k: int, size: int) -> DataFrame:
    """(qid, shard, rank, doc_id, score): each shard's k best by global weights."""
    found = scores(index, queries).withColumn("shard", shard_of(F.col("doc_id"), size))
    best = Window.partitionBy("qid", "shard").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("qid", "shard", "rank", "doc_id", "score")


def merge_topk(per_shard: DataFrame, k: int) -> DataFrame:
    """(qid, rank, doc_id, score): the best of all shards."""
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return per_shard.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("qid", "rank", "doc_id", "score")


def merged_df(docs_postings: DataFrame, size: int) -> DataFrame:
    """(term, df) summed from the shards' own counts."""
    part = docs_postings.groupBy("term", shard_of(F.col("doc_id"), size).alias("shard")).agg(F.count("*").alias("df"))
    return part.groupBy("term").agg(F.sum("df").cast("long").alias("df"))
