"""Bounded samples of labelled documents that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import fold_of, pick


def sample(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, label, text) of at most ``most[v]`` training documents of each label value v.

    Only rows outside the held-out fold count; those of least hash of the id
    are taken, so the choice doesn't depend on partitions. Of repeated labels
    the largest counts, of repeated documents the least text; null labels, ids and texts
    that have no partner are left out. The sample's ids (bounded by ``most``) are broadcast.
    """
    docs, labels = pick(docs, id_col, text_col), pick(labels, id_col, label)
    known = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id")) != 0))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    taken = None
    for value, n in most.items():
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        taken = part if taken is None else taken.unionByName(part)
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return text.join(F.broadcast(taken), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
