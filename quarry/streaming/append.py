"""Indexing a stream of documents: each micro-batch adds Parquet files of postings and document statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.index import TextIndex, corpus_stats, counted, doc_sizes, listed, term_stats


def index_stream(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that indexes (doc_id, text) as they arrive, and stops when what is there has been read.

    A batch's files go to a folder of its number, which is overwritten, so one
    that runs again after a failure leaves no second copy.
    """

    def add(batch: DataFrame, number: int) -> None:
        rows = counted(batch).persist()
        listed(rows).write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        rows.select("doc_id", "name", "len").write.mode("overwrite").parquet(f"{path}/docs/batch={number}")
        rows.unpersist()

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_stream_index(spark, path: str) -> TextIndex:
    """The index of all batches so far."""
    posts = spark.read.parquet(f"{path}/postings").drop("batch")
    docs = spark.read.parquet(f"{path}/docs").drop("batch")
    terms, sizes = term_stats(posts), doc_sizes(docs)
    return TextIndex(posts, docs, terms, sizes, corpus_stats(sizes, terms))
