"""Token counts: an exact histogram of encoded lengths, and what its suffix sums answer.

Documents are aggregated by encoded length first, map-side, so that what is
shuffled is one row for each partition and distinct length, however many documents there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def length_histogram(encoded: DataFrame, n_tokens: str | Column = "n_tokens") -> DataFrame:
    """(n_tokens, n_docs): documents of each encoded length. Null lengths count as 0."""
    n = F.col(n_tokens) if isinstance(n_tokens, str) else n_tokens
    return encoded.select(F.coalesce(n, F.lit(0)).cast("long").alias("n_tokens")).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame, blocks: int = 1024) -> DataFrame:
    """What every distinct length L answers as a context limit, one row for each L.

    n_docs: documents of just L tokens; docs_up_to and docs_over: those of at
    most and of more than L; truncated_total: tokens that are left when each
    document is cut to L tokens; lost: those that go; rank_share: share of documents up to L, for
    quantiles. For a limit between two lengths, the row of the greatest length
    below it gives docs_over and truncated_total + (limit - L) * docs_over.

    Sums run in two levels, within blocks of lengths and over the blocks'
    totals (at most ``blocks`` + 1 rows), so no task sees the whole histogram. Empty input gives no rows.
    """
    block = F.least(F.floor(F.log2(F.col("n_tokens") + 1) * F.lit(blocks // 40)), F.lit(blocks)).cast("int")
    rows = hist.withColumn("block", block).withColumn("tokens", F.col("n_docs") * F.col("n_tokens"))
    sums = rows.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    past = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # few rows: one for each block
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select(
        "block",
        F.coalesce(F.sum("b_docs").over(past), F.lit(0)).alias("later_docs"),
        F.sum("b_docs").over(every).alias("all_docs"),
        F.sum("b_tokens").over(every).alias("all_tokens"),
        F.coalesce(F.sum("b_tokens").over(past), F.lit(0)).alias("later_tokens"),
    )
    over = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("over_docs", F.coalesce(F.sum("n_docs").over(over), F.lit(0)))
        .withColumn("over_tokens", F.coalesce(F.sum("tokens").over(over), F.lit(0)))
        .join(F.broadcast(sums), "block")
    )
    docs_over, tokens_over = F.col("over_docs") + F.col("later_docs"), F.col("over_tokens") + F.col("later_tokens")
    lost = tokens_over - docs_over * F.col("n_tokens")
    return rows.select(
        "n_tokens",
        "n_docs",
        (F.col("all_docs") - docs_over).alias("docs_up_to"),
        docs_over.alias("docs_over"),
        (F.col("all_tokens") - lost).alias("truncated_total"),
        lost.alias("lost"),
        ((F.col("all_docs") - docs_over) / F.col("all_docs")).alias("rank_share"),
    )


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """(n_tokens): the least length that at least the share ``q`` of documents doesn't exceed; null when there are none."""
    return sums.where(F.col("rank_share") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """(total): tokens that are left when every document is cut to ``limit``; 0 when there are none."""
    row = F.max_by(F.struct("n_tokens", "docs_over", "truncated_total"), "n_tokens")
    below = sums.where(F.col("n_tokens") <= limit).agg(row.alias("r"), F.max("docs_over").alias("d"))
    docs = sums.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"))
    some = F.col("r.truncated_total") + (F.lit(limit) - F.col("r.n_tokens")) * F.col("r.docs_over")
    return below.crossJoin(docs).select(F.coalesce(some, F.col("docs") * limit).cast("long").alias("total"))  # one row by one row
