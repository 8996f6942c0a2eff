"""Command line: ``python -m quarry PATH [--shards N] [explain] [WORD ...]``; without words it reads queries from standard input."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.operators import search, shards
from quarry.operators.index import TextIndex
from quarry.plans import explain
from quarry.sources.corpus import load
from quarry.storage import fresh_path

TOP = 10


def answer(index: TextIndex, query: str, n_shards: int = 1) -> list[str]:
    """The best TOP documents as lines of text. Sharded and plain search give the same."""
    spark = index.postings.sparkSession
    one = search.one_query(spark, query)
    matched = search.matched(index, one).first()["matched"]
    if not matched:
        return ["No results."]
    if n_shards > 1:
        n = index.sizes.first()["n_docs"]
        best = shards.merge_topk(shards.per_shard_topk(index, one, TOP, max(1, -(-n // n_shards))), TOP)
    else:
        best = search.search_batch(index, one, TOP)
    return [*_lines(best.join(index.docs.select("doc_id", "name"), "doc_id")), *([f"... and {matched - TOP:,} more"] if matched > TOP else [])]


def _lines(best: DataFrame) -> list[str]:
    rows = best.orderBy("rank").select(F.format_string("score %7.3f  %s", F.col("score").cast("double"), "name").alias("line"))
    return [r["line"] for r in rows.collect()]  # TOP rows


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quarry", description=__doc__)
    parser.add_argument("path", help="a .tsv file, a .parquet table, or a directory of .txt files, such as documents/")
    parser.add_argument("--shards", type=int, default=1, help="contiguous parts that are searched apart and merged")
    parser.add_argument("words", nargs="*", help="a query; 'explain' before it shows what the query does")
    args = parser.parse_intermixed_args(argv)
    if args.shards < 1:
        parser.error("--shards must be 1 or more")
    spark = SparkSession.builder.appName("quarry").getOrCreate()
    index = TextIndex.create(load(spark, args.path), fresh_path(spark, "index"), name_col="name")

    def say(query: str, explained: bool) -> None:
        if explained:
            print(explain.text(index, query, TOP))
        print("\n".join(answer(index, query, args.shards)), flush=True)

    if args.words:
        explained = args.words[0] == "explain"
        say(" ".join(args.words[explained:]), explained)
        return 0
    for line in map(str.strip, sys.stdin):
        if line:
            say(line.removeprefix(":explain").strip(), line.startswith(":explain"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
