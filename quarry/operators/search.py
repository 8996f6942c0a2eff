"""Conjunctive search and BM25 ranking, for one query or a table of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quarry.functions.bm25 import contribution, idf, ordered_sum
from quarry.functions.text import query_terms
from quarry.operators.index import TextIndex
from quarry.plans.strategy import choose

#: Weighed words that may be brought to the driver, words that go into the scan's filter, ids looked for that may be broadcast.
FEW_WORDS, PUSHED, PROBES = 10_000, 10, 500_000


def one_query(spark: SparkSession, query: str) -> DataFrame:
    return spark.range(1).select(F.lit(0).cast("long").alias("qid"), F.lit(query).alias("query"))


def words_of(spark: SparkSession, query: str) -> list[str]:
    """Distinct words of one query, on the driver: bounded by the query's own length."""
    return one_query(spark, query).select(query_terms("query").alias("t")).first()["t"]


def weigh(index: TextIndex, queries: DataFrame) -> DataFrame:
    """(qid, term, df, idf, ord, n_terms): distinct words, rarest first and then by term, from 1; unknown words have df 0."""
    terms = queries.select("qid", F.explode(query_terms("query")).alias("term"))
    per = Window.partitionBy("qid")
    known = terms.join(index.terms, "term", "left").select("qid", "term", F.coalesce("df", F.lit(0)).cast("long").alias("df"))
    n = F.broadcast(index.sizes.select("n_docs"))  # one row
    weighed = known.crossJoin(n).select("qid", "term", "df", idf(F.col("n_docs"), F.col("df")).alias("idf"))
    return weighed.withColumn("ord", F.row_number().over(per.orderBy("df", "term"))).withColumn("n_terms", F.count("*").over(per))


def settled(weighed: DataFrame) -> tuple[DataFrame, int, list[str] | None]:
    """(weighed words of the queries whose words are all known, ids to be looked for in further lists, the words themselves where few).

    Up to FEW_WORDS rows are brought to the driver, so that later steps don't weigh them again and the optimizer knows how small they are; more stay where they are.
    """
    live = weighed.withColumn("least", F.min("df").over(Window.partitionBy("qid"))).where("least > 0").drop("least")
    got = live.limit(FEW_WORDS + 1).collect()
    if len(got) <= FEW_WORDS:
        words = sorted({r["term"] for r in got})
        return live.sparkSession.createDataFrame(got, live.schema), sum(r["df"] * (r["n_terms"] - 1) for r in got if r["ord"] == 1), words if len(words) <= PUSHED else None
    return live, live.where("ord = 1").agg(F.sum(F.col("df") * (F.col("n_terms") - 1))).first()[0], None


def matches(index: TextIndex, weighed: DataFrame) -> DataFrame:
    """(qid, doc_id, len, parts): documents with every word of a query; parts are (ord, idf, tf).

    A query with an unknown word drops out before the postings are touched. Candidates come from each query's rarest word
    alone; the other words' lists are only probed for them, by a broadcast where PROBES ids
    or fewer are looked for in all, so that a common word's list is neither shuffled nor grouped; else by a join on (term, doc_id), which splits a hot word.
    """
    live, entries, words = settled(weighed)
    posts = index.postings.where(F.col("term").isin(words)) if words else index.postings
    part = F.struct("ord", "idf", "tf").alias("part")
    first = posts.join(live.where("ord = 1").select("qid", "term", "idf", "ord", "n_terms"), "term").select("qid", "doc_id", "len", "n_terms", part)
    rest = live.where("ord > 1").select("qid", "term", "idf", "ord")
    probes = first.where("n_terms > 1").select("qid", "doc_id").join(rest, "qid")
    if entries <= PROBES:
        probes = F.broadcast(probes)
    met = posts.join(probes, ["term", "doc_id"]).select("qid", "doc_id", "len", F.lit(None).cast("bigint").alias("n_terms"), part)
    both = first.unionByName(met.withColumn("n_terms", F.col("n_terms").cast(first.schema["n_terms"].dataType)))
    found = both.groupBy("qid", "doc_id").agg(F.collect_list("part").alias("parts"), F.max("n_terms").alias("n_terms"), F.first("len").alias("len"))
    return found.where(F.size("parts") == F.col("n_terms")).select("qid", "doc_id", "len", "parts")


def score(index: TextIndex, found: DataFrame) -> DataFrame:
    """(qid, doc_id, score): float sums in the order of the weighed words."""
    avg = F.broadcast(index.sizes.select("avg_len"))  # one row
    rows = found.crossJoin(avg)
    parts = F.transform("parts", lambda p: F.struct(p["ord"].alias("ord"), contribution(p["idf"], p["tf"], F.col("len"), F.col("avg_len")).alias("c")))
    return rows.select("qid", "doc_id", ordered_sum(parts).alias("score"))


def scores(index: TextIndex, queries: DataFrame) -> DataFrame:
    return score(index, matches(index, weigh(index, queries)))


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """(qid, rank, doc_id, score): the k best of each query, ties by lower id; k = 0 gives none."""
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("qid", "rank", "doc_id", "score")


def search_ranked(index: TextIndex, query: str, k: int) -> DataFrame:
    """(doc_id, score) of one query, best first: a bounded heap in each task, then one merge."""
    spark = index.postings.sparkSession
    found = scores(index, one_query(spark, query)).select("doc_id", "score")
    return found.orderBy(F.desc("score"), "doc_id").limit(k)


def search_batch(index: TextIndex, queries: DataFrame, k: int) -> DataFrame:
    """(qid, rank, doc_id, score) of every query of a table (qid, query) in one job."""
    return top_k(scores(index, queries), k)


def matched(index: TextIndex, queries: DataFrame) -> DataFrame:
    """(qid, matched) of every query, those without a match too."""
    n = matches(index, weigh(index, queries)).groupBy("qid").agg(F.count("*").alias("matched"))
    return queries.select("qid").join(n, "qid", "left").select("qid", F.coalesce("matched", F.lit(0)).cast("long").alias("matched"))


def boolean(index: TextIndex, query: str) -> DataFrame:
    """(doc_id) ascending: documents with every word; a query without words has none. Grouped, with a count."""
    words = words_of(index.postings.sparkSession, query)
    rows = index.postings.where(F.col("term").isin(words) if words else F.lit(False))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") == len(words)).select("doc_id").orderBy("doc_id")


def _lists(index: TextIndex, query: str) -> list[tuple[DataFrame, int]]:
    """Document lists of the words and their counts, rarest first; the few counts are looked up on the driver."""
    spark = index.postings.sparkSession
    words = words_of(spark, query)
    df = {r["term"]: r["df"] for r in index.terms.where(F.col("term").isin(words) if words else F.lit(False)).collect()}
    return [(index.lookup(w).select("doc_id"), df.get(w, 0)) for w in sorted(words, key=lambda w: (df.get(w, 0), w))]


def _nothing(index: TextIndex) -> DataFrame:
    return index.postings.select("doc_id").where(F.lit(False))


def intersect(small: DataFrame, large: DataFrame, entries: int, algorithm: str | None, most: int = 1_000_000) -> DataFrame:
    """Ids in both lists, ``entries`` being those of ``small``. "Merge" sorts and merges; "Gallop" probes the small list, broadcast if it has at
    most ``most`` ids, by the large one; None leaves it to the optimizer. Which one never changes the result."""
    if algorithm == "Gallop":
        return large.join(F.broadcast(small) if entries <= most else small, "doc_id", "left_semi")
    return small.join(large.hint("merge") if algorithm == "Merge" else large, "doc_id", "left_semi")


def boolean_chain(index: TextIndex, query: str, algorithm: str | None = None) -> DataFrame:
    """The same by intersecting lists, rarest word first. "Merge" or "Gallop" fixes the algorithm, "Adaptive" chooses for each step by
    the candidates counted and the list's length, None leaves it to the optimizer. Without candidates no further list is read."""
    lists = _lists(index, query)
    if not lists or not lists[0][1]:
        return _nothing(index)
    (found, entries), rest = lists[0], lists[1:]
    for k, (longer, df) in enumerate(rest):
        if k and algorithm in ("Gallop", "Adaptive"):
            entries = found.count()
            if not entries:
                return _nothing(index)
        found = intersect(found, longer, entries, choose(entries, df) if algorithm == "Adaptive" else algorithm)
    return found.orderBy("doc_id")


def boolean_intersect(index: TextIndex, query: str) -> DataFrame:
    """The same by INTERSECT."""
    lists = [ids for ids, _ in _lists(index, query)]
    return reduce(lambda a, b: a.intersect(b), lists).orderBy("doc_id") if lists else _nothing(index)
