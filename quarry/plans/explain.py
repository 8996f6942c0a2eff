"""What a query does: its words in order, each AND step with its input, algorithm and survivors, and a text of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, Window, functions as F

from quarry.operators.index import TextIndex
from quarry.operators.search import matches, one_query, FEW_WORDS, search_ranked, weigh
from quarry.plans.strategy import algorithm


def terms(index: TextIndex, queries: DataFrame) -> DataFrame:
    """(qid, ord, term, df, idf), rarest first."""
    return weigh(index, queries).select("qid", "ord", "term", "df", "idf")


def steps(index: TextIndex, queries: DataFrame) -> DataFrame:
    """(qid, step, term, candidates, df, algorithm, matched) of the AND steps that run.

    One pass for all steps: a document survives step i if it has the first i + 1 words, that is, if
    its words are numbered without a gap up to there. Steps after the candidates have run out are absent.
    """
    weighed = weigh(index, queries)
    met = index.postings.join(F.broadcast(weighed.select("qid", "term", "ord")) if weighed.limit(FEW_WORDS + 1).count() <= FEW_WORDS else weighed.select("qid", "term", "ord"), "term")
    ords = met.groupBy("qid", "doc_id").agg(F.array_sort(F.collect_list("ord")).alias("o"))
    prefix = ords.select("qid", F.size(F.filter("o", lambda x, i: x == i + 1)).alias("depth")).where("depth > 0")
    counts = prefix.groupBy("qid", "depth").agg(F.count("*").alias("n"))
    deeper = weighed.join(counts, "qid", "left").groupBy("qid", "ord", "term", "df").agg(F.coalesce(F.sum(F.when(F.col("depth") >= F.col("ord"), F.col("n"))), F.lit(0)).alias("survivors"))
    per = Window.partitionBy("qid").orderBy("ord")
    rows = deeper.withColumn("candidates", F.lag("survivors").over(per)).where("ord > 1 AND candidates > 0")
    return rows.select("qid", (F.col("ord") - 1).alias("step"), "term", F.col("candidates").cast("long").alias("candidates"), "df", algorithm(F.col("candidates"), F.col("df")).alias("algorithm"), F.col("survivors").cast("long").alias("matched"))


@dataclass(frozen=True)
class Plan:
    """What a query did: its words and steps as rows, the number of matches, and the best as (document, score)."""

    query: str
    k: int
    words: list[Row]
    steps: list[Row]
    matched: int
    hits: list[tuple[int, float]]

    def lines(self) -> list[str]:
        """The plan as text; timings, which aren't reproducible, are left out."""
        out = [f"Query: {self.query!r}, best {self.k}"]
        if not self.words:
            return [*out, "The query has no words."]
        out.append("Words, rarest first:")
        out += [f"  {w['ord']}. {w['term']}: " + (f"in {w['df']:,} documents, idf {w['idf']:.3f}" if w["df"] else "in no document") for w in self.words]
        for s in self.steps:
            out.append(f"Step {s['step']}: {s['candidates']:,} candidates AND {s['term']} ({s['df']:,}) by {s['algorithm']}: {s['matched']:,} left")
        if len(self.steps) < len(self.words) - 1:
            out.append("No candidates were left for the other words; their lists aren't read.")
        out.append(f"Scored {self.matched:,} documents; " + ("all of them are sorted." if self.k >= self.matched else f"the best {self.k} are kept in a heap."))
        return [*out, *(f"  {i}. document {d}, score {s:.3f}" for i, (d, s) in enumerate(self.hits, 1))]


def plan(index: TextIndex, query: str, k: int) -> Plan:
    """Run a query and say what it did; the hits are those of the search. A few rows a word and k hits reach the driver."""
    one = one_query(index.postings.sparkSession, query)
    words, ran = terms(index, one).orderBy("ord").collect(), steps(index, one).orderBy("step").collect()
    hits = search_ranked(index, query, k).collect() if words else []
    return Plan(query, k, words, ran, matches(index, weigh(index, one)).count() if words else 0, [(r["doc_id"], float(r["score"])) for r in hits])


def text(index: TextIndex, query: str, k: int) -> str:
    return "\n".join(plan(index, query, k).lines())
