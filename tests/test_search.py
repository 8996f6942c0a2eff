"""Ranking, boolean search, shards and explanations on small corpora with known results."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import search, shards
from quarry.operators.index import TextIndex
from quarry.plans import explain, strategy
from quarry.sources.corpus import from_rows

SAMPLE = [("a", "machine learning with rust"), ("b", "machine shop"), ("c", "deep learning, machine learning!"), ("d", "rust learning")]


def build(spark, texts, parts=None):
    docs = from_rows(spark, [(f"d{i}", t) if isinstance(t, str) else t for i, t in enumerate(texts)])
    return TextIndex.build(docs.repartition(parts) if parts else docs, name_col="name")


def ranked(index, query, k=10):
    return [(r["doc_id"], round(float(r["score"]), 6)) for r in search.search_ranked(index, query, k).collect()]


@pytest.fixture(scope="module")
def sample(spark):
    return build(spark, SAMPLE)


def test_statistics(sample):
    got = sample.corpus.first()
    assert (got["n_docs"], got["n_terms"], got["n_postings"], got["total_len"]) == (4, 6, 11, 12)
    assert sorted((r["doc_id"], r["tf"]) for r in sample.lookup("learning").collect()) == [(0, 1), (2, 2), (3, 1)]


@pytest.mark.parametrize("query, expected", [
    ("machine learning", [0, 2]), ("rust learning machine", [0]), ("machine", [0, 1, 2]), ("  Machine, LEARNING!\n", [0, 2]), ("learning learning", [0, 2, 3]),
    ("machine zebra", []), ("", []), ("!!!", []),
])
def test_boolean_by_every_plan(sample, query, expected):
    plans = [search.boolean, search.boolean_chain, search.boolean_intersect, *(lambda i, q, a=a: search.boolean_chain(i, q, a) for a in ("Merge", "Gallop", "Adaptive"))]
    for plan in plans:
        assert [r["doc_id"] for r in plan(sample, query).collect()] == expected


def test_a_list_too_long_to_be_broadcast(spark):
    a, b = (spark.createDataFrame([(x,) for x in ids], "doc_id long") for ids in ([1, 5, 9], range(0, 10, 3)))
    for algorithm in ("Merge", "Gallop", None):
        assert [r["doc_id"] for r in search.intersect(a, b, 3, algorithm, most=0).orderBy("doc_id").collect()] == [9]


@pytest.mark.parametrize("few, probes", [(0, 10**6), (0, -1), (10_000, -1)])
def test_matches_however_many_there_are(spark, sample, monkeypatch, few, probes):
    """Queries too many for the driver, and ids too many to be broadcast, give the same."""
    asked = spark.createDataFrame([(0, "machine learning"), (1, "rust"), (2, "zebra rust"), (3, "learning rust machine"), (4, "")], "qid long, query string")
    whole = sorted(map(tuple, search.search_batch(sample, asked, 10).collect()))
    monkeypatch.setattr(search, "FEW_WORDS", few)
    monkeypatch.setattr(search, "PROBES", probes)
    assert sorted(map(tuple, search.search_batch(sample, asked, 10).collect())) == whole and len(whole) == 5


@pytest.mark.parametrize("query, expected", [
    ("machine learning", [(2, 0.762265), (0, 0.627748)]), ("rust learning machine", [(0, 1.237718)]), ("machine", [(1, 0.412992), (0, 0.313874), (2, 0.313874)]),
    ("learning learning", [(2, 0.448391), (3, 0.412992), (0, 0.313874)]), ("rust RUST rust", [(3, 0.802591), (0, 0.609969)]), ("machine zebra", []), ("", []),
])
def test_ranked(sample, query, expected):
    got = ranked(sample, query)
    assert [d for d, _ in got] == [d for d, _ in expected]
    assert [s for _, s in got] == pytest.approx([s for _, s in expected], abs=1e-6)


def test_hand_computed_score(spark):
    assert ranked(build(spark, ["rust", "go go"]), "rust") == [(0, pytest.approx(math.log(2) * 2.2 / 1.9, abs=1e-6))]


@pytest.mark.parametrize("texts, query, expected", [
    (["rust go go", "rust rust go"], "rust", [1, 0]), (["rust a b c d e", "rust a"], "rust", [1, 0]), (["machine machine rust", "machine rust rust", "machine"], "machine rust", [1, 0]),
])
def test_order(spark, texts, query, expected):
    assert [d for d, _ in ranked(build(spark, texts), query)] == expected


def test_k_matched_and_ties(spark):
    index = build(spark, ["rust", "rust", "rust rust", "rust"])
    one = search.one_query(spark, "rust")
    assert [d for d, _ in ranked(index, "rust", 2)] == [2, 0]
    assert ranked(index, "rust", 0) == []
    assert search.matched(index, one).first()["matched"] == 4
    assert search.matched(index, search.one_query(spark, "zebra")).first()["matched"] == 0


def test_shards_use_corpus_statistics(spark):
    index = build(spark, ["a a b"] + ["b"] * 10 + ["x", "a b b"] + ["a"] * 10)
    asked = search.one_query(spark, "a b")
    rows = shards.merge_topk(shards.per_shard_topk(index, asked, 10, 12), 10).orderBy("rank").collect()
    assert [r["doc_id"] for r in rows] == [0, 12]
    assert rows[0]["score"] == rows[1]["score"] == pytest.approx(1.022606, abs=1e-6)


def test_results_do_not_depend_on_partitions(spark):
    rng = random.Random(42)
    texts = [" ".join(f"w{int(rng.random() ** 2 * 60)}" for _ in range(rng.randrange(1, 31))) for _ in range(300)]
    asked = spark.createDataFrame([(i, " ".join(f"w{int(rng.random() ** 2 * 60)}" for _ in range(rng.randrange(1, 4)))) for i in range(40)], "qid long, query string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = rows(search.search_batch(build(spark, texts, 1), asked, 10))
    assert whole
    for parts, size in ((3, 1), (7, 50), (2, 1000)):
        index = build(spark, texts, parts)
        assert rows(search.search_batch(index, asked, 10)) == whole
        assert rows(shards.merge_topk(shards.per_shard_topk(index, asked, 10, size), 10)) == whole


def test_scores_equal_a_float32_evaluation(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    index, f = build(spark, texts), np.float32
    lens = [len(t.split()) for t in texts]
    avg, n = f(sum(lens) / len(lens)), f(len(texts))
    words = sorted("abc", key=lambda w: (sum(w in t.split() for t in texts), w))
    expected = {}
    for d, t in enumerate(texts):
        parts = t.split()
        if all(w in parts for w in words):
            total = f(0)
            for w in words:
                df, tf = f(sum(w in x.split() for x in texts)), f(parts.count(w))
                idf = f(np.log(np.float64(f(1) + (n - df + f(0.5)) / (df + f(0.5)))))
                total = total + idf * tf * (f(1.2) + f(1)) / (tf + f(1.2) * (f(0.25) + f(0.75) * f(lens[d]) / avg))
            expected[d] = float(total)
    got = {r["doc_id"]: float(r["score"]) for r in search.scores(index, search.one_query(spark, "a b c")).collect()}
    assert got == expected


def test_locate_passes_over_empty_shards(spark):
    sizes = spark.createDataFrame([(0, 0), (1, 4), (2, 0), (3, 5), (4, 1)], "shard int, docs long")
    got = shards.locate(spark.range(10).select(F.col("id").alias("doc_id")), shards.bases(sizes)).orderBy("doc_id").collect()
    assert [(r["shard"], r["local_id"]) for r in got] == [(1, i) for i in range(4)] + [(3, i) for i in range(5)] + [(4, 0)]


def test_explain(spark, sample):
    one = search.one_query(spark, "machine learning rust")
    assert [r["term"] for r in explain.terms(sample, one).orderBy("ord").collect()] == ["rust", "learning", "machine"]
    steps = explain.steps(sample, one).orderBy("step").collect()
    assert [(r["candidates"], r["df"], r["algorithm"], r["matched"]) for r in steps] == [(2, 3, "Merge", 2), (2, 3, "Merge", 1)]
    none = search.one_query(spark, "machine zebra learning")
    first = explain.terms(sample, none).orderBy("ord").first()
    assert (first["term"], first["df"]) == ("zebra", 0) and not explain.steps(sample, none).collect()
    assert "in no document" in explain.text(sample, "machine zebra learning", 10)
    assert "no words" in explain.text(sample, "?", 10)
    plan = explain.plan(sample, "machine learning", 1)
    assert plan.matched == 2 and [d for d, _ in plan.hits] == [2] and "kept in a heap" in "\n".join(plan.lines())


def test_explain_picks_gallop(spark):
    index = build(spark, ["common rare"] + ["common"] * 40)
    assert explain.steps(index, search.one_query(spark, "common rare")).first()["algorithm"] == "Gallop"


def test_strategy_and_work(spark):
    rows = spark.createDataFrame([(10, 159), (10, 160), (0, 7)], "a long, b long").select(strategy.algorithm(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r["x"] for r in rows] == ["Merge", "Gallop", "Gallop"]
    cases = {(1000,): 1000, (50, 30000): 690, (500, 30000): 6500, (20000, 50000): 30000, (50, 20000): 690, (50, 20000, 50000): 818, (): 0}
    rows = spark.createDataFrame([(list(k),) for k in cases], "d array<int>").select(strategy.estimated_work(F.col("d"), F.lit(100000.0)).alias("w")).collect()
    assert [r["w"] for r in rows] == pytest.approx(list(cases.values()))


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    import io

    from quarry import __main__ as cli

    (tmp_path / "c.tsv").write_text("".join(f"d{i}\trust {'go ' * i}\n" for i in range(13)))
    path = str(tmp_path / "c.tsv")
    assert cli.main([path, "rust"]) == 0
    whole = capsys.readouterr().out.splitlines()
    assert len(whole) == 11 and whole[0].endswith("d0") and whole[-1] == "... and 3 more"
    cli.main([path, "--shards", "3", "rust"])
    assert capsys.readouterr().out.splitlines() == whole
    cli.main([path, "explain", "zebra"])
    assert "in no document" in (said := capsys.readouterr().out) and said.endswith("No results.\n")
    monkeypatch.setattr("sys.stdin", io.StringIO("\n:explain go rust\nzebra\n"))
    cli.main([path])
    assert "Words, rarest first" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main([path, "--shards", "0", "x"])
