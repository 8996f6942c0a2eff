import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import queries, winnow
from quarry.llm.common import pick


def fingerprints(spark, docs_of, texts, **kw):
    rows = winnow.winnow(pick(docs_of(list(enumerate(texts))), "doc_id", "text"), "text", "fp", **kw).orderBy("doc_id").collect()
    return [[(x["hash"], x["pos"]) for x in r["fp"]] for r in rows]


def brute(spark, units, k, w):
    """Positions by definition, on Spark's own hashes of the units."""
    if not units:
        return []
    h = [r["h"] for r in spark.createDataFrame([(i, u) for i, u in enumerate(units)], "i int, u string").orderBy("i").select(F.xxhash64("u").alias("h")).collect()]
    turn = lambda x, by: ((x << by % 64) | (x >> (64 - by % 64))) % (1 << 64) if by % 64 else x
    h, g = [x % (1 << 64) for x in h], []
    for i in range(max(1, len(h) - k + 1)):
        rolled = 0
        for j in range(k):
            rolled = turn(rolled, 1) ^ (h[i + j] if i + j < len(h) else 0)
        g.append(rolled >> 31)
    chosen = []
    for a in range(max(1, len(g) - w + 1)):
        span = range(a, min(a + w, len(g)))
        best = min(span, key=lambda i: (g[i], -i))
        if not chosen or chosen[-1] != best:
            chosen.append(best)
    return [(g[i], i) for i in chosen]


@pytest.mark.parametrize("k, w", [(5, 4), (3, 5), (2, 1), (4, 7), (1, 2), (7, 3)])
def test_against_the_definition(spark, docs_of, k, w):
    rng = random.Random(k)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 1, 2, 5, 6, 9, 30, 80)]
    got = fingerprints(spark, docs_of, texts, k=k, w=w)
    for t, fp in zip(texts, got):
        assert fp == brute(spark, t.split(), k, w)


def test_shared_runs_share_grams(spark, docs_of):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    run = " ".join(word() for _ in range(winnow.K + winnow.W - 1))
    texts = [" ".join(word() for _ in range(20)) + " " + run + " " + " ".join(word() for _ in range(20)) for _ in range(6)]
    sets = [{h for h, _ in fp} for fp in fingerprints(spark, docs_of, texts)]
    assert all(sets[0] & s for s in sets[1:])


def test_edges(spark, docs_of):
    texts = [None, "", "  \n", "中文字没有空格" * 3, "!!!???", "Ab c", "ab  C", "x" * 4000, "w " * 30_000]
    fp = fingerprints(spark, docs_of, texts)
    assert fp[0] == fp[1] == fp[2] == [] and fp[5] == fp[6] and all(fp[i] for i in (3, 4, 5, 7, 8))
    a, b, none = (F.array(*[F.lit(x) for x in v]).cast("array<bigint>") for v in ((1, 2, 3), (2, 3, 4), ()))
    r = spark.range(1).select(winnow.likeness(a, b).alias("ab"), winnow.likeness(none, none).alias("nn"), winnow.likeness(a, none).alias("an")).first()
    assert (r["ab"], r["nn"], r["an"]) == (0.5, 1.0, 0.0)


@pytest.mark.parametrize("bucket", [1, 3, 500])
def test_next_document(spark, docs_of, monkeypatch, bucket):
    monkeypatch.setattr(winnow, "BUCKET", bucket)
    rng = random.Random(bucket)
    rows = [(i, f"t{i}") for i in rng.sample(range(-1000, 1000), 60)] + [(5000, None)]
    got = {r["doc_id"]: r["next_text"] for r in winnow.with_next(docs_of(rows, 5)).collect()}
    order = sorted(rows)
    assert got == {order[i][0]: order[(i + 1) % len(order)][1] or "" for i in range(len(order))}
    assert [r["next_text"] for r in winnow.with_next(docs_of([(3, "only")])).collect()] == ["only"]
    assert winnow.with_next(docs_of([])).collect() == []
    odd = sorted((r["doc_id"] or 0, r["text"], r["next_text"]) for r in winnow.with_next(docs_of([(None, "n"), (1, "b"), (1, "a"), (2, "c")])).collect())
    assert odd == [(0, "n", ""), (1, "a", "b"), (1, "b", "c"), (2, "c", "a")]


@pytest.mark.parametrize("most", [65_536, 2_500])
def test_next_document_in_thousands_of_buckets(spark, docs_of, monkeypatch, most):
    monkeypatch.setattr(winnow, "BUCKET", 1)
    monkeypatch.setattr(winnow, "MOST_BUCKETS", most)
    rng = random.Random(most)
    rows = [(i, f"t{i}") for i in rng.sample(range(-(10**12), 10**12), 3000)]
    got = {r["doc_id"]: r["next_text"] for r in winnow.with_next(docs_of(rows, 5)).collect()}
    order = sorted(rows)
    assert got == {order[i][0]: order[(i + 1) % len(order)][1] for i in range(len(order))}


def test_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in queries.op3_winnowing(spark, small).collect()}
    for d, after in zip(docs, [*docs[1:], docs[0]]):
        t, n = d["text"], len(d["text"])
        edited = t[: n - n // 4] + (after["text"][: n // 4] if n // 4 else "")
        assert got[d["doc_id"]]["n_chars"] == n and got[d["doc_id"]]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = ({x.split(":")[0] for x in got[i][f].split()} for i, f in ((d["doc_id"], "fingerprint"), (d["doc_id"], "edited_fingerprint"), (after["doc_id"], "fingerprint")))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert (got[d["doc_id"]]["near_edited"], got[d["doc_id"]]["near_next"]) == (like(a, b), like(a, c))
    near = [r["near_edited"] > r["near_next"] for r in got.values()]
    assert sum(near) / len(near) > 0.95


def test_other_columns_keep_their_names(spark):
    df = spark.createDataFrame([("a b c d e f", 1, 2, 3)], "text string, h1 int, m int, `c.0` int")
    out = winnow.winnow(df, "text", "fp")
    assert out.columns == ["text", "h1", "m", "c.0", "fp"] and out.first()[1:4] == (1, 2, 3)
