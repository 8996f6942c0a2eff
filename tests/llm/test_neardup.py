import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import embed, graph, minhash, queries


def brute(docs, k, percent):
    sets = []
    for _, t in docs:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)), key=lambda x: docs[x][0])
                root[b] = a
    return {docs[i][0]: (len(sets[i]), docs[find(i)][0], docs[find(i)][0] == docs[i][0]) for i in range(len(docs))}


def near(docs, *a):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, *a).collect()}


def corpus(seed, n, vocabulary=40):
    """Chains of edits, exact copies and documents that share much but not enough."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    texts = [[word() for _ in range(rng.randrange(1, 60))] for _ in range(n // 3)]
    while len(texts) < n:
        t = list(rng.choice(texts))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
            t[rng.randrange(len(t))] = word()
        texts.append(t)
    ids = rng.sample(range(10_000), n)
    return [(i, " ".join(t)) for i, t in zip(ids, texts)]


@pytest.mark.parametrize("k, percent, block", [(4, 80, 512), (5, 80, 4)])
def test_against_brute_force(docs_of, monkeypatch, k, percent, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 30 * block)
    rows = corpus(k, 240)
    assert near(docs_of(rows), k, percent) == brute(rows, k, percent)


def test_large_group_of_near_copies(docs_of):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(250):
        t = list(base)
        for _ in range(3):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    assert near(docs_of(rows), 4, 80) == brute(rows, 4, 80)


def test_large_group_alike_but_not_enough(docs_of, monkeypatch):
    """Each of a group shares most of a text with each other one, just too little for a link, but for a few pairs."""
    monkeypatch.setattr(minhash, "BLOCK", 64)
    rng, rows = random.Random(4), []
    base = [f"b{i}" for i in range(160)]
    for i in range(200):
        rows.append((i, " ".join([*base, *[f"x{rng.randrange(10**6)}" for _ in range(25)]])))
    rows += [(1000 + i, t.rsplit(" ", 2)[0]) for i, t in rows[:40]]
    got = near(docs_of(rows), 4, 80)
    assert got == brute(rows, 4, 80) and sum(not k for _, _, k in got.values()) == 40


def test_edges(docs_of):
    rows = [(9, None), (8, ""), (7, " \t\n"), (6, "one two"), (5, "ONE Two"), (4, "one  two"), (3, "É two three four five"), (2, "é two three four five"), (1, "word " * 30_000), (0, "word word word word word")]
    assert near(docs_of(rows), 5, 80) == brute(rows, 5, 80)
    assert minhash.near_duplicates(docs_of([])).collect() == []
    got = minhash.near_duplicates(docs_of([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "other")])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, False), (0, 1, False), (1, 1, True), (1, 1, True)]


def test_query_on_the_driver_table(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in queries.op7_setsketch_near_dedup(spark, small).collect()}
    assert got == brute(docs, 4, 80)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = np.unique(x[:2000]), np.unique(x[600:])
    sa, sb = minhash.sketch(a), minhash.sketch(b)
    assert (minhash.merge(sa, sb) == minhash.sketch(np.union1d(a, b))).all()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(minhash.estimate(sa, sb, len(a), len(b)) - true) < 0.15
    assert minhash.likely(sa[None], sa[None], np.array([len(a)]), np.array([len(a)]), 0.8)[0]
    assert not minhash.likely(sa[None], sb[None], np.array([len(a)]), np.array([len(b)]), 0.8)[0]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(900, 900), (None, 3)]
    root = list(range(1000))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    nodes = {x for e in edges if None not in e and e[0] != e[1] for x in e}
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in nodes}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, c, 1, b"v") for i, v, c in rows], "vec_id long, embedding array<float>, label int, mult int, vec binary").repartition(3)


def _brute_vectors(rows, threshold=0.93):
    def ok(v):
        return v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)

    links = collections.defaultdict(set)
    for i, v, c in rows:
        for j, w, d in rows:
            if i != j and c == d and c is not None and ok(v) and ok(w) and len(v) == len(w):
                x, y = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links[i].add(j)
    out = {}
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


@pytest.mark.parametrize("cell, block", [(4096, 1024), (20, 1024), (20, 8)])
def test_vectors_against_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embed, "PER_CELL", cell)
    monkeypatch.setattr(embed, "BLOCK", block)
    rng = np.random.default_rng(cell + block)
    rows = []
    for c in range(2):
        centres = rng.normal(size=(12, 8))
        for i in range(100):
            v = centres[rng.integers(12)] + rng.normal(size=8) * rng.choice([0, 0.1, 0.3, 2])
            rows.append((1000 * c + i, [float(np.float32(x)) for x in v], c))
    rows += [(5000, None, 0), (5001, [], 0), (5002, [0.0] * 8, 1), (5003, [1.0, None] * 4, 1), (5004, [float("nan")] * 8, 1), (5005, [float("inf")] * 8, 1), (5006, rows[0][1], None), (5007, [1.0, 2.0], 0), (5008, [2.0, 4.0], 0)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed.near_vectors(_vectors(spark, rows)).collect()}
    assert got == _brute_vectors(rows)


def test_cells_grow_with_the_data():
    assert [embed.cells_for(n) for n in (0, 1, 2, 59, 5_000)] == [1, 1, 2, 2, 3]
    for n in (10**6, 10**8, 10**10):
        assert embed.cells_for(4 * n) > 1.9 * embed.cells_for(n) and embed.cells_for(n) ** 2 <= n


def test_many_pairs_are_folded(spark):
    """A large group of near-equal vectors: all pairs are linked, and no more than a strip of them is held."""
    rng = np.random.default_rng(0)
    x = np.ones(16) + rng.normal(size=(3000, 16)) * 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links, root = embed.block_links(x, np.ones(3000, np.int64), np.ones(3000, bool), np.zeros(3000, np.int64), False, 0.93)
    assert (links == 2999).all() and (root == 0).all()


def test_groups_over_batches():
    import pyarrow as pa

    rows = [("a", 1), ("a", 1), ("a", 2), ("b", 2), ("b", 2), ("b", 2), ("c", 2)]
    for step in (1, 2, 3, 7):
        parts = [pa.RecordBatch.from_pylist([{"k": k, "n": n, "i": i} for i, (k, n) in enumerate(rows)][a : a + step]) for a in range(0, 7, step)]
        assert [t.column("i").to_pylist() for t in embed.groups(iter(parts), ["k", "n"])] == [[0, 1], [2], [3, 4, 5], [6]]


def test_vector_edges(spark):
    assert embed.near_vectors(_vectors(spark, [])).collect() == []
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (None, [1.0, 0.0], 0)]
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in embed.near_vectors(_vectors(spark, rows)).collect())
    assert got == [(0, 0, 0), (1, 2, 1), (1, 2, 1), (2, 2, 1)]


def test_vector_query(spark, small):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in queries.op9_embedding_near_dedup(spark, small).collect()}
    assert got == _brute_vectors(rows)
