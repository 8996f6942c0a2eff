import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from quarry.llm import bpe, queries, tokencount

PATH = P.path(queries.RANKS)
ALPHABET = "ab 's'T\t\n\r\x0b\x0c\x1c\x1d\x85\xa0 　éÄß中文字ー0９½😀!?-_.,​<|endoftext|>"


@pytest.fixture(scope="module")
def enc():
    return bpe.ByteBPE.parse(bpe.read_ranks(PATH), P.PATTERN)


@pytest.fixture(scope="module")
def reference(enc):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})


def test_random_texts(enc, reference):
    rng = random.Random(1)
    for _ in range(400):
        t = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(150)))
        assert enc.encode([t])[0].tolist() == reference.encode_ordinary(t)


@pytest.mark.parametrize("text", ["a" * 3000, "中文" * 900, " " * 2000, "!?" * 900, "abcdefghij" * 300, "", "x", "aaaa aaaaa " * 300])
def test_long_pieces(enc, reference, text):
    ids = enc.encode([text])[0]
    assert ids.tolist() == reference.encode_ordinary(text)
    assert enc.decode(ids) == text.encode()


def test_forest_and_tree_agree(enc):
    rng = random.Random(2)
    pieces = [bytes(rng.randrange(256) for _ in range(rng.randrange(2, 65))) for _ in range(200)]
    for p in pieces:
        assert enc._forest([p], 64)[0] == enc._tree(p)


def test_streamed_text(enc, reference, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_CHARS", 50)
    monkeypatch.setattr(bpe, "BATCH_PIECES", 7)
    monkeypatch.setattr(bpe, "CACHED_PIECES", 5)
    t = "some words that go on, and on. " * 20
    assert [i.tolist() for i in enc.encode([t, "short", t])] == [reference.encode_ordinary(x) for x in (t, "short", t)]


def test_query_equals_the_library(spark, small, reference):
    docs = spark.read.parquet(f"{small}/documents.parquet").toPandas()
    got = queries.op1_byte_bpe(spark, small).toPandas().set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text):
        ids = reference.encode_ordinary(t)
        assert got.loc[i].tolist() == [len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()]


def test_edges(spark, docs_of):
    rows = [(1, None), (1, None), (None, "abc"), (2, ""), (3, "x" * 5000)]
    got = bpe.round_trip_digest(bpe.bpe_encode(docs_of(rows), PATH, P.PATTERN, decode=True)).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r["doc_id"] or 0, r["n_tokens"] > 0, r["ids_sha256"] == empty) for r in got) == [(0, True, False), (1, False, True), (1, False, True), (2, False, True), (3, True, False)]
    assert bpe.bpe_encode(docs_of([]), PATH, P.PATTERN).collect() == []
    encoded = bpe.bpe_encode(docs_of([(5, "Grüße, 中文!"), (6, None)]), PATH, P.PATTERN)
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in bpe.bpe_decode(encoded, PATH).collect()} == {5: "Grüße, 中文!", 6: ""}


def test_token_counts(spark, docs_of):
    rng = random.Random(4)
    lengths = [rng.choice([0, 0, 3, 5, 17, 1000, 1001]) for _ in range(200)] + [123_456]
    df = spark.createDataFrame([(n,) for n in lengths] + [(None,)], "n_tokens long")
    lengths.append(0)
    sums = tokencount.suffix_sums(tokencount.length_histogram(df)).cache()
    for r in sums.collect():
        limit = r["n_tokens"]
        assert r["n_docs"] == lengths.count(limit)
        assert r["docs_over"] == sum(n > limit for n in lengths) and r["docs_up_to"] == sum(n <= limit for n in lengths)
        assert r["truncated_total"] == sum(min(n, limit) for n in lengths) and r["lost"] == sum(lengths) - r["truncated_total"]
    for limit in (0, 1, 4, 500, 1001, 10**6):
        assert tokencount.truncated_total(sums, limit).first()["total"] == sum(min(n, limit) for n in lengths)
    for q in (0.01, 0.5, 0.9, 1.0):
        assert tokencount.quantile(sums, q).first()["n_tokens"] == min(n for n in lengths if sum(m <= n for m in lengths) >= q * len(lengths))
    none = tokencount.suffix_sums(tokencount.length_histogram(df.limit(0)))
    assert none.collect() == [] and tokencount.truncated_total(none, 9).first()["total"] == 0


def test_token_count_query(spark, small, reference):
    docs = spark.read.parquet(f"{small}/documents.parquet").toPandas()
    lengths = [len(reference.encode_ordinary(t)) for t in docs.text]
    got = {r["n_tokens"]: (r["n_docs"], r["truncated_total"]) for r in queries.op8_token_counts(spark, small).collect()}
    assert got == {n: (lengths.count(n), sum(min(n, m) for m in lengths)) for n in set(lengths)}
