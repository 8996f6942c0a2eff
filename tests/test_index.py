"""Tokenizer, codec, sources, persistence, generator and streaming."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.functions.text import human_bytes, tokens, varint_length
from quarry.operators import codec, search
from quarry.operators.index import TextIndex, postings
from quarry.sources import corpus, generator
from quarry.streaming.append import index_stream, load_stream_index


@pytest.mark.parametrize("text, words", [
    ("İstanbul", ["i̇stanbul"]), ("ΟΔΥΣΣΕΥΣ.ΑΒ", ["οδυσσευς", "αβ"]), ("हिन्दी", ["हिन", "दी"]), ("don't x_y 3.14", ["don", "t", "x", "y", "3", "14"]),
    ("½ Ⅳ", ["½", "ⅳ"]), ("", []), ("?! -", []), (None, []), ("End", ["end"]),
])
def test_tokens(spark, text, words):
    assert spark.createDataFrame([(text,)], "t string").select(tokens("t").alias("w")).first()["w"] == words


def test_varint_and_bytes(spark):
    values = [0, 1, 127, 128, 16383, 16384, 2097151, 2097152, 4294967295]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select(varint_length(F.col("v")).alias("n"), human_bytes(F.col("v")).alias("h")).collect()
    assert [r["n"] for r in rows] == [1, 1, 1, 2, 2, 3, 3, 4, 5]
    assert [r["h"] for r in rows] == ["0 B", "1 B", "127 B", "128 B", "16.0 KB", "16.0 KB", "2.0 MB", "2.0 MB", "4.0 GB"]


@pytest.mark.parametrize("n", [1, 63, 64, 65, 1000])
def test_codec_round_trip(spark, n):
    posts = spark.range(n).select(F.lit("w").alias("term"), (F.col("id") * 3 + F.col("id") % 2).alias("doc_id"), (F.col("id") % 5 + 1).cast("int").alias("tf"))
    gaps = codec.gaps(posts)
    assert sorted(map(tuple, codec.decode(gaps).collect())) == sorted(map(tuple, posts.collect()))
    assert codec.skip_table(gaps).count() == -(-n // 64)
    assert codec.used_bytes(gaps).first()["bytes"] == 2 * n + 8 * -(-n // 64)


def test_used_bytes_of_the_driver_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert codec.used_bytes(codec.gaps(postings(docs))).first()["bytes"] == 1_096_352


def test_tsv(spark, tmp_path):
    (tmp_path / "c.tsv").write_bytes(b"d0\tb one\r\nnotab\nd1\tx\ty\rz\n\tempty title\nd3\t")
    got = [tuple(r) for r in corpus.load(spark, str(tmp_path / "c.tsv")).orderBy("doc_id").collect()]
    assert got == [(0, "d0", "b one"), (1, "d1", "x\ty\rz"), (2, "", "empty title"), (3, "d3", "")]


def test_tsv_order_over_many_splits(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("".join(f"n{i}\tw{i} common\n" if i != 250 else "no tab\n" for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = corpus.from_tsv(spark, str(tmp_path / "c.tsv")).orderBy("doc_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["doc_id"], r["name"]) for r in got] == list(enumerate(f"n{i}" for i in range(500) if i != 250))


def test_invalid_utf8_fails(spark, tmp_path):
    (tmp_path / "c.tsv").write_bytes(b"a\t\xff\xfe\n")
    with pytest.raises(Exception, match="UTF"):
        corpus.from_tsv(spark, str(tmp_path / "c.tsv")).collect()


def test_directory(spark, tmp_path):
    for name in ("b.txt", "a.txt", "c.TXT", "d.md", ".txt"):
        (tmp_path / name).write_text(name)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/e.txt").write_text("no")
    assert [tuple(r) for r in corpus.load(spark, str(tmp_path)).orderBy("doc_id").collect()] == [(0, "a.txt", "a.txt"), (1, "b.txt", "b.txt")]


def test_directory_with_odd_names(spark, tmp_path):
    names = ["a b.txt", "a+b.txt", "a%41.txt", "_n.txt", ".h.txt", "é.txt"]
    for name in names:
        (tmp_path / name).write_text(f"is {name}")
    assert [tuple(r) for r in corpus.load(spark, str(tmp_path)).orderBy("doc_id").collect()] == [(i, n, f"is {n}") for i, n in enumerate(sorted(names))]
    (tmp_path / "z.txt").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match="UTF"):
        corpus.from_directory(spark, str(tmp_path)).collect()


def test_create_equals_build(spark, tmp_path):
    rows = corpus.from_rows(spark, [("a", "x y x"), ("b", ""), ("c", "y"), ("d", "?")])
    made, lazy = TextIndex.create(rows, str(tmp_path / "ix"), name_col="name"), TextIndex.build(rows, name_col="name")
    for part in ("postings", "docs", "terms", "sizes", "corpus"):
        a, b = getattr(made, part), getattr(lazy, part)
        assert sorted(map(tuple, a.select(b.columns).collect())) == sorted(map(tuple, b.collect()))
    assert not (tmp_path / "ix" / "_counted").exists()
    some = TextIndex.build(rows, ["y"], name_col="name").corpus.first()
    assert (some["n_docs"], some["total_len"], some["n_terms"], some["n_postings"]) == (4, 4, 1, 2)


def test_codec_over_pieces(spark, monkeypatch):
    """Lists that are cut into many pieces and parts, encoded, decoded and looked into."""
    monkeypatch.setattr(codec, "PIECE", 50)
    monkeypatch.setattr(codec, "REACH", 40)
    rng = random.Random(1)
    rows = sorted({(w, rng.randrange(0, 40_000) if w == "far" else rng.randrange(0, 1500)) for w in ("a", "far", "b") for _ in range(700)})
    posts = spark.createDataFrame([(w, d, rng.randrange(1, 400)) for w, d in rows], "term string, doc_id long, tf int")
    expected, gaps = sorted(map(tuple, posts.collect())), codec.gaps(posts)
    at = {}
    for r in sorted(gaps.collect(), key=lambda r: (r["term"], r["doc_id"])):
        k, prior = at.get(r["term"], (0, None))
        assert (r["pos"], r["block"], r["gap"]) == (k, k // 64, 0 if k % 64 == 0 else r["doc_id"] - prior)
        at[r["term"]] = (k + 1, r["doc_id"])
    blocks = codec.encode(gaps)
    assert sorted(map(tuple, codec.unpack(blocks).select("term", "doc_id", "tf").collect())) == expected == sorted(map(tuple, codec.decode(gaps).collect()))
    wanted = [(w, d) for w in ("a", "far", "none") for d in (*range(0, 1600, 7), 39_999, 10**7)]
    ask = spark.createDataFrame(wanted, "term string, doc_id long")
    hits = [x for x in expected if (x[0], x[1]) in set(wanted)]
    assert hits and sorted(map(tuple, codec.find(blocks, ask).collect())) == sorted(map(tuple, codec.merge(blocks, ask).collect())) == hits
    big = spark.createDataFrame([(v,) for v in (0, 127, 128, 16383, 16384, 2**21, 2**28, 2**34)], "v long").select(codec.varint(F.col("v")).alias("h")).collect()
    assert [r["h"] for r in big] == ["00", "7F", "8001", "FF7F", "808001", "80808001", "8080808001", "8080808040"]


def test_vocabulary():
    assert generator.vocabulary(["The", "ox", "zebra", "Zebra", "it's", "extraordinarily", "ant"], 5) == ["the", "zebra", "ant", "term0", "term1"]
    assert generator.vocabulary(None, 2) == ["term0", "term1"]


def test_save_load_and_append(spark, tmp_path):
    texts = ["rust go", "go", "", "rust rust learning", "machine go rust"]
    rows = corpus.from_rows(spark, [(f"d{i}", t) for i, t in enumerate(texts)])
    whole = TextIndex.build(rows, name_col="name")
    saved = whole.save(str(tmp_path / "index"), files=2)
    parts = TextIndex.build(rows.where("doc_id < 2"), name_col="name").append(TextIndex.build(rows.where("doc_id >= 2"), name_col="name"))
    expected = whole.corpus.first().asDict()
    assert expected["n_docs"] == 5 and expected["total_len"] == 9
    hits = search.search_ranked(whole, "rust go", 10).collect()
    for index in (saved, parts):
        assert index.corpus.first().asDict() == expected
        assert search.search_ranked(index, "rust go", 10).collect() == hits
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,rust)]" in saved.lookup("rust")._jdf.queryExecution().toString()


def test_empty_corpus(spark):
    index = TextIndex.build(corpus.from_rows(spark, []), name_col="name")
    assert index.corpus.first().asDict() == {"n_docs": 0, "total_len": 0, "avg_len": 0.0, "n_terms": 0, "n_postings": 0}
    assert search.search_ranked(index, "a", 5).collect() == []


def test_generator_is_the_same_on_any_partitions(spark):
    a, b = (sorted(map(tuple, generator.generate(spark, 200, partitions=n).collect())) for n in (1, 7))
    assert a == b
    assert all(60 <= len(t.split()) <= 199 for _, _, t in a)
    words = [w for _, _, t in a for w in t.split()]
    assert words.count("term0") > 4 * words.count("term9") > 0


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(0, "rust go"), (1, "go")], "doc_id long, text string").write.parquet(src)
    stream = lambda: spark.readStream.schema("doc_id long, text string").parquet(src)
    index_stream(stream(), str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([(2, "rust rust")], "doc_id long, text string").write.mode("append").parquet(src)
    index_stream(stream(), str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination()
    index = load_stream_index(spark, str(tmp_path / "ix"))
    assert index.corpus.first()["n_docs"] == 3
    assert [r["doc_id"] for r in search.search_ranked(index, "rust", 5).collect()] == [2, 0]


def _varints(*values):
    out = bytearray()
    for v in values:
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


@pytest.mark.parametrize("batch, parts", [(7, None), (100, 3), (10_000, 1)])
def test_encoded_bytes_over_batches(spark, monkeypatch, batch, parts):
    """Blocks that batches and pieces cut, wide gaps and counts, against bytes made one by one; rows in any order."""
    monkeypatch.setattr(codec, "PIECE", 1000)
    lists = {"a": [(3 * i, i % 3 + 1) for i in range(500)], "b": [(2**34 - 1, 200), (2**35 - 2, 2**21)], "é": [(i * 10**8, 127 + i) for i in range(130)], "z": [(1499, 1)]}
    rows = [(t, d, tf) for t, entries in lists.items() for d, tf in entries]
    random.Random(2).shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        blocks = codec.encode(codec.gaps(spark.createDataFrame(rows, "term string, doc_id long, tf int"), parts)).collect()
        made = spark.createDataFrame(blocks, "term string, block int, first_doc long, entries long, data binary")
        decoded = sorted(map(tuple, codec.unpack(made.withColumn("own", F.col("block") * 2)).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = {}
    for t, entries in lists.items():
        for k in range(0, len(entries), 64):
            ids = [d for d, _ in entries[k : k + 64]]
            gaps = [0, *(y - x for x, y in zip(ids, ids[1:]))]
            expected[t, k // 64] = (ids[0], len(ids), b"".join(_varints(g, tf) for g, (_, tf) in zip(gaps, entries[k : k + 64])))
    assert {(r["term"], r["block"]): (r["first_doc"], r["entries"], bytes(r["data"])) for r in blocks} == expected and len(blocks) == len(expected)
    assert decoded == sorted((t, k // 64, k // 64 * 2, d, tf) for t, entries in lists.items() for k, (d, tf) in enumerate(entries))
    assert codec.unpack(made.where("false")).collect() == []
