import importlib
import pathlib
import random
import re

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import linededup, quality, queries, sql, toxicity
from quarry.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_lines_and_chunks():
    rng = random.Random(3)
    for _ in range(300):
        t = "".join(rng.choice("ab. \n!?\t") for _ in range(rng.randrange(80)))
        assert b"".join(linededup.lines(t.encode())) == t.encode()
    found, ends = linededup.chunk(b"x. " * 100)
    assert ends[-1] == len(found) == 100 and max(b - a for a, b in zip([0, *ends], ends)) <= linededup.LONGEST
    assert linededup.chunk(b"") == ([], [])
    h = linededup.line_hashes([b"a", b"b", b"a", b"b", b"b", b"a", b"a"])
    x = linededup.chunk_hashes(h, np.array([2, 4, 6, 7])).tolist()
    assert x[0] == x[1] and len(set(x)) == 3


def test_boundaries_resist_shifts():
    rng = random.Random(1)
    tail = [b"line %f. " % rng.random() for _ in range(200)]
    a = linededup.boundaries(linededup.line_hashes(tail)).tolist()
    b = [e - 3 for e in linededup.boundaries(linededup.line_hashes([b"one. ", b"two. ", b"three. ", *tail])).tolist()]
    assert len(set(a) & set(b)) > 0.95 * len(a)


def sentences(rng, n):
    return [" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(9)).capitalize() + "." for _ in range(n)]


@pytest.mark.parametrize("glue", [" ", "\n"])
def test_planted_passages(docs_of, glue):
    rng, rows, plants = random.Random(5), [], []
    for k in range(30):
        plant = sentences(rng, 7)
        plants.append(plant)
        for j in range(3):
            rows.append((10 * k + j, glue.join([*sentences(rng, rng.randrange(1, 6)), *plant, *sentences(rng, rng.randrange(1, 6))])))
    clean = [(1000 + i, glue.join(sentences(rng, 12))) for i in range(40)]
    docs = docs_of(rows + clean)
    out = linededup.dedup_lines(docs, removed_col="removed")
    assert out.columns == [*docs.columns, "removed"]
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    before = dict(rows + clean)
    assert all(got[i] == t for i, t in clean)
    gone = 0
    for k, plant in enumerate(plants):
        assert got[10 * k] == before[10 * k]
        for j in (1, 2):
            gone += all(s not in got[10 * k + j] for s in plant)
            own = [s for s in re.split(r"(?<=\.)\s", before[10 * k + j]) if s not in plant]
            assert all(s in got[10 * k + j] for s in own)
    assert gone >= 57  # of 60


@pytest.mark.parametrize("size", [2, 3, 4, 5, 6])
def test_short_passages_all_go(docs_of, size):
    rng, rows, plants = random.Random(size), [], []
    for k in range(30):
        plant = [a[:-1] + " " + b.lower() for a, b in zip(sentences(rng, size), sentences(rng, size))]  # 18 words each
        plants.append(plant)
        rows += [(2 * k + j, " ".join([*sentences(rng, rng.randrange(0, 4)), *plant, *sentences(rng, rng.randrange(0, 4))])) for j in range(2)]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs_of(rows)).collect()}
    for k, plant in enumerate(plants):
        assert got[2 * k] == rows[2 * k][1]
        assert got[2 * k + 1].strip() == " ".join(s for s in re.split(r"(?<=\.)\s", rows[2 * k + 1][1]) if s not in plant)


def brute_lines(texts):
    """Texts by id without the passages of two lines and 20 words that stand before, by comparing all pairs of places."""
    cut = {i: [x.strip() for x in linededup.lines(t.encode())] for i, t in texts.items()}
    seen, gone = {}, {i: set() for i in texts}
    for i in sorted(texts):
        for a in range(len(cut[i])):
            for b in range(a + 2, len(cut[i]) + 1):
                p = tuple(cut[i][a:b])
                if sum(len(x.split()) for x in p) < 20:
                    continue
                j, c = seen.setdefault(p, (i, a))
                if (j, c) != (i, a):
                    gone[i] |= set(range(max(a, c + b - a) if j == i else a, b))
    return {i: b"".join(x for n, x in enumerate(linededup.lines(t.encode())) if n not in gone[i]).decode() for i, t in texts.items()}


def test_lines_against_brute_force(docs_of):
    """Few different lines, so that passages begin and end anywhere and have parts that occur elsewhere too."""
    rng = random.Random(8)
    known = sentences(rng, 12) + ["Short one.", "Yes.", ""]
    texts = {i: rng.choice(["\n", "\n\n", " "]).join(rng.choice(known) if rng.random() < 0.9 else sentences(rng, 1)[0] for _ in range(rng.randrange(1, 12))) for i in range(120)}
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs_of(list(texts.items()))).collect()}
    assert got == brute_lines(texts)


def test_runs_are_joined():
    """Vectorized runs against joining matches one by one."""
    rng = np.random.default_rng(1)
    row = np.sort(rng.integers(0, 6, 300))
    key, line, n = row + 10, rng.integers(0, 25, 300), rng.integers(2, 5, 300)
    fkey, fline = rng.integers(10, 16, 300), rng.integers(0, 4, 300)
    fline = np.where(fkey == key, np.minimum(fline, line - 1), fline)
    ok = fline >= 0
    row, key, line, n, fkey, fline = (x[ok] for x in (row, key, line, n, fkey, fline))
    got = set(zip(*(x.tolist() for x in linededup.runs_of(row, key, line, n, fkey, fline))))
    gone = {(r, f, d, x) for r, k, a, m, f, g in zip(row.tolist(), key.tolist(), line.tolist(), n.tolist(), fkey.tolist(), fline.tolist()) for d in [g - a] for x in range(a + (max(g + m - a, 0) if f == k else 0), a + m)}
    assert {(r, f, g - a, x) for r, f, g, m, a in got for x in range(a, a + m)} == gone
    for r, f, g, m, a in got:  # nothing touches a run on its own diagonal
        assert (r, f, g - a, a - 1) not in gone and (r, f, g - a, a + m) not in gone


def test_passages_without_sentence_ends(docs_of):
    """60 words of prose without a full stop, and a passage in a script without spaces, are found in longer lines."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, whole = [], 0
    plants = [[word() for _ in range(60)] for _ in range(20)]
    for k, plant in enumerate(plants):
        for j in range(3):
            own = [] if j == 2 else [word() for _ in range(rng.randrange(5, 30))]
            rows.append((10 * k + j, " ".join([*own, *plant, *own[:7]])))
    han = "".join(chr(0x4E00 + rng.randrange(5000)) + ("。" if i % 12 == 11 else "") for i in range(72))
    rows += [(5000, "头一篇。" + han), (5001, han + "末一篇。")]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs_of(rows)).collect()}
    left = 0
    for k, plant in enumerate(plants):
        assert got[10 * k] == rows[3 * k][1]
        left += sum(w in got[10 * k + 1].split() for w in plant)
    assert left < 0.35 * 20 * 60  # what is before the first end inside and after the last one stays
    assert got[5000] == "头一篇。" + han and got[5001] == "末一篇。"


def test_line_edges(docs_of):
    t = " ".join(sentences(random.Random(2), 8))
    rows = [(3, t), (1, t), (1, t), (2, None), (4, ""), (5, "Short one. Short two."), (6, "Short one. Short two."), (7, t + " " + t), (None, "Odd. " * 30_000)]
    got = sorted(((r["doc_id"] or 0), r["text"]) for r in linededup.dedup_lines(docs_of(rows)).collect() if r["text"] is not None)
    by = dict(got)
    assert len(got) == 8 and by[1] == t and by[3] == "" and by[5] == by[6] == "Short one. Short two." and by[7].strip() == ""
    assert linededup.dedup_lines(docs_of([])).collect() == []


def test_line_query_keeps_every_row(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    got = {r["doc_id"]: r for r in queries.op4_line_dedup(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for i, r in got.items():
        assert len(docs[i]) - len(r["text"]) == r["removed_chars"] >= 0
        if not r["removed_chars"]:
            assert r["text"] == docs[i]


def test_pipeline_stages(spark):
    """Each stage against what a plain evaluation of its own input gives."""
    docs, columns, kept = table(spark, SF, "documents"), table(spark, SF, "documents").columns, {}
    labels = table(spark, SF, "labels")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, docs, SF), "test")
        assert after.columns == columns
        a, b = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (docs, after))
        if name == "toxicity":
            lex = toxicity.fit_lexicon(docs, labels)
            assert b == {i: t for i, t in a.items() if lex.score(t or "") < 0.5}
        elif name == "quality classifier":
            good = {r["doc_id"] for r in quality.score_quality(docs, quality.fit_quality(docs, labels)).where("score >= 0.3").collect()}
            assert b == {i: a[i] for i in good}
        elif name == "line dedup":
            con = duckdb.connect()
            plain = pd.DataFrame({"doc_id": list(a), "text": list(a.values())})
            con.register("documents", plain)
            assert b == dict(con.execute(f"SELECT doc_id, text FROM ({sql.LINE_DEDUP})").fetchall())
            assert after.where(F.col("n_chars") != F.length("text")).count() == 0
        else:
            from test_neardup import brute

            groups = brute(list(a.items()), 5, 80)
            assert b == {i: a[i] for i, (_, _, k) in groups.items() if k}
        docs, kept = after, b
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    tokenizer.encode_special_tokens = True
    sizes = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in kept.items()}
    assert {(r["doc_id"], r["piece"]): r["length"] for r in packed} == {(i, a // 2048): min(2048, n - a) for i, n in sizes.items() for a in range(0, n, 2048)}
    ends = {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048 and len(ends) <= -(-sum(sizes.values()) // 2048) + 1


def test_pipeline_with_odd_tables(spark, tmp_path):
    """No documents; and null ids, texts and languages, empty texts and repeated rows: nothing crashes and every kept document is packed."""
    docs = table(spark, SF, "documents")
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", None, None, 0), (2, "", None, None, 0), (3, "word " * 30, "en", "a", 150), (None, "Some text here.", "en", "a", 15)]
    for name, given in (("none", docs.limit(0)), ("odd", spark.createDataFrame(rows, docs.schema))):
        given.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        table(spark, SF, "labels").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert len(got) <= given.count() and all(r["length"] >= 1 for r in got)
        assert name == "odd" or got == []


def test_run_leaves_out_whole_copies(spark, monkeypatch, tmp_path):
    t = "\n".join(sentences(random.Random(4), 6))
    spark.createDataFrame([(1, t), (2, t), (3, "\n" + t + "\n"), (4, ""), (5, None), (6, " "), (7, t + "\nOwn end.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("line dedup", corpus_pipeline.drop_repeated_lines)])
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r[0]: r[1] for r in got.collect()} == {1: t, 4: "", 5: None, 6: " ", 7: "Own end."}


def test_near_copies_stage_with_odd_rows(docs_of, spark):
    docs = docs_of([(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, "x y z"), (3, "x y z"), (None, "p q"), (4, None)])
    got = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted((r[0] or 0, r[1]) for r in got.collect()) == [(0, "p q"), (1, "a b c d e f"), (3, "x y z"), (4, None)]


def test_nothing_else_imports_the_subpackage():
    root = pathlib.Path(corpus_pipeline.__file__).parent
    for p in (root / "quarry").rglob("*.py"):
        if "llm" not in p.parts:
            assert "quarry.llm" not in p.read_text(), p
    entry = importlib.import_module("__spark_entry__")
    names = list(entry.queries())
    assert [n for n in names if re.match(r"op\d+_", n)] and len([n for n in names if re.match(r"op\d+_", n)]) == 10 and "pipeline" in names
