import random
import re
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from quarry.llm import quality, queries, toxicity
from quarry.llm.common import fold_of, pick

SF = "/root/testdata/sf0.01"


def test_fold(spark):
    rows = spark.createDataFrame([(i,) for i in range(100)] + [(None,)], "doc_id long").withColumn("f", fold_of(F.col("doc_id"))).collect()
    assert all(r["f"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 if r["doc_id"] is not None else 0) for r in rows)


@pytest.mark.parametrize("text, folded", [
    ("Hello, World!", " hello world "), ("1d10t m0r0n", " idiot moron "), ("іdіоt", " idiot "), ("ｉｄｉｏｔ", " idiot "), ("tr@sh $cum", " trash scum "), ("word$$$ next", " word next "),
    ("id​iot", " idiot "), ("", "  "), ("naïve", " naïve "), ("résume", " resume "),
])
def test_folding(text, folded):
    assert toxicity.fold(text) == folded


def test_lexicon_matches_words_beginnings_and_exceptions():
    lex = toxicity.Lexicon({" idiot ": 5.0, " lowe": 3.0, " lowei": 4.0}, (" idiot proof ",))
    find = lambda t: sorted(w for w, _ in lex.hits(toxicity.fold(t)).values())
    assert find("an idiot, idiots and loweing") == [4.0, 5.0]
    assert find("idiot idiot") == [5.0, 5.0]
    assert find("it is idiot proof") == [] and find("idiot proof idiot") == [5.0]
    assert find("") == [] and toxicity.Lexicon({}).strength("idiot") == 0
    assert lex.score("idiot") > lex.score("idiot " + "word " * 500) > lex.score("word")


def test_hits_against_a_naive_matcher():
    """Every entry looked for at every place of folded random texts."""
    rng = random.Random(2)
    part = lambda n: "".join(rng.choice("ab1@") for _ in range(n))
    for _ in range(300):
        words = [part(rng.randrange(1, 5)) for _ in range(rng.randrange(25))]
        entries = {rng.choice([" {} ", " {}"]).format(toxicity.fold(part(rng.randrange(1, 4))).strip()): float(rng.randrange(1, 9)) for _ in range(6)}
        phrases = tuple({f" {toxicity.fold(a).strip()} {toxicity.fold(b).strip()} " for a, b in zip(words[::4], words[1::4])})
        lex, folded = toxicity.Lexicon(entries, phrases), toxicity.fold(" ".join(words))
        best = {}
        for at in range(len(folded)):
            for e, w in entries.items():
                if folded.startswith(e, at) and (at not in best or best[at][0] < w):
                    best[at] = (w, at + len(e) - 1)
        for p in phrases:
            if p not in entries:
                for at in range(len(folded)):
                    if folded.startswith(p, at):
                        best = {k: v for k, v in best.items() if not (at <= k and k < at + len(p) - 1)}
        assert {k: v[0] for k, v in lex.hits(folded).items()} == {k: v[0] for k, v in best.items()}


def test_evidence_is_counted_exactly(spark, docs_of):
    """A beginning of words counts with its fourth word however late that comes, on any partitioning."""
    texts = [f"badda{'abc'[i % 3]} n{i} x{i}" for i in range(150)] + [f"n{i} baddad m{i}" for i in range(150, 160)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, f"clean words {i} here") for i in range(150)]
    labels = spark.createDataFrame([(i, 1 if i < 1000 else 0) for i, _ in rows], "doc_id long, toxic int")
    found = [toxicity.fit_lexicon(docs_of(rows, p), labels).weights for p in (1, 7)]
    assert found[0] == found[1] and " badda" in found[0]


def plain_statistics(t):
    """The statistics by definition."""
    t = t or ""
    words, lines = re.split(r"[ \t\n\x0b\f\r]+", t), t.split("\n")
    kind = lambda p: sum(bool(regex.match(p, c)) for c in t)
    n, w, k = len(t), len(words), len(lines)
    sign = r"[^\p{L}\p{N} \t\n\x0b\f\r]"
    made = [n, w, n / w, len(set(words)) / w, sum(a == b for a, b in zip(words, words[1:])) / w, kind(sign) / max(n, 1), len(regex.findall(sign + "{2,}", t)) / w, kind(r"\p{Lu}") / max(n, 1),
            kind(r"\p{N}") / max(n, 1), k, len(set(lines)) / k, len(re.split(r"[|{}<>\\]", t)) / w, len(re.findall(r"[.!?][ \t\n\x0b\f\r]", t)) / w, n / k]
    return [float(x) for x in made]


def test_statistics_against_plain_ones(spark, docs_of):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(100_000 + i, t) for i, t in enumerate([None, "", " ", "\n\n", "a a a b", "É 9 ½ {x}|<y>", "!!! ## a.b. c! ", "中文。字 中文"])]
    for r in quality.with_statistics(pick(docs_of(docs), "doc_id", "text"), "text", ("doc_id",)).collect():
        assert np.allclose([r[k] for k in quality.FEATURES], plain_statistics(dict(docs)[r["doc_id"]])), r["doc_id"]


def test_toxicity_edges(spark, docs_of):
    lex = toxicity.Lexicon({" idiot ": 9.0})
    rows = [(1, None), (2, ""), (3, "you idiot"), (3, "you idiot"), (None, "fine"), (4, "fine " * 20_000)]
    docs = docs_of(rows)
    assert sorted((r["doc_id"] or 0, r["score"] >= 0.5) for r in toxicity.score_toxicity(docs, lex).collect()) == [(0, False), (1, False), (2, False), (3, True), (3, True), (4, False)]
    kept = toxicity.keep_clean(docs, lex)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 4]
    assert toxicity.score_toxicity(docs_of([]), lex).collect() == []
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert toxicity.fit_lexicon(docs, none).weights == {}
    assert quality.fit_quality(docs, none).rules == ()


def _accuracy(spark, scores, label):
    rows = scores.join(spark.read.parquet(f"{SF}/labels.parquet").dropna(), "doc_id").where("held_out").collect()
    return np.mean([r["predicted"] == r[label] for r in rows]), len(rows)


def test_toxicity_held_out_accuracy(spark):
    accuracy, n = _accuracy(spark, queries.op10_toxicity_lexicon(spark, SF), "toxic")
    assert n > 50 and accuracy > 0.93


def test_quality_held_out_accuracy(spark):
    scores = queries.op2_quality_rules(spark, SF)
    accuracy, n = _accuracy(spark, scores, "quality")
    assert n > 50 and accuracy > 0.93
    assert scores.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_held_out_labels_are_never_read(spark, docs_of):
    rows = [(i, "good words here and there. " * 3 if i % 2 else "bad ### *** !!! " * 5) for i in range(200)]
    docs = docs_of(rows)
    true = [(i, i % 2, 1 - i % 2) for i in range(200)]
    twisted = [(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, q, t) for i, q, t in true]
    a, b = (spark.createDataFrame(x, "doc_id long, quality int, toxic int") for x in (true, twisted))
    assert quality.fit_quality(docs, a) == quality.fit_quality(docs, b)
    assert toxicity.fit_lexicon(docs, a) == toxicity.fit_lexicon(docs, b)


def test_rules_fit_and_compile_alike(spark, docs_of):
    rng = np.random.default_rng(0)
    x = rng.random((600, len(quality.FEATURES)))
    y = ((x[:, 3] > 0.5) & (x[:, 5] <= 0.4)).astype(float)
    model = quality.fit_rules(x, y)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{k} double" for k in quality.FEATURES))
    got = np.array([r["s"] for r in df.select(model.score({k: F.col(k) for k in quality.FEATURES}).alias("s")).collect()])
    total = model.intercept + sum(w * quality._holds(x, r) for r, w in model.rules)
    assert np.allclose(got, 1 / (1 + np.exp(-total)))
    assert ((got >= 0.5) == (y == 1)).mean() > 0.97
    assert 0 < len(model.rules) < 120


def test_quality_edges(docs_of):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "word " * 50_000), (4, " \n\n ")]
    model = quality.RuleEnsemble(0.0, (((("symbols", True, 0.3),), -5.0),))
    got = quality.score_quality(docs_of(rows), model).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    docs = docs_of([(1, "fine text"), (2, "#*#*#*"), (3, None)])
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    assert quality.score_quality(docs_of([]), model).collect() == []
