"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding lowers case, replaces homoglyphs by the letter that they resemble and
digits or signs inside words by the letters that they stand for, and turns
whatever isn't a letter into a space. Entries are whole words (``" word "``)
or beginnings of words (``" pref"``); the sum of the hits' weights, without those inside
exception phrases, is normalised by length and mapped to a probability.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import pick, written
from quarry.llm.labelled import sample

#: Largest labelled samples; the bound on what a fit reads and on what the driver gathers.
SAMPLE_TOXIC, SAMPLE_CLEAN = 3_000, 6_000
#: Lexicon entries need so many toxic documents, and so many different neighbourhoods in them: copies of one text aren't evidence.
LEAST_DOCS, LEAST_CONTEXTS = 6, 8
#: A beginning of words is an entry only if so many different words of toxic documents have it.
LEAST_WORDS = 4
PREFIXES = (4, 5, 6)

_ALIKE = {
    **dict(zip("аеорсухіјѕԁһӏԛԝкмтвнгпьзбчгил", "aeopcyxijsdhlqwkmtbhrnb36чrил")),
    **dict(zip("αβεηικνορτυχωγ", "abenikvoptuxwy")),
    **dict(zip("ıɩɑɡʀѵƒßøđłþ", "iiagrvfßodlp")),
}
_STANDS = dict(zip("0134578", "oieastb"))
_SIGN = re.compile(r"[@$](?=[@$]*\w)")
_SIGNS = {"@": "a", "$": "s"}


class _Fold(dict):
    """Table for str.translate, filled as characters are met."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        base = _ALIKE.get(ch) or unicodedata.normalize("NFKC", ch).lower()
        base = "".join(_ALIKE.get(c, c) for c in base)
        base = "".join(_STANDS.get(c, c) for c in base)
        kind = unicodedata.category(ch)
        out = base if any(c.isalnum() for c in base) else "" if kind in ("Mn", "Cf") else " "
        self[code] = out
        return out


_FOLD = _Fold()


def fold(text: str) -> str:
    """Folded words, single spaces between, before and after them."""
    if "@" in text or "$" in text:
        text = _SIGN.sub(lambda m: _SIGNS[m[0]], text)
    return " " + " ".join(text.lower().translate(_FOLD).split()) + " "


@dataclass(frozen=True)
class Lexicon:
    """Entries with weights, exception phrases, and the logistic curve over the length-normalised sum."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    slope: float = 4.0
    bias: float = -4.0
    _made: list = field(default_factory=list, compare=False, repr=False)

    def __getstate__(self):
        return {k: ([] if k == "_made" else v) for k, v in self.__dict__.items()}

    def __setstate__(self, state):
        self.__dict__.update(state)

    @property
    def automaton(self) -> ahocorasick.Automaton:
        if not self._made:
            a = ahocorasick.Automaton()
            for k, w in self.weights.items():
                a.add_word(k, (w, len(k)))
            for k in self.exceptions:
                if k not in self.weights:
                    a.add_word(k, (None, len(k)))
            if len(a):
                a.make_automaton()
            self._made.append(a)
        return self._made[0]

    def hits(self, folded: str) -> dict[int, tuple[float, int]]:
        """Best weight and end of the hits, by where they begin, without those inside an exception phrase."""
        if not len(self.automaton):
            return {}
        found: dict[int, tuple[float, int]] = {}
        out: list[tuple[int, int]] = []
        for end, (w, n) in self.automaton.iter(folded):
            begin = end - n + 1
            if w is None:
                out.append((begin, end))
            elif begin not in found or found[begin][0] < w:
                found[begin] = (w, end)
        for a, b in out:
            for k in [k for k, (_, e) in found.items() if a <= k and k < b]:
                del found[k]
        return found

    def strength(self, text: str) -> float:
        """Sum of weights over a slowly growing length, so that a few hits count in long texts too."""
        folded = fold(text)
        total = sum(w for w, _ in self.hits(folded).values())
        return total / (1 + math.log1p(folded.count(" ") / 100))

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * self.strength(text) + self.bias))))


def _terms(folded: str) -> Iterator[tuple[str, int, int]]:
    """Entries that the text could give, with hashes of the neighbouring words and of the word itself."""
    words = folded.split()
    for i, w in enumerate(words):
        near = _mix(words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else "")
        own = _mix(w)
        yield f" {w} ", near, own
        for n in PREFIXES:
            if len(w) > n:
                yield f" {w[:n]}", near, own


def _entries(rows: DataFrame) -> dict[str, float]:
    """Entries that mark toxic documents of the sample, with log odds as weights."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        near: dict[str, list[int]] = defaultdict(list)  # short lists take less room than sets
        kinds: dict[str, list[int]] = defaultdict(list)
        for b in batches:  # a partition of a bounded sample
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen = set()
                for term, ctx, own in _terms(fold(text)):
                    if term not in seen:
                        seen.add(term)
                        docs[term][label] += 1
                    if label:
                        for held, most, x in ((near[term], LEAST_CONTEXTS, ctx), (kinds[term], LEAST_WORDS, own)):
                            if len(held) < most and x not in held:  # as many as are asked for: more change nothing
                                held.append(x)
        made = [pa.array(list(docs), pa.string()), *(pa.array([d[j] for d in docs.values()], pa.int64()) for j in (0, 1)), *(pa.array([x.get(t, []) for t in docs], pa.list_(pa.int64())) for x in (near, kinds))]
        yield pa.RecordBatch.from_arrays(made, names=["term", "clean", "toxic", "near", "kinds"])

    several = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    got = (
        rows.mapInArrow(count, "term string, clean long, toxic long, near array<long>, kinds array<long>")
        .groupBy("term")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), several("near").alias("contexts"), several("kinds").alias("words"))
    )
    totals = rows.groupBy("label").count().collect()
    n = {r["label"]: r["count"] for r in totals}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    odds = F.log((F.col("toxic") + 0.5) / F.lit(n1 + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(n0 + 1.0))
    top = got.where((F.col("toxic") >= LEAST_DOCS) & (F.col("contexts") >= LEAST_CONTEXTS) & (F.col("term").endswith(" ") | (F.col("words") >= LEAST_WORDS))).withColumn("odds", odds).where(F.col("odds") >= 2.0)
    return {r["term"]: round(float(r["odds"]), 4) for r in top.orderBy("term").collect()}  # bounded by the sample


def _mix(*words: str) -> int:
    raw = "\0".join(words).encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) << 16 ^ zlib.adler32(raw)


def _exceptions(rows: DataFrame, lexicon: Lexicon) -> tuple[str, ...]:
    """Two-word phrases around a hit that clean documents of the sample have and toxic ones hardly."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for label, text in zip(b["label"], b["text"]):
                folded, phrases = fold(text), set()
                for begin, (_, end) in lexicon.hits(folded).items():
                    stop = folded.index(" ", max(end, begin + 1)) if end < len(folded) else end
                    prior, after = folded.rfind(" ", 0, begin), folded.find(" ", stop + 1)
                    if prior >= 0:
                        phrases.add(folded[prior : stop + 1])
                    if after >= 0:
                        phrases.add(folded[begin : after + 1])
                out += [(p, int(label)) for p in phrases]
            yield pd.DataFrame(out, columns=["phrase", "label"]).astype({"phrase": str, "label": "int64"})

    got = rows.mapInPandas(count, "phrase string, label long").groupBy("phrase").agg(F.sum("label").alias("toxic"), F.count("*").alias("n"))
    got = got.where((F.col("n") - F.col("toxic") >= 5) & (F.col("n") - F.col("toxic") >= 10 * F.col("toxic")))
    return tuple(r["phrase"] for r in got.orderBy("phrase").collect())  # bounded by the sample


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and bias of a ridge logistic fit in one variable, by Newton's method."""
    w, b = 1.0, -1.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-(w * x + b)))
        g = np.array([((p - y) * x).sum() + 0.05 * w, (p - y).sum() + 0.01 * b])
        s = p * (1 - p)
        h = np.array([[(s * x * x).sum() + 0.05, (s * x).sum()], [(s * x).sum(), s.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        w, b = w - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return max(float(w), 0.01), float(b)


def fit_lexicon(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", most_toxic: int = SAMPLE_TOXIC, most_clean: int = SAMPLE_CLEAN) -> Lexicon:
    """Learn entries, exceptions and curve from at most ``most_toxic`` and ``most_clean`` labelled rows outside the held-out fold.

    Without labelled rows of both classes the lexicon is empty and every score is the same, below 0.5.
    """
    rows = written(sample(docs, labels, label, {1: most_toxic, 0: most_clean}, id_col, text_col).select("label", "text"), "toxic-sample")
    first = Lexicon(_entries(rows))
    full = Lexicon(first.weights, _exceptions(rows, first)) if first.weights else first

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"label": b["label"], "x": [full.strength(t) for t in b["text"]]})

    got = rows.mapInPandas(measure, "label int, x double").collect()
    y, x = np.array([r["label"] for r in got], float), np.array([r["x"] for r in got], float)
    order = np.lexsort((y, x))  # sums don't depend on the order of arrival
    y, x = y[order], x[order]
    if not len(y) or y.min() == y.max() or not full.weights:
        return Lexicon(full.weights, full.exceptions, 4.0, -4.0)
    slope, bias = _curve(x, y)
    return Lexicon(full.weights, full.exceptions, slope, bias)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): one row for each document. Null and empty texts have no hits and the least score.

    Repeated rows and null ids keep a row each; other columns are left out. One narrow pass over Arrow batches.
    """
    docs = pick(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([lexicon.score(t) for t in texts], pa.float64())], names=[id_col, "score"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, score double")


def keep_clean(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with the columns of ``docs``, whose score is below ``threshold``; null and empty texts have no hits, repeated rows are treated alike."""
    names, at = docs.columns, docs.columns.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names with dots or in two cases are no obstacle then

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([lexicon.score(str(t) if t is not None else "") < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*names)
