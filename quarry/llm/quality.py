"""Quality classifier: a sparse rule ensemble over text statistics.

Boosted shallow trees are grown on statistics of a bounded labelled sample;
each path from a root is a conjunctive rule, a lasso logistic fit weighs the
rules, and those that keep a weight become Spark column expressions. Scoring is
one narrow native pass over whole texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.common import pick
from quarry.llm.labelled import sample

#: Largest labelled sample of each class; the bound on what the driver gathers.
SAMPLE_PER_CLASS = 8_000
TREES, DEPTH, SHRINK, CUTS = 24, 3, 0.5, 32
#: Strength of the lasso, as a share of the least strength that leaves no rule.
LASSO = 0.01
FEATURES = ("chars", "words", "word_chars", "distinct_words", "repeated_words", "symbols", "symbol_runs", "capitals", "digits", "lines", "distinct_lines", "bars", "stops", "line_chars")
Rule = tuple[tuple[str, bool, float], ...]


def statistics(text: Column) -> list[Column]:
    """The statistics, named as in FEATURES; all are defined for empty texts."""
    raw = F.coalesce(text.cast("string"), F.lit(""))
    return _shares(raw, F.split(raw, r"\s+"), F.split(raw, "\n"))


def _shares(raw: Column, words: Column, lines: Column) -> list[Column]:
    chars, n_words, n_lines = F.length(raw).cast("double"), F.size(words).cast("double"), F.size(lines).cast("double")
    some = F.greatest(chars, F.lit(1.0))
    made = {
        "chars": chars,
        "words": n_words,
        "word_chars": chars / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "repeated_words": F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1)))) / n_words,
        "symbols": F.regexp_count(raw, F.lit(r"[^\p{L}\p{N}\s]")) / some,
        "symbol_runs": F.regexp_count(raw, F.lit(r"[^\p{L}\p{N}\s]{2,}")) / n_words,
        "capitals": F.regexp_count(raw, F.lit(r"\p{Lu}")) / some,
        "digits": F.regexp_count(raw, F.lit(r"\p{N}")) / some,
        "lines": n_lines,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "bars": F.size(F.split(raw, r"[|{}<>\\]")) / n_words,
        "stops": F.regexp_count(raw, F.lit(r"[.!?]\s")) / n_words,
        "line_chars": chars / n_lines,
    }
    return [made[k].alias(k) for k in FEATURES]


@dataclass(frozen=True)
class RuleEnsemble:
    """intercept + sum of the weights of the rules that hold, through the logistic function."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, stat: dict[str, Column]) -> Column:
        def holds(rule: Rule) -> Column:
            return reduce(lambda a, b: a & b, [(stat[k] > F.lit(c)) if above else (stat[k] <= F.lit(c)) for k, above, c in rule])

        total = reduce(lambda a, b: a + b, [F.when(holds(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.rules], F.lit(self.intercept))
        return 1.0 / (1.0 + F.exp(-total))


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], depth: int, path: Rule, found: list[Rule], step: np.ndarray) -> None:
    """Grow one tree on gradients; every node but the root adds its path to ``found``, leaves their value to ``step``."""
    if path:
        found.append(path)
    best = (1e-6, None)
    g, h = grad[rows].sum(), hess[rows].sum()
    if depth and len(rows) >= 20:
        for j, at in enumerate(cuts):
            if not len(at):
                continue
            cell = np.searchsorted(at, x[rows, j], side="left")  # x <= at[c] exactly when cell <= c
            gl = np.cumsum(np.bincount(cell, grad[rows], len(at) + 1))[:-1]
            hl = np.cumsum(np.bincount(cell, hess[rows], len(at) + 1))[:-1]
            nl = np.cumsum(np.bincount(cell, minlength=len(at) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(nl < 5) | (nl > len(rows) - 5)] = -1
            if gain.max() > best[0]:
                best = (gain.max(), (j, float(at[int(gain.argmax())])))
    if best[1] is None:
        step[rows] = -g / (h + 1)
        return
    j, c = best[1]
    low = x[rows, j] <= c
    for above, part in ((False, rows[low]), (True, rows[~low])):
        _grow(x, grad, hess, part, cuts, depth - 1, (*path, (FEATURES[j], above, c)), found, step)


def _holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, c in rule:
        v = x[:, FEATURES.index(k)]
        out &= (v > c) if above else (v <= c)
    return out


def _lasso(r: np.ndarray, y: np.ndarray, strength: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for logistic loss with an L1 penalty on all but the intercept."""
    n, k = r.shape
    reach = 0.25 * (np.linalg.norm(r, 2) ** 2 / n + 1)
    w, b = np.zeros(k), math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    v, c, t = w.copy(), b, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(r @ v + c)))
        w2 = v - r.T @ (p - y) / n / reach
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - strength / reach, 0)
        b2 = c - (p - y).mean() / reach
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return b, w


def fit_rules(x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
    """Fit on a matrix of statistics and 0/1 labels. With one class only, a constant near it; without rows, 0.5."""
    if not len(y) or y.min() == y.max():
        return RuleEnsemble(0.0 if not len(y) else 3.0 if y[0] else -3.0, ())
    cuts = []
    for j in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 1)[1:-1], method="lower"))
        junk = np.unique(np.quantile(x[y == 0, j], np.linspace(0, 1, CUTS // 2 + 1)[1:-1], method="lower"))
        every = np.unique(np.concatenate([q, junk]))
        cuts.append(every[every < x[:, j].max()])
    f, found, rows = np.zeros(len(y)), [], np.arange(len(y))
    for _ in range(TREES):
        p, step = 1 / (1 + np.exp(-f)), np.zeros(len(y))
        _grow(x, p - y, p * (1 - p), rows, cuts, DEPTH, (), found, step)
        f += SHRINK * step
    unique: dict[bytes, Rule] = {}
    for rule in dict.fromkeys(found):
        held = _holds(x, rule)
        if 0 < held.sum() < len(y):
            key = held.tobytes()
            unique[key] = min(unique.get(key, rule), rule, key=len)
    rules = list(unique.values())
    if not rules:
        return RuleEnsemble(math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)), ())
    r = np.column_stack([_holds(x, k) for k in rules]).astype(float)
    top = np.abs(r.T @ (y - y.mean())).max() / len(y)
    b, w = _lasso(r, y, LASSO * top)
    return RuleEnsemble(float(b), tuple((rule, float(v)) for rule, v in zip(rules, w) if abs(v) > 1e-3))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> RuleEnsemble:
    """Fit on at most ``per_class`` labelled rows of each class outside the held-out fold."""
    rows = with_statistics(sample(docs, labels, label, {0: per_class, 1: per_class}, id_col, text_col).withColumnRenamed("text", "__text"), "__text", ("doc_id", "label")).orderBy("doc_id").collect()
    x = np.array([[r[k] for k in FEATURES] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit_rules(x, np.array([r["label"] for r in rows], float))


def with_statistics(docs: DataFrame, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` and the statistics; the word and line arrays are made once."""
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    parts = docs.select(*[F.col(k) for k in keep], raw.alias("__raw"), F.split(raw, r"\s+").alias("__words"), F.split(raw, "\n").alias("__lines"))
    return parts.select(*keep, *_shares(F.col("__raw"), F.col("__words"), F.col("__lines")))


def score_quality(docs: DataFrame, model: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): one row for each document, null and empty texts included; higher scores are likelier good.

    Repeated rows and null ids keep a row each; other columns are left out, so their names can't clash. No shuffle.
    """
    docs = pick(docs, id_col, text_col)
    rows = with_statistics(docs.select(F.col(id_col), F.col(text_col).alias("__text")), "__text", (id_col,))
    return rows.select(F.col(id_col), model.score({k: F.col(k) for k in FEATURES}).alias("score"))


def keep_good(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows, with the columns of ``docs``, whose score is ``threshold`` or more."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    raw = F.coalesce(F.col(f"c{names.index(text_col)}").cast("string"), F.lit(""))
    parts = plain.select(F.struct(*plain.columns).alias("__row"), raw.alias("__raw"), F.split(raw, r"\s+").alias("__words"), F.split(raw, "\n").alias("__lines"))
    rows = parts.select("__row", *_shares(F.col("__raw"), F.col("__words"), F.col("__lines")))
    # not a filter: that would be pushed below the statistics, and these made again for each rule
    good = F.when(model.score({k: F.col(k) for k in FEATURES}) >= threshold, F.array("__row"))
    return rows.select(F.inline(good)).toDF(*names)
