"""Near-duplicate documents by SetSketch registers.

A document is its set of word shingles. Each of M registers holds the truncated
minimum, on an exponential scale, of one hash over the set, so registers of a union are the
greater of the parts' and equal ones tell likeness. Bands of registers propose candidates, the joint
likelihood of two sketches and known set sizes discards most of those too unlike, and what is left is
confirmed on the full sets.

Equal sets are one class from the start. Within a bucket of a band, every class is
first compared with the bucket's least only; classes that this links need no further
pairs. Buckets that then hold several components are compared block by block
across components: first their sketches, which leave the members that may have a partner there, then the full sets
of these, dealt to each pair of blocks once. What a pair of blocks gives is the least member that each one
reaches, never pairs: no cap, no lost link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.common import forget, kept, pick, shuffle_width, written
from quarry.llm.embed import groups
from quarry.llm.graph import components

#: Registers, those of a band, and the scale b, a of the registers. 40 bands of 6: a pair of likeness 0.8 shares none with probability 5e-6.
M, ROWS = 240, 6
BANDS = M // ROWS
BASE, RATE, TOP = 1.001, 20.0, 65_534
#: Deviations of the likelihood estimate, below the threshold, at which a pair is still confirmed on full sets.
DEVIATIONS = 4.7
#: Members of a bucket whose sketches a task compares with as many others' at a time; shingles of a block whose full sets are compared.
BLOCK, BLOCK_SHINGLES = 2_048, 1_000_000
#: Words whose hashes a worker keeps; a bound on memory only.
CACHED_WORDS = 400_000
#: Ids that may be broadcast (8 bytes each); beyond it they are shuffled.
BROADCAST_ROWS = 1_000_000

_ODD = np.random.default_rng(7).integers(1, 1 << 62, (2, M), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.random.default_rng(11).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(raw: bytes, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles of a UTF-8 text.

    A to Z are lower-cased; words are runs without space, tab, newline, vertical tab, form feed or
    carriage return. With fewer than k words the whole sequence is one shingle; without words there are none.
    """
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(kept("shingles", _Words).__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(h))):
        out = _mix(out * _STEP[i % 64] + h[i : i + n])
    return np.unique(out)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """M registers: floor(1 - log_b of the least exponential variate), truncated to 0 .. TOP + 1; an empty set has zeros."""
    if not len(hashes):
        return np.zeros(M, np.uint16)
    least = np.full(M, 1 << 32, np.uint64)
    for k in range(0, len(hashes), 2048):
        x = hashes[k : k + 2048, None] * _ODD[0][None, :]
        x += _ODD[1][None, :]
        x >>= np.uint64(32)
        np.minimum(least, x.min(axis=0), out=least)
    u = (least.astype(float) + 0.5) / 2.0**32
    variate = -np.log1p(-u) / RATE
    return np.clip(np.floor(1 - np.log(variate) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union."""
    return np.maximum(a, b)


def _slope(plus: np.ndarray, minus: np.ndarray, same: np.ndarray, u: np.ndarray, v: np.ndarray, j: float | np.ndarray) -> np.ndarray:
    """Derivative by J of the joint log likelihood of register comparisons, sizes being in the proportion u to v."""
    c = (BASE - 1) / BASE
    p = lambda x: -np.log1p(-x * c) / np.log(BASE)
    d = lambda x: c / (1 - x * c) / np.log(BASE)
    x, y = np.maximum(u - v * j, 1e-9), np.maximum(v - u * j, 1e-9)
    rest = np.maximum(1 - p(x) - p(y), 1e-12)
    return -plus * v * d(x) / p(x) - minus * u * d(y) / p(y) + same * (v * d(x) + u * d(y)) / rest


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each pair of rows may reach the threshold: sizes allow it, and the likelihood still rises at a
    likeness DEVIATIONS below it, so that its maximum, the estimate, lies above."""
    near = np.minimum(na, nb) >= threshold * np.maximum(na, nb)
    out = np.zeros(len(na), bool)
    if near.any():
        a, b, na, nb = a[near], b[near], na[near].astype(float), nb[near].astype(float)
        plus, minus = (a > b).sum(1), (a < b).sum(1)
        cut = threshold - DEVIATIONS * np.sqrt(threshold * (1 - threshold) / M)
        out[near] = _slope(plus, minus, M - plus - minus, na / (na + nb), nb / (na + nb), cut) >= 0
    return out


def estimate(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> float:
    """Likeness of greatest joint likelihood, by bisection on its derivative."""
    plus, minus = np.array([(a > b).sum()]), np.array([(a < b).sum()])
    u, v = np.array([na / (na + nb)]), np.array([nb / (na + nb)])
    low, high = 0.0, min(na, nb) / max(na, nb)
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if _slope(plus, minus, M - plus - minus, u, v, mid)[0] > 0 else (low, mid)
    return (low + high) / 2


def _sketches(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(doc_id, n, digest, regs) of each row: set size, a 128-bit digest of the set (null if empty) and its registers."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digest, regs = [], [], []
            for raw in b.column(1):
                s = shingles(raw.as_py() or b"", k)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                regs.append(sketch(s).astype(">u2").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "n", "digest", "regs"])

    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("raw"))
    return plain.mapInArrow(run, f"doc_id {kind}, n bigint, digest binary, regs binary")


def _bands() -> Column:
    """Exploded (band, key) of ``regs``, the number of the band mixed into the key."""
    return F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("regs", i * (2 * ROWS) + 1, F.lit(2 * ROWS))))).alias("band", "key")


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), ">u2").reshape(-1, M).astype(np.uint16)


def _pass_sketches(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of classes whose sketches let them pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ok = likely(_matrix(b.column(2)), _matrix(b.column(3)), b.column(4).to_numpy(), b.column(5).to_numpy(), threshold)
                yield b.select(["a", "b"]).filter(pa.array(ok))

    left = classes.select(F.col("rep").alias("a"), F.col("regs").alias("ra"), F.col("n").alias("na"))
    right = classes.select(F.col("rep").alias("b"), F.col("regs").alias("rb"), F.col("n").alias("nb"))
    near = F.least("na", "nb") >= threshold * F.greatest("na", "nb")
    kind = classes.schema["rep"].dataType.simpleString()
    return pairs.join(left, "a").join(right, "b").where(near).select("a", "b", "ra", "rb", "na", "nb").mapInArrow(run, f"a {kind}, b {kind}")


def _dealt(members: DataFrame, blocks: Column, width: int) -> DataFrame:
    """Members (key, rep, ...) dealt to the pairs (lo, hi) of their buckets' blocks, sorted so that those of a pair follow each other."""
    sizes = members.groupBy("key").agg(blocks.cast("int").alias("blocks"))
    placed = members.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("blocks", "other")
    return met.repartition(width, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "rep")


def _first_shared(band: int, row: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether ``band`` is the first that the rows share, so that a pair counts in one bucket only."""
    if not band:
        return np.ones(len(others), bool)
    same = (others[:, : band * ROWS] == row[: band * ROWS]).reshape(len(others), band, ROWS).all(2)
    return ~same.any(1)


def _partners(t: pa.Table, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, later rows that the sketches let pass, component of each row) of one pair of blocks. The caller may merge components as it goes."""
    comp, n, own = (t.column(c).to_numpy(zero_copy_only=False).copy() if c == "comp" else t.column(c).to_numpy() for c in ("comp", "n", "own"))
    regs, band = _matrix(t.column("regs")), t.column("band")[0].as_py()
    apart = t.column("lo")[0].as_py() != t.column("hi")[0].as_py()
    for i in range(len(comp) - 1):
        rest = np.arange(i + 1, len(comp))
        rest = rest[comp[rest] != comp[i]]
        if apart:
            rest = rest[own[rest] != own[i]]
        rest = rest[np.minimum(n[rest], n[i]) >= threshold * np.maximum(n[rest], n[i])]
        if len(rest):
            rest = rest[likely(np.broadcast_to(regs[i], (len(rest), M)), regs[rest], np.full(len(rest), n[i]), n[rest], threshold)]
        if len(rest):
            rest = rest[_first_shared(band, regs[i], regs[rest])]
        if len(rest):
            yield i, rest, comp


def _worth(members: DataFrame, threshold: float, width: int) -> DataFrame:
    """(key, rep) of the members (key, band, rep, comp, n, regs) that, by the sketches, may be linked with one of another component in their bucket."""
    kind = members.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["key", "lo", "hi"]):
            some = np.zeros(t.num_rows, bool)
            for i, rest, _ in _partners(t, threshold):
                some[i] = True
                some[rest] = True
            if some.any():
                yield from t.select(["key", "rep"]).filter(pa.array(some)).to_batches()

    return _dealt(members, F.ceil(F.count("*") / BLOCK), width).select("key", "band", "rep", "comp", "n", "regs", "own", "lo", "hi").mapInArrow(run, f"key bigint, rep {kind}").distinct()


def _links(members: DataFrame, threshold: float, percent: int, width: int) -> DataFrame:
    """(a, b): links of members (key, band, rep, comp, n, regs, hashes) of a bucket, as many as join what is linked there, confirmed on full sets.

    A task has the sets of two blocks, each of about BLOCK_SHINGLES shingles or one set; two members that links join already aren't compared again.
    """
    kind = members.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["key", "lo", "hi"]):
            rep, sets, a, b = t.column("rep").to_numpy(), t.column("hashes"), [], []
            at = lambda i: np.frombuffer(sets[int(i)].as_buffer(), np.uint64)
            for i, rest, comp in _partners(t, threshold):
                s = at(i)
                for j in rest:
                    if comp[j] == comp[i]:
                        continue
                    o = at(j)
                    both = len(np.intersect1d(s, o, assume_unique=True))
                    if 100 * both >= percent * (len(s) + len(o) - both):
                        a.append(rep[i]), b.append(rep[j])
                        comp[comp == comp[j]] = comp[i]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, t.schema.field("rep").type), pa.array(b, t.schema.field("rep").type)], names=["a", "b"])

    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES))
    return _dealt(members, blocks, width).select("key", "band", "rep", "comp", "n", "regs", "own", "lo", "hi", "hashes").mapInArrow(run, f"a {kind}, b {kind}")


def _full_sets(reps: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(rep, hashes): full shingle sets of the classes named by (rep), made from the texts anew and written."""
    kind = classes.schema["rep"].dataType.simpleString()
    ends = written(reps.distinct().join(classes.select("rep", "digest"), "rep"), "minhash-ends")
    ids = ends.select(F.col("rep").alias("__end")).distinct()
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [shingles(raw.as_py() or b"", k) for raw in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in made], pa.binary()), pa.array([s.tobytes() for s in made], pa.binary())], names=["rep", "digest", "hashes"])

    text = docs.select(F.col(id_col).alias("rep"), F.col(text_col).cast("string").cast("binary").alias("raw"))
    full = text.join(ids, F.col("rep") == F.col("__end"), "left_semi").mapInArrow(sets, f"rep {kind}, digest binary, hashes binary")
    made = written(full.join(ends, ["rep", "digest"], "left_semi").groupBy("rep").agg(F.first("hashes").alias("hashes")), "minhash-sets")
    forget(ends)
    return made


def _confirm(stars: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes with 100 |A and B| >= percent |A or B|, on their full sets; at most a pair a band for each class."""
    kind = stars.schema["a"].dataType.simpleString()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= percent * (len(s) + len(t) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    joined = stars.join(full.select(F.col("rep").alias("a"), F.col("hashes").alias("x")), "a").join(full.select(F.col("rep").alias("b"), F.col("hashes").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(check, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of ``docs``.

    Documents are linked whose sets of ``words``-word shingles have a Jaccard
    likeness of ``percent`` hundredths or more; component_id is the least id
    that links reach. Documents without words (null, empty, blank) have no
    shingles and are linked with nothing. Ids should be unique integers: rows
    that repeat an id count as texts of one document where that id is a
    component's least, and a row with a null id is never a component's name (its component is null if
    no other row has its set). No rows give no rows; other columns are left out.
    """
    spark, threshold, docs = docs.sparkSession, percent / 100, pick(docs, id_col, text_col)
    width = shuffle_width(spark)
    rows = written(_sketches(docs, id_col, text_col, words), "minhash-rows")
    classes = rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs")).where("rep IS NOT NULL")
    classes = written(classes, "minhash-classes")
    bands = classes.select("rep", _bands())
    shared = written(bands.groupBy("key").agg(F.min("rep").alias("least"), F.count("*").alias("members")).where("members > 1").select("key", "least"), "minhash-shared")  # so that the join can split a hot band
    members = written(bands.join(shared, "key"), "minhash-members")
    stars = members.where(F.col("rep") != F.col("least")).select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
    stars = written(_pass_sketches(stars, classes, threshold), "minhash-stars")
    sets = lambda reps: _full_sets(reps, classes, docs, id_col, text_col, words)
    full = sets(stars.select(F.col("a").alias("rep")).unionByName(stars.select(F.col("b").alias("rep"))))
    first = written(_confirm(stars, full, percent), "minhash-links")
    forget(stars, full, shared)
    known = written(components(first), "minhash-components")
    placed = members.join(known.withColumnRenamed("node", "rep"), "rep", "left").select("key", "band", "rep", F.coalesce("component", "rep").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members")).where("lo < hi AND members > 2").select("key")
    open_ = written(placed.join(mixed, "key").join(classes.select("rep", "n", "regs"), "rep"), "minhash-open")
    forget(members, known)
    worth = written(_worth(open_, threshold, width), "minhash-worth")
    full = sets(worth.select("rep"))
    second = written(_links(open_.join(worth, ["key", "rep"]).join(full, "rep"), threshold, percent, width), "minhash-more")
    forget(open_, worth, full)
    groups_ = components(first.unionByName(second))
    names = classes.select("digest", "rep").join(groups_.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = rows.select("doc_id", "n", "digest").join(names, "digest", "left")
    component = F.coalesce(F.when(F.col("n") > 0, F.col("component")), F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))
