"""Near-duplicate vectors: spherical k-means cells and blocked cosine products.

Vectors of one label and equal components are one class from the start. Classes
are dealt to the cells of centroids fitted on a bounded sample, and visit every other cell
that can hold a partner: for a pair at distance r, neither end is farther than r from
the plane between the cells, so no pair is lost. Cells are compared block by block; a block
gives each vector its count of links and the least member that it reaches there, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import pick, shuffle_width, written
from quarry.llm.graph import components

#: Vectors that centroids are fitted on, vectors that a cell should have, members of a block.
SAMPLE, PER_CELL, BLOCK = 8_192, 2_048, 4_096
#: Rows of a block that are compared with the whole block at a time, and products held at a time when cells are chosen.
STRIP, PRODUCTS = 512, 4_000_000


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows of one key each, from batches that are sorted by ``keys``, which aren't null; holds one key's rows and a batch."""
    held: list[pa.Table] = []
    last: list | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        cols = [b.column(b.schema.get_field_index(k)) for k in keys]
        edge = np.zeros(b.num_rows - 1, bool)
        for c in cols:
            edge |= pc.not_equal(c.slice(1), c.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(edge) + 1).tolist(), b.num_rows]
        for i, (x, z) in enumerate(zip(starts, starts[1:])):
            if i or (held and [c[0].as_py() for c in cols] != last):
                if held:
                    yield pa.concat_tables(held)
                held = []
            held.append(t.slice(x, z - x))
        last = [c[-1].as_py() for c in cols]
    if held:
        yield pa.concat_tables(held)


def cells_for(n: int) -> int:
    """Cells for n vectors: two at least, about PER_CELL vectors in each, and never more than the root of n, so that
    neither choosing a cell nor comparing within it is quadratic."""
    return max(1, min(n, max(2, min(-(-n // PER_CELL), math.isqrt(n)))))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """k unit centroids of unit vectors; fewer when there are fewer different vectors."""
    rng = np.random.default_rng(seed)
    c = np.unique(x[rng.permutation(len(x))[: 4 * k]], axis=0)
    c = c[rng.permutation(len(c))[:k]]
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), c)
    return c


def _vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, dim, digest, vec): vectors as bytes of their own type, float or double; digest is null where nothing can be linked."""
    kind = rows.schema[id_col].dataType.simpleString()
    real = _real(rows, vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim, digest, vec = [], [], []
            for i, v, label in zip(b.column(0), b.column(1), b.column(2)):
                inside = v.values if i.is_valid and v.is_valid and label.is_valid else None
                x = inside.to_numpy(zero_copy_only=False) if inside is not None and len(inside) and not inside.null_count else np.empty(0)
                if not len(x) or not np.isfinite(x).all() or not x.any():
                    dim.append(None), digest.append(None), vec.append(None)
                    continue
                x = x + real.type(0)  # no negative zeros
                dim.append(len(x))
                digest.append(xxhash.xxh3_128_digest(label.as_py().encode() + b"\0" + x.tobytes()))
                vec.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(dim, pa.int32()), pa.array(digest, pa.binary()), pa.array(vec, pa.binary())], names=["vec_id", "label", "dim", "digest", "vec"])

    plain = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<float>" if real == np.float32 else "array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    return plain.mapInArrow(run, f"vec_id {kind}, label string, dim int, digest binary, vec binary")


def _real(rows: DataFrame, vector_col: str) -> np.dtype:
    return np.dtype(np.float32 if rows.schema[vector_col].dataType.simpleString() == "array<float>" else np.float64)


def unit(raw: list[bytes], real: np.dtype) -> np.ndarray:
    """Unit vectors in double precision; the greatest component is brought to 1 first, so that squares neither vanish nor overflow."""
    x = np.frombuffer(b"".join(raw), real).reshape(len(raw), -1).astype(float)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _centroids(classes: DataFrame, real: np.dtype) -> np.ndarray:
    """Centroids of the commonest dimension, as many as the largest label's size asks for, of SAMPLE vectors or so many as there are centroids twice over."""
    largest = classes.groupBy("label", "dim").count().agg(F.max("count").alias("n")).first()["n"]
    if not largest:
        return np.zeros((1, 0))
    cells = cells_for(largest)
    dim = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()["dim"]
    got = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("digest"), "digest").limit(max(SAMPLE, 2 * cells)).select("vec").collect() if cells > 1 else []
    if len(got) < 2:
        return np.zeros((1, dim))
    return spherical_kmeans(unit([bytes(r["vec"]) for r in got], real), min(cells, len(got)))


def _cells(classes: DataFrame, centroids: np.ndarray, reach: float, real: np.dtype) -> DataFrame:
    """Rows (cell, home) of each class: its own cell, and lower ones within ``reach`` of the plane between."""
    gap = np.linalg.norm(centroids[:, None, :] - centroids[None, :, :], axis=2) if len(centroids) <= 4096 else None

    def apart(own: np.ndarray) -> np.ndarray:
        """Distances of the centroids ``own`` from all; worked out when needed where the table of all is large."""
        if gap is not None:
            return gap[own]
        near = centroids[own]
        return np.sqrt(np.maximum((near**2).sum(1)[:, None] + (centroids**2).sum(1) - 2 * near @ centroids.T, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            placed = np.zeros(n, np.int64)
            at, cell = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            fit = np.flatnonzero(b.column(2).to_numpy() == centroids.shape[1]) if len(centroids) > 1 else np.zeros(0, np.int64)
            step = max(1, PRODUCTS // len(centroids))
            for k in range(0, len(fit), step):
                rows = fit[k : k + step]
                s = unit(b.column(4).take(pa.array(rows)).to_pylist(), real) @ centroids.T
                own = s.argmax(1)
                placed[rows] = own
                visit = (s[np.arange(len(rows)), own][:, None] - s <= (reach + 1e-9) * apart(own) + 1e-12) & (np.arange(len(centroids)) < own[:, None])
                i, c = np.nonzero(visit)
                at.append(rows[i]), cell.append(c)
            every = np.concatenate([np.arange(n), *at])
            where = np.concatenate([placed, *cell])
            idx = pa.array(every)
            yield pa.RecordBatch.from_arrays([*(b.column(j).take(idx) for j in range(5)), pa.array(where.astype(np.int32)), pa.array(np.arange(len(every)) < n)], names=["rep", "label", "dim", "mult", "vec", "cell", "home"])

    kind = classes.schema["rep"].dataType.simpleString()
    return classes.select("rep", "label", "dim", "mult", "vec").mapInArrow(run, f"rep {kind}, label string, dim int, mult bigint, vec binary, cell int, home boolean")


def _least_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index that each of n nodes reaches over pairs (i, j)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def block_links(x: np.ndarray, mult: np.ndarray, home: np.ndarray, own: np.ndarray, apart: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of each row of a pair of blocks: how many vectors it is linked with there, and the least row that it reaches.

    Products in single precision leave out what can't be linked; what may be is multiplied again in double precision. Pairs are folded
    strip by strip, so memory doesn't grow with their number. At least one of a pair is at home, and with
    ``apart`` its two are of different blocks.
    """
    n, short = len(x), x.astype(np.float32)
    slack = (x.shape[1] + 8) * 2.0**-23
    links, root = np.zeros(n, np.int64), np.arange(n)
    for k in range(0, n, STRIP):
        i, j = np.nonzero(short[k : k + STRIP] @ short[k:].T >= threshold - slack)
        i, j = i + k, j + k
        ok = (i < j) & (home[i] | home[j])
        if apart:
            ok &= own[i] != own[j]
        i, j = i[ok], j[ok]
        for a in range(0, len(i), PRODUCTS // 64):
            z = slice(a, a + PRODUCTS // 64)
            near = np.einsum("ij,ij->i", x[i[z]], x[j[z]]) >= threshold
            p, q = i[z][near], j[z][near]
            if not len(p):
                continue
            np.add.at(links, p, mult[q])
            np.add.at(links, q, mult[p])
            ends, at = np.unique(np.concatenate([root[p], root[q]]), return_inverse=True)
            least = _least_reached(len(ends), at[: len(p)], at[len(p) :])
            new = np.arange(n)
            new[ends] = ends[least]
            root = new[root]
    return links, root


def _blocks(cells: DataFrame, threshold: float, width: int, real: np.dtype) -> DataFrame:
    """(rep, links, root): what a pair of blocks adds to a vector's links, and the least vector that it reaches there."""
    key = ["label", "dim", "cell"]
    sizes = cells.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = cells.join(sizes, key).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    names = [*key, "lo", "hi"]
    met = met.repartition(width, *names).sortWithinPartitions(*names, "rep").select(*names, "rep", "mult", "home", "own", "vec")
    kind = cells.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, names):
            home = t.column("home").to_numpy()
            if t.num_rows < 2 or not home.any():
                continue
            rep, mult, own = (t.column(c).to_numpy() for c in ("rep", "mult", "own"))
            apart = t.column("lo")[0].as_py() != t.column("hi")[0].as_py()
            links, root = block_links(unit(t.column("vec").to_pylist(), real), mult, home, own, apart, threshold)
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some]), pa.array(rep[root[some]])], names=["rep", "links", "root"])  # rows are sorted by rep

    return met.mapInArrow(run, f"rep {kind}, links bigint, root {kind}")


def near_vectors(rows: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", reach: float | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of ``rows``.

    Rows of equal, non-null labels and as many components are linked whose cosine in
    double precision is ``threshold`` or more. Vectors that are null, empty, zero or hold null
    or non-finite components, and rows with a null id, link with nothing. Equal
    vectors count as linked; n_links counts rows. component_id is the least
    id that links reach; repeated ids are links of their own. No rows give no rows; other columns are left out.

    ``reach`` is how far from the plane between two cells vectors still visit the
    other; None is the distance at which no pair can be lost. Less visits fewer cells and may lose pairs.
    """
    spark, rows = rows.sparkSession, pick(rows, id_col, vector_col, label_col)
    real = _real(rows, vector_col)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) if reach is None else reach
    vectors = written(_vectors(rows, id_col, vector_col, label_col), "embed-vectors")
    classes = vectors.where("digest IS NOT NULL").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    classes = written(classes, "embed-classes")
    cells = _cells(classes, _centroids(classes, real), reach, real)
    met = written(_blocks(cells, threshold, shuffle_width(spark), real), "embed-links")
    links = met.groupBy("rep").agg(F.sum("links").alias("links"))
    groups_ = components(met.where(F.col("rep") != F.col("root")).select(F.col("rep").alias("a"), F.col("root").alias("b")))
    names = (
        classes.select("digest", "rep", "mult")
        .join(links, "rep", "left")
        .join(groups_.withColumnRenamed("node", "rep"), "rep", "left")
        .select("digest", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    )
    out = vectors.select("vec_id", "digest").join(names, "digest", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
