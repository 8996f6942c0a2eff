"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Documents longer than a sequence are cut into full pieces, which are sequences
of their own; what is left of each is an item to be packed. Items are dealt at
random over cells of bounded size. Each cell is evolved on several islands: crossover
injects whole well-filled bins of one parent into another, bins that share
an item with them are dissolved, and the displaced items are put back best-fit. After each epoch
islands exchange their elites. Bins that a cell leaves open meet in further rounds.
"""

from __future__ import annotations

import gc
import json
import os
import random
import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quarry.llm.common import forget, kept, pick, written

#: Mean items in a cell, islands of each cell, epochs between migrations, children of an epoch, individuals kept.
CELL, ISLANDS, EPOCHS, CHILDREN, KEPT = 4_000, 2, 2, 24, 5
#: Sequences that a cell should fill, so that the one it leaves open is a small share; and mean items of a cell at most for that.
CELL_BINS, MOST_ITEMS = 32, 100_000
#: Words whose ids a worker keeps, and words encoded at a time; bounds on memory only.
CACHED_WORDS, ENCODED_WORDS = 900_000, 8_192
#: Marks that the pre-tokenizer never joins to the letters before them.
_MARKS = ",.!?;:*&$#%|()"
BATCH_CHARS = 1_000_000


class WordTokenizer:
    """Ids of a tokenizer file whose pre-tokenizer never crosses white space, word by word with a cache.

    The file's normalizer must be NFC, white space to spaces, lower case. Strings of special tokens are ordinary text.
    """

    def __init__(self, spec: str, cached_words: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        plain = json.loads(spec)
        kinds = [n["type"] for n in plain["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"a normalizer of another kind: {kinds}")
        plain |= {"normalizer": None, "added_tokens": []}
        self.model = Tokenizer.from_str(json.dumps(plain))
        self.cache: dict[str, bytes] = {}
        self.most = cached_words

    @staticmethod
    def words(text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # the tokenizer has no final sigma
        text = text.lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # Python's white space only
            import regex

            return [w for w in regex.split(r"\s+", text) if w]
        return text.split()

    def _learn(self, words: set[str]) -> None:
        """Put the ids of new words into the cache; letters before a tail of common marks are a piece of their own."""
        split = {}
        for w in words:
            core = w.rstrip(_MARKS)
            split[w] = (core, w[len(core) :]) if core.isalpha() else (w, "")
        new = list({p for parts in split.values() for p in parts if p and p not in self.cache})
        for k in range(0, len(new), ENCODED_WORDS):
            some = new[k : k + ENCODED_WORDS]
            self.cache.update((p, array("I", e.ids).tobytes()) for p, e in zip(some, self.model.encode_batch_fast(some, add_special_tokens=False)))
        self.cache.update((w, self.cache[core] + self.cache[tail]) for w, (core, tail) in split.items() if tail)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit."""
        out: list[bytes] = []
        waiting: list[tuple[list[str], list[bytes | None]]] = []
        chars = 0

        def flush() -> None:
            nonlocal chars
            missing = {w for ws, ids in waiting if None in ids for w, i in zip(ws, ids) if i is None}
            self._learn(missing)
            for ws, ids in waiting:
                if None in ids:
                    ids = [self.cache[w] if i is None else i for w, i in zip(ws, ids)]
                out.append(b"".join(ids))
            waiting.clear()
            chars = 0
            if len(self.cache) > self.most:
                self.cache.clear()

        collects = gc.isenabled()
        gc.disable()  # nothing here has cycles, and the cache is large to walk through
        try:
            for t in texts:
                ws = self.words(t)
                waiting.append((ws, list(map(self.cache.get, ws))))
                chars += len(t)
                if chars > BATCH_CHARS:
                    flush()
            flush()
        finally:
            if collects:
                gc.freeze()
                gc.enable()
        return out


def _tokenizer(spec: str, cached_words: int) -> WordTokenizer:
    return kept(f"words {zlib.crc32(spec.encode())} {cached_words}", lambda: WordTokenizer(spec, cached_words))


def tokenize(docs: DataFrame, tokenizer_path: str, length: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, cached_words: int = CACHED_WORDS) -> DataFrame:
    """(id, n_ids, crcs[, ids binary]): each text's ids, then ``end_id``; crcs are CRC-32s of its pieces of ``length`` ids.

    Ids are hashed as little-endian unsigned 32-bit. Null texts count as empty
    and have ``end_id`` only. Repeated rows and null ids keep a row each; other columns are left out. One narrow pass.
    """
    docs = pick(docs, id_col, text_col)
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # one file, under 2 MB
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(shared.value, cached_words)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                ids = [i + end for i in tok.encode([t or "" for t in b.column(1).slice(k, 512).to_pylist()])]
                crcs = [[zlib.crc32(memoryview(i)[a : a + 4 * length]) for a in range(0, len(i), 4 * length)] for i in ids]
                cols = [b.column(0).slice(k, 512), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(crcs, pa.list_(pa.int64()))]
                if with_ids:
                    cols.append(pa.array(ids, pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_ids", "crcs", "ids"][: len(cols)])

    plain = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    return plain.mapInArrow(run, f"`{id_col}` {kind}, n_ids bigint, crcs array<bigint>" + ", ids binary" * with_ids)


def _best_fit(order: list[int], size: list[int], free: list[tuple[int, int]], bins: list[list[int]], capacity: int) -> None:
    """Put items in order each into the fullest bin that holds it. free: sorted (room, bin)."""
    for i in order:
        s = size[i]
        k = bisect_left(free, (s, -1))
        if k < len(free):
            room, b = free.pop(k)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > s:
            insort(free, (room - s, b))


def _fresh(order: list[int], size: list[int], capacity: int) -> list[list[int]]:
    bins: list[list[int]] = []
    _best_fit(order, size, [], bins, capacity)
    return bins


def _fitness(bins: list[list[int]], size: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins are better, then a larger sum of squared fills."""
    return len(bins), -sum((sum(size[i] for i in b) / capacity) ** 2 for b in bins)


def _cross(a: list[list[int]], b: list[list[int]], size: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Inject the best-filled bins of ``b`` into ``a``; dissolve a's bins that share items; best-fit the displaced."""
    fill = sorted(((sum(size[i] for i in x), k) for k, x in enumerate(b)), reverse=True)
    take = max(1, int(len(b) * rng.uniform(0.2, 0.6)))
    chosen = [b[k] for _, k in fill[: 2 * take]]
    rng.shuffle(chosen)
    chosen = chosen[:take]
    inside = {i for x in chosen for i in x}
    bins, displaced = [list(x) for x in chosen], []
    for x in a:
        if inside.isdisjoint(x):
            bins.append(list(x))
        else:
            displaced += [i for i in x if i not in inside]
    least = min(range(len(bins)), key=lambda k: sum(size[i] for i in bins[k]))
    displaced += bins.pop(least)  # mutation: the emptiest bin is dissolved as well
    free = sorted((capacity - f, k) for k, x in enumerate(bins) if (f := sum(size[i] for i in x)) < capacity)
    _best_fit(sorted(displaced, key=size.__getitem__, reverse=True), size, free, bins, capacity)
    return bins


def evolve(size: list[int], capacity: int, elites: list[list[list[int]]], seed: int, children: int = CHILDREN) -> list[list[int]]:
    """One epoch of an island: the best packing of items of 1 to ``capacity`` found from the elites given.

    Ends early where the bound sum / capacity, rounded up, is reached: that many bins can't be undercut.
    """
    if not size:
        return []
    rng, bound = random.Random(seed), -(-sum(size) // capacity)
    falling = sorted(range(len(size)), key=lambda i: (-size[i], i))
    people = [e for e in elites if e] or [_fresh(falling, size, capacity)]
    if min(map(len, people)) <= bound:
        return min(people, key=len)
    while len(people) < KEPT:
        noise = {i: size[i] * rng.uniform(0.7, 1.3) for i in falling}
        people.append(_fresh(sorted(falling, key=noise.__getitem__, reverse=True), size, capacity))
    ranked = sorted(((_fitness(p, size, capacity), k, p) for k, p in enumerate(people)), key=lambda x: x[:2])
    for n in range(children):
        if ranked[0][0][0] <= bound:
            break
        a, b = ranked[min(rng.randrange(len(ranked)), rng.randrange(len(ranked)))][2], ranked[rng.randrange(len(ranked))][2]
        child = _cross(a, b, size, capacity, rng)
        fit = _fitness(child, size, capacity)
        if fit < ranked[-1][0] and all(fit != r[0] for r in ranked):
            ranked[-1] = (fit, KEPT + n, child)
            ranked.sort(key=lambda x: x[:2])
    return ranked[0][2]


def _epoch(cells: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """(cell, island, sizes, uids, bin_of, n_bins) after one epoch; elites: array of bin numbers by item, own first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                size = [int(s) for s in row.sizes]
                elites = []
                for bin_of in row.elites:
                    bins: list[list[int]] = [[] for _ in range(max(bin_of, default=-1) + 1)]
                    for i, k in enumerate(bin_of):
                        bins[k].append(i)
                    elites.append(bins)
                bins = evolve(size, capacity, elites, seed=hash((int(row.cell), int(row.island), epoch)))
                bin_of = [0] * len(size)
                for k, b in enumerate(bins):
                    for i in b:
                        bin_of[i] = k
                yield pd.DataFrame({"cell": [row.cell], "island": [row.island], "sizes": [size], "uids": [list(row.uids)], "bin_of": [bin_of], "n_bins": [len(bins)]})

    return cells.mapInPandas(run, "cell bigint, island int, sizes array<int>, uids array<bigint>, bin_of array<int>, n_bins int")


def _pack_cells(items: DataFrame, capacity: int, n_cells: int, islands: int, epochs: int) -> DataFrame:
    """(cell, uid, size, bin) of items (uid, size), each cell packed on its own, written."""
    cells = (
        items.withColumn("cell", F.pmod(F.xxhash64("uid"), F.lit(n_cells)))
        .groupBy("cell")
        .agg(F.array_sort(F.collect_list(F.struct("size", "uid"))).alias("items"))
        .select("cell", F.col("items.size").cast("array<int>").alias("sizes"), F.col("items.uid").alias("uids"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
        .withColumn("elites", F.array().cast("array<array<int>>"))
    )
    evolved = None
    for epoch in range(epochs):
        before, evolved = evolved, written(_epoch(cells, capacity, epoch), "packing-islands")
        forget(*filter(None, [before]))
        if epoch + 1 < epochs:  # migration round a ring: own elite, and that of the island before
            meet = evolved.groupBy("cell").agg(F.first("sizes").alias("sizes"), F.first("uids").alias("uids"), F.map_from_entries(F.collect_list(F.struct("island", "bin_of"))).alias("all"))
            cells = meet.select("cell", "sizes", "uids", "all", F.explode(F.map_keys("all")).alias("island")).select(
                "cell", "sizes", "uids", "island", F.array(F.col("all")[F.col("island")], F.col("all")[F.pmod(F.col("island") + (islands - 1), F.lit(islands))]).alias("elites")
            )
    best = evolved.groupBy("cell").agg(F.min_by(F.struct("sizes", "uids", "bin_of"), F.struct("n_bins", "island")).alias("b"))
    rows = best.select("cell", F.explode(F.arrays_zip("b.uids", "b.sizes", "b.bin_of")).alias("x")).select("cell", F.col("x.uids").alias("uid"), F.col("x.sizes").alias("size"), F.col("x.bin_of").alias("bin"))
    packed = written(rows, "packing-cells")
    forget(evolved)
    return packed


def _cells_for(items: int, size: int, capacity: int, cell: int) -> int:
    """Cells for items of a total size: about ``cell`` items in each, or more where the items are so small that these fill few bins."""
    by_bins = max(size // (CELL_BINS * capacity), -(-items // max(cell, MOST_ITEMS)))
    return int(max(1, min(-(-items // cell), by_bins)))


def pack(lengths: DataFrame, capacity: int, cell: int = CELL, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """Pack rows (uid, n) into sequences of ``capacity``: (uid, piece, start, length, sequence_id, offset).

    uid must be unique and n is 0 or more; a null n counts as 0. Rows longer than ``capacity`` are cut
    into full pieces, each a sequence of its own, and a remainder; a row of 0
    gives no piece. Offsets are gapless from 0. No rows give no rows. Cells have a
    bounded number of items, whatever the input, and only counts reach the driver. Of each
    cell the emptiest bin goes on to the next round, a small share of its items, so rounds are few and their work falls geometrically.
    """
    lengths = lengths.select("uid", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))
    left = lengths.select("uid", (F.col("n") % capacity).cast("int").alias("size")).where(F.col("size") > 0)
    measured = lambda df: tuple(int(x or 0) for x in df.agg(F.count("*"), F.sum("size")).first())
    (total, size), placed, base = measured(left), [], 0
    while total:
        n_cells = _cells_for(total, size, capacity, cell)
        packed = _pack_cells(left, capacity, n_cells, islands, epochs)
        forget(left)
        own = Window.partitionBy("cell", "bin")
        before = own.orderBy("size", "uid").rowsBetween(Window.unboundedPreceding, -1)
        w = packed.withColumn("fill", F.sum("size").over(own)).withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))
        total = 0
        if n_cells > 1:  # of each cell the emptiest bin, if it isn't full, goes on to the next round
            open_bin = w.groupBy("cell").agg(F.min(F.struct("fill", "bin")).alias("least")).where(F.col("least.fill") < capacity).select("cell", F.col("least.bin").alias("bin"))
            left = written(w.join(open_bin, ["cell", "bin"], "left_semi").select("uid", "size"), "packing-open")
            total, size = measured(left)
            w = w.join(open_bin, ["cell", "bin"], "left_anti")
        placed.append(w.select("uid", (F.lit(base) + F.col("cell") * (1 << 24) + F.col("bin")).alias("sequence_id"), "offset"))
        base += n_cells << 24  # a bin has an item at least, and a cell fewer than 2 ** 24
    tails = reduce(DataFrame.unionByName, placed) if placed else lengths.where(F.lit(False)).select("uid", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    n, whole = F.col("n"), F.floor(F.col("n") / capacity)
    remainders = lengths.join(tails, "uid").select("uid", whole.cast("int").alias("piece"), (whole * capacity).cast("long").alias("start"), (n % capacity).cast("long").alias("length"), F.col("sequence_id").cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))
    long_rows = lengths.where(n >= capacity).select("uid", F.explode(F.sequence(F.lit(0), (whole - 1).cast("int"))).alias("piece"))
    full = _numbered(long_rows).select("uid", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), "sequence_id", F.lit(0).cast("long").alias("offset"))
    return remainders.unionByName(full)


def _numbered(pieces: DataFrame) -> DataFrame:
    """Negative sequence ids for full pieces; written first, so that they stay as they are if a task runs again."""
    return written(pieces.withColumn("sequence_id", -1 - F.monotonically_increasing_id()), "packing-full")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", cached_words: int = CACHED_WORDS) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): one row for each piece of each document row.

    Every row counts, repeated ids and null ids included; null texts are empty
    and so have ``end_id`` alone. A worker keeps the ids of ``cached_words`` words, which bounds its memory and changes no result. The encoded lengths are written once and numbered there.
    """
    encoded = tokenize(docs, tokenizer_path, capacity, end_id, id_col, text_col, cached_words=cached_words)
    rows = written(encoded.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col), "n_ids", "crcs"), "packing-lengths")
    spans = pack(rows.select("uid", F.col("n_ids").alias("n")), capacity)
    return spans.join(rows, "uid").select(F.col(id_col), "piece", "start", "length", F.get("crcs", F.col("piece")).alias("ids_crc32"), "sequence_id", "offset")
