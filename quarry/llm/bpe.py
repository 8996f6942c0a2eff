"""Byte-level BPE encoding and decoding with a segment tree per piece.

A piece is one match of the split pattern. Its bytes are the leaves of a
segment tree whose nodes hold the leftmost pair of least rank; a merge takes the
root and rewrites the leaves of its live neighbours, each up a path of
logarithmic length. Short pieces of a batch share one array of trees that NumPy
advances a merge at a time; long ones have a tree of their own.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import kept, pick

_NONE = np.iinfo(np.int64).max
#: Longest piece, in bytes, that shares an array of trees with others.
FOREST_BYTES = 64
#: Pieces whose ids a worker keeps. A bound on memory; the ids are the same without.
CACHED_PIECES = 600_000
#: Pieces or characters that are encoded at a time.
BATCH_PIECES, BATCH_CHARS = 200_000, 1_000_000


class ByteBPE:
    """Encoder and decoder for a file of ``base64(token) rank`` lines, whose ranks are the ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, r in ranks.items():
            self.token[r] = t
        self.byte_id = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        if (self.byte_id < 0).any():
            raise ValueError("the ranks lack single bytes")
        self.width = len(self.token)
        pairs = {ranks[t[:i]] * self.width + ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.pairs = pairs
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_key = np.append(keys[order], _NONE)
        self.pair_rank = np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], _NONE)
        self.cache: dict[str, bytes] = {}

    @classmethod
    def parse(cls, raw: bytes, pattern: str) -> ByteBPE:
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}, pattern)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.searchsorted(self.pair_key, key)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], _NONE)

    def _forest(self, pieces: list[bytes], leaves: int) -> list[bytes]:
        """Ids, as little-endian int32, of pieces of 2 to ``leaves`` bytes; all trees advance together."""
        n, size = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), np.uint8).reshape(n, leaves)
        ids = np.full((n, leaves + 1), -1, np.int64)
        at = np.arange(leaves)
        ids[:, :leaves] = np.where(at < size[:, None], self.byte_id[raw], -1)
        live = np.zeros((n, leaves + 1), bool)
        live[:, :leaves] = at < size[:, None]
        after = np.tile(np.minimum(np.arange(1, leaves + 2), leaves), (n, 1))
        after = np.minimum(after, size[:, None])
        before = np.tile(np.arange(-1, leaves), (n, 1))
        tree = np.full((n, 2 * leaves), _NONE, np.int64)

        def leaf(left: np.ndarray, right: np.ndarray, pos: np.ndarray, there: np.ndarray) -> np.ndarray:
            rank = np.where(there, self._rank(np.maximum(left, 0), np.maximum(right, 0)), _NONE)
            return np.where(rank < _NONE, rank * leaves + pos, _NONE)

        tree[:, leaves:] = leaf(ids[:, :-1], ids[:, 1:], np.broadcast_to(at, (n, leaves)), at + 1 < size[:, None])
        for k in range(leaves - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
        rows = np.flatnonzero(tree[:, 1] < _NONE)
        f_ids, f_live, f_after, f_before, f_tree = ids.ravel(), live.ravel(), after.ravel(), before.ravel(), tree.ravel()
        while len(rows):
            row, root = rows * (leaves + 1), rows * (2 * leaves)
            best = f_tree[root + 1]
            pos, rank = best % leaves, best // leaves
            gone = f_after[row + pos]
            last = f_after[row + gone]
            first = f_before[row + pos]
            f_ids[row + pos], f_live[row + gone] = rank, False
            f_after[row + pos] = last
            f_before[row + last] = pos
            has = first >= 0
            prior = np.maximum(first, 0)
            own = leaf(rank, f_ids[row + last], pos, last < size[rows])
            nodes = root + leaves
            f_tree[nodes + gone] = _NONE
            f_tree[nodes + pos] = own
            f_tree[nodes + np.where(has, first, pos)] = np.where(has, leaf(f_ids[row + prior], rank, prior, has), own)
            up = [leaves + gone, leaves + pos, leaves + prior]
            for _ in range(leaves.bit_length() - 1):  # all leaves are equally deep
                up = [p >> 1 for p in up]
                for p in up:
                    under = root + 2 * p
                    f_tree[root + p] = np.minimum(f_tree[under], f_tree[under + 1])
            rows = rows[f_tree[root + 1] < _NONE]
        flat = ids[live].astype("<i4").tobytes()
        ends = np.cumsum(live.sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _tree(self, piece: bytes) -> bytes:
        """Ids of one long piece, by a tree in lists."""
        n, width, pairs = len(piece), self.width, self.pairs
        leaves = 1 << (n - 1).bit_length()
        none = (1 << 62, n)
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n))
        tree = [none] * (2 * leaves)
        for i in range(n - 1):
            rank = pairs.get(ids[i] * width + ids[i + 1])
            if rank is not None:
                tree[leaves + i] = (rank, i)
        for k in range(leaves - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(pos: int, value: tuple[int, int]) -> None:
            k = leaves + pos
            tree[k] = value
            k >>= 1
            while k:
                least = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == least:
                    break
                tree[k] = least
                k >>= 1

        def pair(left: int, right: int) -> tuple[int, int]:
            if left < 0 or right >= n:
                return none
            rank = pairs.get(ids[left] * width + ids[right])
            return none if rank is None else (rank, left)

        while tree[1] is not none and tree[1] != none:
            rank, pos = tree[1]
            gone = after[pos]
            last = after[gone]
            ids[pos], ids[gone] = rank, -1
            after[pos] = last
            before[last] = pos
            put(gone, none)
            put(pos, pair(pos, last))
            if before[pos] >= 0:
                put(before[pos], pair(before[pos], pos))
        return np.array([i for i in ids if i >= 0], "<i4").tobytes()

    def _learn(self, pieces: Iterable[str]) -> None:
        """Put the ids of new pieces into the cache."""
        sorts: dict[int, list[tuple[str, bytes]]] = {}
        if len(self.cache) > CACHED_PIECES:
            self.cache.clear()
        for p in set(pieces):
            if p in self.cache:
                continue
            b = p.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(b)
            if whole is not None:
                self.cache[p] = whole.to_bytes(4, "little")
            elif len(b) > FOREST_BYTES:
                self.cache[p] = self._tree(b)
            else:
                sorts.setdefault(1 << (len(b) - 1).bit_length(), []).append((p, b))
        for leaves, found in sorts.items():
            for k in range(0, len(found), 16_384):
                part = found[k : k + 16_384]
                self.cache.update(zip((p for p, _ in part), self._forest([b for _, b in part], leaves)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as int32 arrays."""
        out: list[np.ndarray] = []
        waiting: list[list[str]] = []
        pending = 0

        def flush() -> None:
            nonlocal pending
            self._learn(p for w in waiting for p in w)
            out.extend(np.frombuffer(b"".join(map(self.cache.__getitem__, w)), "<i4") for w in waiting)
            waiting.clear()
            pending = 0

        for t in texts:
            if len(t) <= BATCH_CHARS:
                waiting.append(found := self.split.findall(t))
                pending += len(found)
                if pending > BATCH_PIECES:
                    flush()
                continue
            flush()
            matches, parts = self.split.finditer(t), []
            while found := [m[0] for m in islice(matches, BATCH_PIECES)]:
                self._learn(found)
                parts.append(b"".join(map(self.cache.__getitem__, found)))
            out.append(np.frombuffer(b"".join(parts), "<i4"))
        flush()
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids; they need not be valid UTF-8. Unknown ids raise IndexError."""
        return b"".join(map(self.token.__getitem__, ids.tolist()))


def encoder(raw: bytes, pattern: str) -> ByteBPE:
    """The worker's encoder for these ranks, with its cache; made once."""
    return kept(f"bpe {zlib.crc32(raw)} {pattern}", lambda: ByteBPE.parse(raw, pattern))


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """(id, ids array<int>), and with ``decode`` also ``decoded`` binary, the bytes that the ids stand for.

    Null texts count as empty; empty texts have no ids. Special tokens have no
    meaning here: their strings are ordinary text. Repeated rows are kept, null
    ids pass through and other columns are left out, so their names can't
    clash. One narrow pass, no shuffle. The vocabulary file is read on the
    driver (under 1 MB) and broadcast. Arrow batches are bounded in bytes, and a
    text of any length is split as a stream.
    """
    docs = pick(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value, pattern)
        for b in batches:
            texts = b.column(1)
            for k in range(0, b.num_rows, 512):
                ids = enc.encode([t or "" for t in texts.slice(k, 512).to_pylist()])
                ends = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(i) for i in ids], out=ends[1:])
                cols = [b.column(0).slice(k, 512), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32()))]
                if decode:
                    cols.append(pa.array([enc.decode(i) for i in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "ids", "decoded"][: len(cols)])

    plain = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return plain.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>" + ", decoded binary" * decode)


def bpe_decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary): the bytes of each id list. Null lists count as empty; unknown ids fail the job."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value, "(?s:.)")
        for b in batches:
            out = [enc.decode(np.array(i or [], np.int64)) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=[id_col, "decoded"])

    return encoded.select(F.col(id_col), F.col(ids_col).alias("ids")).mapInArrow(run, f"`{id_col}` {kind}, decoded binary")


def round_trip_digest(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of ``bpe_encode(decode=True)``: count of ids, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded bytes."""
    return encoded.select(
        F.col(id_col),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def token_counts(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens) of rows with an ``ids`` array; null arrays have 0."""
    return encoded.select(F.col(id_col), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"))
