"""Line dedup by content-defined chunks.

A text is wrapped into lines at newlines and after sentence ends, each line with the
white space character that ends it; a line of more than LONG_LINE bytes is wrapped again after words that its content
defines, so that a passage without sentence ends has lines too. From every line on a chunk goes to where it has LEAST_LINES lines
and LEAST_WORDS words, and to every line one comes from the nearest such place before it. So chunks overlap and depend
on nothing outside them: the chunks inside a passage cover all its lines, wherever it stands. Chunks whose
hash occurs elsewhere are compared byte by byte with the first occurrence and removed.
The first occurrence always stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import forget, pick, written

#: Lines in the rolling hash of ``boundaries``; a part goes on in one of so many places; most lines of a part.
WINDOW, SPREAD, LONGEST = 2, 3, 16
#: Least lines and words of a passage that is removed; two characters from U+3000 to U+D7FF count as a word as well.
LEAST_LINES, LEAST_WORDS = 2, 20
#: Bytes of a line that isn't wrapped again; about one in WRAP pairs of words ends a piece of a longer one, or every STRIDE-th word if no pair does.
LONG_LINE, WRAP, STRIDE = 300, 8, 16
#: Keys that may be broadcast (16 bytes each); beyond it they are shuffled.
BROADCAST_ROWS = 1_000_000
#: What ends a line; and a byte that UTF-8 doesn't have.
_ENDS, _CUT = (b". ", b"! ", b"? ", b".\t", b"!\t", b"?\t", b"\n", *(c.encode() for c in "。！？")), b"\xff"
_WORD = re.compile(rb"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+[ \t\n\r\x0b\x0c]*")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_WIDE = np.isin(np.arange(256), range(0xE3, 0xEE))  # first bytes of U+3000 to U+D7FF
#: Rows of a batch that are cut into lines at a time.
SLICE = 256


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _wrapped(line: bytes) -> list[bytes]:
    """Pieces of a long line: a word ends one if its length, its last byte and the length of the word before make it an end."""
    tokens = _WORD.findall(line)
    bare = _bare(tokens)
    ends = [i + 1 for i in range(1, len(tokens) - 1) if not (3 * len(bare[i - 1]) + len(bare[i]) + bare[i][-1]) % WRAP] or list(range(STRIDE, len(tokens), STRIDE))
    return [b"".join(tokens[a:z]) for a, z in zip([0, *ends], [*ends, len(tokens)])] if tokens else [line]


def lines(raw: bytes) -> list[bytes]:
    """The wrapped lines of a UTF-8 text; joined they are the text."""
    for end in _ENDS:
        raw = raw.replace(end, end + _CUT)
    found = raw.split(_CUT)
    if not found[-1]:
        found.pop()
    if found and max(map(len, found)) > LONG_LINE:
        found = [p for x in found for p in (_wrapped(x) if len(x) > LONG_LINE else (x,))]
    return found


def boundaries(hashes: np.ndarray) -> np.ndarray:
    """Where parts end that don't overlap, as counts of lines from the start; the last is the number of lines."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    rolled = hashes.copy()
    for back in range(1, WINDOW):
        rolled[back:] = rolled[back:] * _STEP + hashes[:-back]
    ends = np.flatnonzero(_mix(rolled) % np.uint64(SPREAD) != 0) + 1
    if not len(ends) or ends[-1] != n:
        ends = np.append(ends, n)
    sizes = np.diff(ends, prepend=0)
    if sizes.max() > LONGEST:
        ends = np.concatenate([[*range(e - s + LONGEST, e, LONGEST), e] for e, s in zip(ends.tolist(), sizes.tolist())])
    return ends.astype(np.int64)


def line_hashes(found: list[bytes]) -> np.ndarray:
    """Hashes of the lines without the white space around them, so that a line is the same before a newline and before a space."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, map(bytes.strip, found)), np.uint64, len(found))


def word_counts(found: list[bytes]) -> np.ndarray:
    """Twice the words of each line, as white space parts them, and its characters of wide scripts, which have no such words."""
    if not found:
        return np.zeros(0, np.int64)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    starts = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"".join(found), np.uint8)
    blank = _SPACE[raw]
    begins = ~blank
    begins[1:] &= blank[:-1]
    begins[starts] = ~blank[starts]
    return 2 * np.add.reduceat(begins, starts, dtype=np.int64) + np.add.reduceat(_WIDE[raw], starts, dtype=np.int64)


def spans(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the chunks of texts that have ``sizes`` lines, one text after the other.

    A passage of LEAST_LINES lines and LEAST_WORDS words or more is the union of the chunks inside it: from a line of it either the
    chunk that starts there ends inside, or the one that ends with the passage starts there or before.
    """
    total, ends = np.concatenate([[0], np.cumsum(words)]), np.cumsum(sizes)
    first, last = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)
    at = np.arange(len(words))
    to = np.maximum(at + LEAST_LINES, np.searchsorted(total, total[:-1] + 2 * LEAST_WORDS))
    since = np.minimum(at + 1 - LEAST_LINES, np.searchsorted(total, total[1:] - 2 * LEAST_WORDS, "right") - 1)
    ahead = to <= last
    behind = since >= first
    behind[behind] = to[since[behind]] != at[behind] + 1  # the others are there already
    return np.concatenate([at[ahead], since[behind]]), np.concatenate([to[ahead], at[behind] + 1])


def span_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """63-bit hashes of spans of lines, from the hashes of their lines and the lines' places in them, by sums from the start."""
    power = lambda base: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(h), base)]))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power(_STEP)[:-1])])
    return (_mix((total[ends] - total[starts]) * power(_BACK)[starts]) >> np.uint64(1)).astype(np.int64)


def chunk_hashes(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of parts that don't overlap."""
    return span_hashes(h, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)


def chunk(raw: bytes) -> tuple[list[bytes], list[int]]:
    """(lines, ends of parts that don't overlap)."""
    found = lines(raw)
    return found, boundaries(line_hashes(found)).tolist()


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = pick(docs, id_col, text_col)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    own = F.col(f"`{id_col}`")
    return docs.select(own.cast("bigint").alias("doc"), F.xxhash64(own, text).alias("key"), text.cast("binary").alias("text"))


def _chunks(rows: DataFrame) -> DataFrame:
    """(doc, key, line, n, hash) of every chunk: its first line, number of lines and hash."""

    def made(b: pa.RecordBatch) -> pa.RecordBatch:
        cut = [lines(raw) for raw in b.column(2).to_pylist()]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        found = list(chain.from_iterable(cut))
        starts, ends = spans(word_counts(found), sizes)
        of = np.repeat(np.arange(len(cut)), sizes)[starts]
        idx = pa.array(of)
        cols = [b.column(0).take(idx), b.column(1).take(idx), *(pa.array(c.astype(np.int32)) for c in (starts - (np.cumsum(sizes) - sizes)[of], ends - starts)), pa.array(span_hashes(line_hashes(found), starts, ends))]
        return pa.RecordBatch.from_arrays(cols, names=["doc", "key", "line", "n", "hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                yield made(b.slice(i, SLICE))

    return rows.mapInArrow(run, "doc bigint, key bigint, line int, n int, hash bigint")


def _only(rows: DataFrame, keys: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """Rows that have (or, left_anti, lack) one of the keys; these are broadcast if a count shows them to be few."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, on, how)


def _repeats(chunks: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(key, found array<struct<line, n, fkey, fline>>): for each text its chunks that occur earlier, and where first; and the tables that this reads.

    Chunks are too many for their hashes to be broadcast at any size that matters, so both sides are always shuffled; the smaller, of distinct hashes, is the one that is held.
    """
    often = written(chunks.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "line-often")
    some = written(chunks.join(often.hint("shuffle_hash"), "hash", "left_semi"), "line-repeated")
    forget(chunks, often)
    firsts = written(some.groupBy("hash").agg(F.min(F.struct("doc", "key", "line")).alias("f")), "line-first")  # so that the join can split a hot chunk
    again = some.join(firsts.hint("shuffle_hash"), "hash").where((F.col("key") != F.col("f.key")) | (F.col("line") != F.col("f.line")))
    return again.groupBy("key").agg(F.collect_set(F.struct("line", "n", F.col("f.key").alias("fkey"), F.col("f.line").alias("fline"))).alias("found")), [some, firsts]


def runs_of(row: np.ndarray, key: np.ndarray, line: np.ndarray, n: np.ndarray, fkey: np.ndarray, fline: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first key, first line there, number of lines, line here) of matches that overlap or touch, and are as far from the first occurrence, made one.

    Matches are given by the number of their text and its key. Lines that a match shares with its own first occurrence stay. Sorted by all but the last, then by it.
    """
    over = np.where(fkey == key, np.maximum(fline + n - line, 0), 0)
    by, a, z = fline - line, line + over, line + n
    order = np.lexsort((a, by, fkey, row))
    row, fkey, by, a, z = (x[order] for x in (row, fkey, by, a, z))
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (fkey[1:] != fkey[:-1]) | (by[1:] != by[:-1])
    lift = (np.cumsum(new) - 1) * (int(z.max(initial=0)) + 1)
    reach = np.maximum.accumulate(z + lift)  # the furthest end so far within each group
    new[1:] |= a[1:] + lift[1:] > reach[:-1]
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(row)) - 1
    row, fkey, first, size, at = row[starts], fkey[starts], (a + by)[starts], (reach - lift)[ends] - a[starts], a[starts]
    order = np.lexsort((at, size, first, fkey, row))
    return row[order], fkey[order], first[order], size[order], at[order]


def _runs(repeats: DataFrame) -> DataFrame:
    """(fkey, fline, n, key, at) of each run of matches, with the lines where it starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(b.num_rows), sizes)
            keys, inside = b.column(0).to_numpy(), lists.flatten()
            cols = [inside.field(c).to_numpy().astype(np.int64) for c in ("line", "n", "fkey", "fline")]
            row, fkey, fline, n, at = runs_of(row, keys[row], cols[0], cols[1], cols[2], cols[3])
            same = np.zeros(len(row), bool)
            same[1:] = (row[1:] == row[:-1]) & (fkey[1:] == fkey[:-1]) & (fline[1:] == fline[:-1]) & (n[1:] == n[:-1])
            starts = np.flatnonzero(~same)
            places = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)).astype(np.int32)), pa.array(at.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(fkey[starts]), pa.array(fline[starts].astype(np.int32)), pa.array(n[starts].astype(np.int32)), pa.array(keys[row[starts]]), places], names=["fkey", "fline", "n", "key", "at"])

    return repeats.mapInArrow(run, "fkey bigint, fline int, n int, key bigint, at array<int>")


def _bare(found: list[bytes]) -> list[bytes]:
    """Lines without the white space around them, which is how they are compared."""
    return list(map(bytes.strip, found))


def _first_texts(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """(fkey, fline, n, first): bare lines of each run's first occurrence, with cuts between. A text is read once for all its runs, and a run that many texts share is made once."""
    want = written(runs.select("fkey", "fline", "n").distinct().groupBy("fkey").agg(F.collect_list(F.struct("fline", "n")).alias("want")), "line-firsts")
    texts = _only(rows.select(F.col("key").alias("fkey"), "text"), want.select("fkey"), "fkey").dropDuplicates(["fkey"]).join(want, "fkey")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            inside, ends = lists.flatten(), np.cumsum(np.diff(lists.offsets.to_numpy())).tolist()
            flines, ns = (inside.field(c).to_pylist() for c in ("fline", "n"))
            first, start = [], 0
            for t, end in zip(b.column(1), ends):
                bare = _bare(lines(t.as_py()))
                first += [_CUT.join(bare[f : f + n]) for f, n in zip(flines[start:end], ns[start:end])]
                start = end
            keys = np.repeat(b.column(0).to_numpy(), np.diff(ends, prepend=0))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(flines, pa.int32()), pa.array(ns, pa.int32()), pa.array(first, pa.binary())], names=["fkey", "fline", "n", "first"])

    return texts.select("fkey", "text", "want").mapInArrow(run, "fkey bigint, fline int, n int, first binary")


def removed_lines(bare: list[bytes], matches: list[tuple[list[int], int, bytes]]) -> list[bool]:
    """Which lines go, given (lines where it starts, number of lines, lines of the first occurrence) of each run."""
    gone = [False] * len(bare)
    for at, n, first in matches:
        for a in at:
            if len(bare) >= a + n and _CUT.join(bare[a : a + n]) == first:
                gone[a : a + n] = [True] * n
    return gone


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None) -> DataFrame:
    """``docs`` with repeated passages taken out of the text; every row stays, with all its columns.

    Of every passage of LEAST_LINES wrapped lines and LEAST_WORDS words or more the first occurrence, by id and then
    position, stays and later ones go, but for lines they share with it. Lines are compared without
    the white space around them. A text that is repeated as a whole becomes empty. Null texts stay null,
    rows with a null id come first in the order, and rows that repeat both id and text are
    treated alike. Ids must be integers. Texts without a match are unchanged to the byte, and where
    the texts with one are few (see BROADCAST_ROWS), only those are shuffled.
    ``removed_col`` adds the number of code points that went.
    """
    rows = _keyed(docs, id_col, text_col)
    repeats, read = _repeats(written(_chunks(rows), "line-chunks"))
    runs = written(_runs(repeats), "line-runs")
    forget(*read)
    matches = runs.join(_first_texts(rows, runs), ["fkey", "fline", "n"]).groupBy("key").agg(F.collect_list(F.struct("at", "n", "first")).alias("__line_found"))
    matches = matches.withColumnRenamed("key", "__line_key")
    keys = runs.select(F.col("key").alias("__line_key")).distinct()
    names, at = docs.columns, docs.columns.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names with dots or in two cases are no obstacle then
    own = F.xxhash64(f"c{names.index(id_col)}", F.coalesce(F.col(f"c{at}").cast("string"), F.lit("")))
    keyed = plain.withColumn("__line_key", own)
    out_names = [*names, removed_col] if removed_col is not None else names
    lost = lambda df: df.withColumn("removed", F.lit(0).cast("bigint")) if removed_col is not None else df
    schema = lost(plain).schema

    def cleaned(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, gone_chars = b.column(at).to_pylist(), [0] * b.num_rows
        for i, found in enumerate(b.column(len(names)).to_pylist()):
            if found:
                kept = lines(texts[i].encode())
                gone = removed_lines(_bare(kept), [(m["at"], m["n"], m["first"]) for m in found])
                if any(gone):
                    left = b"".join(x for x, g in zip(kept, gone) if not g).decode()
                    gone_chars[i], texts[i] = len(texts[i]) - len(left), left
        cols = [b.column(j) if j != at else pa.array(texts, b.column(at).type) for j in range(len(names))]
        return pa.RecordBatch.from_arrays([*cols, pa.array(gone_chars, pa.int64())] if removed_col is not None else cols, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                yield cleaned(b.slice(i, SLICE))

    few = keys.count() <= BROADCAST_ROWS
    touched = keyed.join(F.broadcast(keys), "__line_key", "left_semi") if few else keyed
    both = touched.join(matches, "__line_key", "left").select(*plain.columns, "__line_found")
    out = both.mapInArrow(run, schema)
    if few:
        out = out.unionByName(lost(keyed.join(F.broadcast(keys), "__line_key", "left_anti").drop("__line_key")))
    return out.toDF(*out_names)
