"""Posting lists as blocks of gaps in varint bytes, with a skip table.

Positions in a list come from counts of its pieces, which are ranges of PIECE ids, so that no task sorts a whole list.
Bytes are made and read a batch of rows at a time, by Arrow; all else is DataFrame functions. What the workers run refers to nothing of this package.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.functions.text import varint_length

BLOCK = 64
#: Bytes of a skip entry: first id and offset.
SKIP_BYTES = 8
#: Ids of a piece of a list, and of a range by which blocks are met with the ids looked for.
PIECE, REACH = 65_536, 4_096


def gaps(posts: DataFrame, parts: int | None = None) -> DataFrame:
    """(term, doc_id, tf, pos, block, gap): the gap to the document before within a block of BLOCK, 0 at its start.

    Each (term, doc_id) once, ``tf`` below 2 ** 31; no rows give no rows. Rows are sorted within pieces; only one row a piece is sorted by list. ``parts`` is into how many tasks
    the pieces are dealt; without it Spark's settings decide, whose number doesn't grow with the rows.
    """
    piece = F.floor(F.col("doc_id") / PIECE)
    # id within the piece and count in one number, as narrow rows are shuffled
    rows = posts.select("term", piece.alias("piece"), F.shiftleft(F.col("doc_id") - piece * PIECE, 31).bitwiseOR(F.col("tf").cast("long")).alias("at"))
    rows = rows.repartition(parts, "term", "piece") if parts else rows  # of the same columns below, so that one shuffle serves both
    doc_id = lambda at: F.col("piece") * PIECE + F.shiftright(at, 31)
    within, along = Window.partitionBy("term", "piece").orderBy("at"), Window.partitionBy("term").orderBy("piece")
    pieces = rows.groupBy("term", "piece").agg(F.count("*").alias("n"), F.max("at").alias("top"))
    pieces = pieces.select("term", "piece", (F.sum("n").over(along) - F.col("n")).alias("base"), F.lag(doc_id(F.col("top"))).over(along).alias("before")).where("base > 0")
    rows = rows.select("term", "piece", "at", (F.row_number().over(within) - 1).alias("k"), doc_id(F.lag("at").over(within)).alias("prior"))
    rows = rows.join(pieces, ["term", "piece"], "left")
    tf = F.col("at").bitwiseAND(F.lit(2**31 - 1)).cast(posts.schema["tf"].dataType)
    rows = rows.select("term", doc_id(F.col("at")).alias("doc_id"), tf.alias("tf"), (F.coalesce("base", F.lit(0)) + F.col("k")).alias("pos"), F.coalesce("prior", "before").alias("prior"))
    first = F.col("pos") % BLOCK == 0
    return rows.select("term", "doc_id", "tf", "pos", F.floor(F.col("pos") / BLOCK).cast("int").alias("block"), F.when(first, F.lit(0)).otherwise(F.col("doc_id") - F.col("prior")).cast("long").alias("gap"))


def decode(gap_rows: DataFrame) -> DataFrame:
    """(term, doc_id, tf) from gaps and each block's first id."""
    block = Window.partitionBy("term", "block")
    first = F.min("doc_id").over(block)
    return gap_rows.select("term", (F.sum("gap").over(block.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) + first).alias("doc_id"), "tf")


def block_bytes(gap_rows: DataFrame) -> DataFrame:
    """(term, block, first_doc, entries, bytes) of each block's varints."""
    size = varint_length(F.col("gap")) + varint_length(F.col("tf").cast("long"))
    return gap_rows.groupBy("term", "block").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("entries"), F.sum(size).alias("bytes"))


def skip_table(gap_rows: DataFrame) -> DataFrame:
    """(term, block, first_doc, offset): where each block's bytes begin in its list. Blocks are sorted by parts of BLOCK * BLOCK of them."""
    blocks = block_bytes(gap_rows).withColumn("part", F.floor(F.col("block") / (BLOCK * BLOCK)))
    along = Window.partitionBy("term").orderBy("part")
    parts = blocks.groupBy("term", "part").agg(F.sum("bytes").alias("n"))
    parts = parts.select("term", "part", (F.sum("n").over(along) - F.col("n")).alias("base")).where("base > 0")
    within = Window.partitionBy("term", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks.withColumn("k", F.coalesce(F.sum("bytes").over(within), F.lit(0))).join(parts, ["term", "part"], "left")
    return rows.select("term", "block", "first_doc", (F.coalesce("base", F.lit(0)) + F.col("k")).cast("long").alias("offset"))


def used_bytes(gap_rows: DataFrame) -> DataFrame:
    """(lists, blocks, bytes): one row for the whole index, skip entries included."""
    by_list = block_bytes(gap_rows).groupBy("term").agg(F.count("*").alias("blocks"), F.sum(F.col("bytes") + SKIP_BYTES).alias("bytes"))
    return by_list.agg(F.count("*").alias("lists"), F.coalesce(F.sum("blocks"), F.lit(0)).cast("long").alias("blocks"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))


def varint(value: Column) -> Column:
    """Hex digits of an unsigned value below 2 ** 35, 7 bits a byte, lowest first, the top bit set in all but the last."""
    size = varint_length(value)
    byte = lambda k: F.shiftright(value, 7 * k).bitwiseAND(F.lit(127)) + F.when(size > k + 1, F.lit(128)).otherwise(F.lit(0))
    return F.concat(*[F.when(size > k, F.lpad(F.hex(byte(k)), 2, "0")).otherwise(F.lit("")) for k in range(5)])


def encode(gap_rows: DataFrame) -> DataFrame:
    """(term, block, first_doc, entries, data binary): each block's gaps and counts as varints, by turns. Ids must lie within 2 ** 35 of the one before.

    Rows that follow one another in a task are encoded there, so that parts of blocks are shuffled, not rows.
    """
    block = BLOCK

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            term, (pos, doc, gap, tf) = b.column(0), (b.column(k).to_numpy() for k in range(1, 5))
            cut = np.ones(n, dtype=bool)
            cut[1:] = (pos[1:] != pos[:-1] + 1) | (pos[1:] % block == 0) | pc.not_equal(term.slice(1), term.slice(0, n - 1)).fill_null(True).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(cut)
            value = np.stack([gap, tf], axis=1).ravel()
            size = 1 + sum((value >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
            stop = np.cumsum(size)
            start, data = stop - size, np.empty(stop[-1], dtype=np.uint8)
            for k in range(5):
                long = np.flatnonzero(size > k)
                data[start[long] + k] = (value[long] >> 7 * k) & 127 | (size[long] > k + 1) * 128
            offsets = np.append(start[2 * at], stop[-1]).astype(np.int32)
            parts = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            columns = [term.take(pa.array(at)), pa.array(pos[at]), pa.array(doc[at]), pa.array(np.diff(at, append=n)), parts]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "pos", "first_doc", "entries", "data"])

    rows = gap_rows.select("term", *[F.col(c).cast("long").alias(c) for c in ("pos", "doc_id", "gap", "tf")])
    runs = rows.mapInArrow(run, "term string, pos long, first_doc long, entries long, data binary").withColumn("block", F.floor(F.col("pos") / BLOCK).cast("int"))
    found = [F.min("first_doc").alias("first_doc"), F.sum("entries").alias("entries"), F.array_sort(F.collect_list(F.struct("pos", "data"))).alias("e")]  # BLOCK parts at most
    whole = F.aggregate("e.data", F.lit(bytearray()), lambda acc, x: F.concat(acc, x))
    return runs.groupBy("term", "block").agg(*found).select("term", "block", "first_doc", "entries", whole.alias("data"))


def unpack(blocks: DataFrame) -> DataFrame:
    """(term, block, doc_id, tf) of encoded blocks, and further columns of theirs; each block is decoded on its own."""
    own = [c for c in blocks.columns if c not in ("first_doc", "entries", "data")]
    n_own = len(own)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            packed = b.column(n_own + 1).cast(pa.large_binary())
            bounds = np.frombuffer(packed.buffers()[1], dtype=np.int64)[packed.offset : packed.offset + len(packed) + 1] if len(packed) else np.zeros(1, dtype=np.int64)
            if bounds[-1] == bounds[0]:
                continue
            data = np.frombuffer(packed.buffers()[2], dtype=np.uint8)[bounds[0] : bounds[-1]]
            ends = np.flatnonzero(data < 128)
            starts = np.append(0, ends[:-1] + 1)
            place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
            value = np.add.reduceat((data & 127).astype(np.int64) << 7 * place, starts)
            gap, tf = value[0::2], value[1::2]
            entries = np.diff(np.searchsorted(ends, bounds - bounds[0])) // 2
            of, along = np.repeat(np.arange(len(entries)), entries), np.append(0, np.cumsum(gap))
            doc = b.column(n_own).to_numpy()[of] + along[1:] - along[np.cumsum(entries) - entries][of]
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(of)) for k in range(n_own)), pa.array(doc), pa.array(tf.astype(np.int32))], names=[*own, "doc_id", "tf"])

    kinds = ", ".join(f"`{c}` {blocks.schema[c].dataType.simpleString()}" for c in own)
    return blocks.select(*own, F.col("first_doc").cast("long"), "data").mapInArrow(run, f"{kinds}, doc_id long, tf int")


def find(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, doc_id, tf) of the rows (term, doc_id) of ``wanted`` that are in encoded lists.

    The skip entries lead each id to the one block that may hold it, and only such blocks are decoded. Blocks and
    ids meet by (term, range of REACH ids), so neither a long list nor many ids are one task.
    """
    along = Window.partitionBy("term", "part").orderBy("block")
    parts = blocks.select("term", "block", "first_doc", F.floor(F.col("block") / (BLOCK * BLOCK)).alias("part"))
    heads = parts.groupBy("term", "part").agg(F.min("first_doc").alias("head")).select("term", (F.col("part") - 1).alias("part"), "head")
    ends = parts.withColumn("next", F.lead("first_doc").over(along)).join(heads, ["term", "part"], "left")
    ends = ends.select("term", "block", "first_doc", (F.coalesce("next", "head") - 1).alias("last"))
    ask = wanted.select("term", "doc_id", F.floor(F.col("doc_id") / REACH).alias("range")).distinct()
    top = F.broadcast(ask.agg(F.coalesce(F.max("range"), F.lit(-1)).alias("top")))  # one row: a list's last block has no end of its own
    low, high = F.floor(F.col("first_doc") / REACH), F.least(F.coalesce(F.floor(F.col("last") / REACH), F.col("top")), F.col("top"))
    spans = ends.crossJoin(top).where(high >= low).select("term", "block", "first_doc", "last", F.explode(F.sequence(low, high)).alias("range"))
    led = ask.join(spans, ["term", "range"]).where((F.col("doc_id") >= F.col("first_doc")) & (F.col("last").isNull() | (F.col("doc_id") <= F.col("last")))).select("term", "block", F.col("doc_id").alias("id"))
    hit = unpack(blocks.join(led.select("term", "block").distinct(), ["term", "block"], "left_semi"))
    return hit.join(led.select("term", F.col("id").alias("doc_id")), ["term", "doc_id"]).select("term", "doc_id", "tf")


def merge(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """The same by decoding the lists of the words asked for whole, and merging."""
    words = wanted.select("term").distinct()
    return unpack(blocks.join(words, "term", "left_semi")).join(wanted.distinct().hint("merge"), ["term", "doc_id"]).select("term", "doc_id", "tf")
