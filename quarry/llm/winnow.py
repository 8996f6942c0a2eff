"""Document fingerprints by winnowing, in DataFrame functions only.

A text is a sequence of units: runs of letters and digits, runs of other signs,
and single characters of scripts written without spaces. Each K consecutive units are a gram with
a 33-bit hash; of every W consecutive grams the one of least hash is selected, the rightmost
of several. Two texts that share K + W - 1 units in a row share a selected gram there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.llm.common import pick

#: Units of a gram (five words), grams of a window.
K, W = 5, 4
#: Longest run that is one unit; longer ones are cut, so that a text without spaces has units too.
RUN = 24
#: Letters and digits up to U+0DFF, whose scripts part words; runs of ASCII signs; any other character alone.
UNITS = rf"[a-z0-9\u00AA-\u0DFF]{{1,{RUN}}}|[!-/:-@\[-`{{-~]{{1,{RUN}}}|[^\s\p{{Z}}]"
#: Bits of a gram's place within a window's key; its hash has the other 33 of 63. No text has more units: a string has less than 2 ** 31 bytes.
_PLACE = 30
#: Documents of a bucket of the order by id, and most buckets.
BUCKET, MOST_BUCKETS = 500, 65_536


def _window_least(name: str, w: int) -> list[tuple[int, str]]:
    """Shifts whose least values in turn give the least of w consecutive entries."""
    shifts, span = [], 1
    while 2 * span <= w:
        shifts.append(span)
        span *= 2
    if span < w:
        shifts.append(w - span)
    return [(s, f"{name}_{i}") for i, s in enumerate(shifts)]


def _least_with(a: Column, shift: int) -> Column:
    """Each entry, or the one ``shift`` after it if that is less."""
    return F.transform(a, lambda x, i: F.least(x, F.get(a, i + shift)))


def _turned(x: Column, by: int) -> Column:
    by %= 64
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by)) if by else x


def _joined(x: Column, i: Column, a: int, after: Column, b: int) -> Column:
    """Rolling hash of the a + b units from i on, from those of the first a, ``x``, and of b units anywhere, ``after``; nothing beyond the end."""
    return _turned(x, b).bitwiseXOR(F.coalesce(F.get(after, i + a), F.lit(0).cast("bigint")))


def winnow(df: DataFrame, text_col: str, out_col: str, k: int = K, w: int = W) -> DataFrame:
    """Add ``out_col`` array<struct<hash long, pos int>>: the selected grams in order of position, counted in units from 0.

    A gram's hash is a cyclic polynomial, the rolling hash that turns by a bit and exclusive-ors a unit at each step: hashes of one, two,
    four and so on units roll into longer ones, so neighbouring grams share their parts. A text of fewer than k units is one gram of all of
    them; one of fewer than w grams is one window. Null, empty and blank texts have no grams. Equal texts, and texts that differ in case or white space
    alone, have equal fingerprints. Other columns stay, whatever their names; repeated rows stay.
    """
    names = df.columns
    df = df.toDF(*[f"c{i}" for i in range(len(names))])
    keep, last = list(df.columns), (1 << _PLACE) - 1
    units = F.regexp_extract_all(F.lower(F.coalesce(F.col(f"c{names.index(text_col)}").cast("string"), F.lit(""))), F.lit(UNITS), F.lit(0))
    df = df.select(*keep, F.transform(units, lambda u: F.xxhash64(u)).alias("h1"))
    size, now = 1, "h1"  # now: hashes of size units each
    for bit in bin(k)[3:]:
        for more in (size, 1) if bit == "1" else (size,):
            after = now if more == size else "h1"
            df = df.select(*keep, "h1", F.transform(now, lambda x, i: _joined(x, i, size, F.col(after), more)).alias(f"h{size + more}"))
            size += more
            now = f"h{size}"
    h = F.col(now)
    key = lambda i: F.shiftleft(F.shiftrightunsigned(F.get(h, i), 64 - 63 + _PLACE), _PLACE).bitwiseOR((F.lit(last) - i).cast("bigint"))
    keys = F.when(F.size(h) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - k, F.lit(0))), key)).otherwise(F.array().cast("array<bigint>"))
    now = "m"
    df = df.select(*keep, keys.alias(now))
    for shift, name in _window_least("m", w):
        df = df.select(*keep, _least_with(F.col(now), shift).alias(name))
        now = name
    a = F.col(now)
    chosen = F.array_distinct(F.slice(a, F.lit(1), F.greatest(F.size(a) - (w - 1), F.least(F.size(a), F.lit(1)))))
    place = lambda x: (F.lit(last) - x.bitwiseAND(F.lit(last).cast("bigint"))).cast("int")
    return df.select(*keep, F.transform(chosen, lambda x: F.struct(F.shiftrightunsigned(x, _PLACE).alias("hash"), place(x).alias("pos"))).alias("out")).toDF(*names, out_col)


def as_text(fingerprint: Column) -> Column:
    """A fingerprint as a string: ``hash:pos`` in hex and decimal, separated by spaces."""
    return F.concat_ws(" ", F.transform(fingerprint, lambda x: F.concat(F.lower(F.hex(x["hash"])), F.lit(":"), x["pos"].cast("string"))))


def hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda x: x["hash"]))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of distinct hashes; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, next_text): the text of the document next by ascending id; the first one's after the last.

    Null texts count as empty. Rows that repeat an id follow each other by text. Rows
    with a null id have no place in the order: their next text is empty. Ids must be integers.
    The order is cut into buckets at approximate quantiles; each bucket is also sent the first
    document of the bucket after, so there is one shuffle, and no task has more than a bucket.
    """
    plain = pick(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = plain.select("doc_id").where(F.col("doc_id").isNotNull())
    n = ids.count()
    buckets = max(1, min(MOST_BUCKETS, n // BUCKET))
    bounds = []
    if buckets > 1:
        # parsed from a literal: percentile_approx takes only constants, which no function with a lambda is
        shares = F.from_json(F.lit("[" + ",".join(str(i / buckets) for i in range(1, buckets)) + "]"), "array<double>")
        bounds = sorted(set(ids.agg(F.percentile_approx("doc_id", shares, F.lit(max(10_000, 20 * buckets)))).first()[0]))
    steps = max(1, len(bounds)).bit_length()
    if bounds:
        at = F.array(*[F.lit(b).cast("bigint") for b in bounds]) if len(bounds) <= 64 else F.from_json(F.lit("[" + ",".join(map(str, bounds)) + "]"), "array<bigint>")
        # binary search: how many bounds are less than the id
        found = F.aggregate(
            F.sequence(F.lit(1), F.lit(steps)),
            F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")),
            lambda acc, _: F.when(acc["lo"] >= acc["hi"], acc).otherwise(
                F.when(F.get(at, F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")) < F.col("doc_id"), F.struct((F.floor((acc["lo"] + acc["hi"]) / 2).cast("int") + 1).alias("lo"), acc["hi"].alias("hi"))).otherwise(
                    F.struct(acc["lo"].alias("lo"), F.floor((acc["lo"] + acc["hi"]) / 2).cast("int").alias("hi"))
                )
            ),
            lambda acc: acc["lo"],
        )
    else:
        found = F.lit(0)
    bucket = F.when(F.col("doc_id").isNull(), F.lit(-1) - F.pmod(F.xxhash64("text"), F.lit(4096)).cast("int")).otherwise(found)  # without an id there is no order to keep
    firsts = ids.groupBy(found.alias("bucket")).agg(F.min("doc_id").alias("first")).orderBy("bucket").collect()  # a row for each bucket
    before = [(r["first"], firsts[i - 1]["bucket"]) for i, r in enumerate(firsts)]
    guests = F.broadcast(docs.sparkSession.createDataFrame(before, "first bigint, guest int"))
    rows = plain.withColumn("bucket", bucket).join(guests, F.col("doc_id") == F.col("first"), "left")
    places = F.when(F.col("guest").isNull(), F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("g")))).otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("g")), F.struct(F.col("guest").alias("b"), F.lit(True).alias("g"))))
    sent = rows.select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", F.col("p.b").alias("bucket"), F.col("p.g").alias("guest"))
    order = Window.partitionBy("bucket").orderBy("guest", "doc_id", "text")
    led = sent.withColumn("next_text", F.lead("text").over(order)).where(~F.col("guest"))
    return led.select("doc_id", "text", F.when(F.col("doc_id").isNull(), F.lit("")).otherwise(F.coalesce("next_text", F.lit(""))).alias("next_text"))


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The edited text has the last quarter of the code points replaced by the
    first as many, or all, of the next document's text. Fingerprints are arrays of selected grams.
    Null texts count as empty; two texts without grams are alike by 1, one with and one without by 0. Repeated rows keep a row each and follow each
    other; rows with a null id have an empty next text. Other columns are left out; no rows give no rows.
    """
    n = F.length("text")
    part = F.floor(F.col("n_chars") / 4).cast("int")
    rows = with_next(docs, id_col, text_col).withColumn("n_chars", n)
    rows = rows.withColumn("edited_text", F.concat(F.expr("substring(text, 1, n_chars - cast(floor(n_chars / 4) as int))"), F.when(part > 0, F.expr("substring(next_text, 1, cast(floor(n_chars / 4) as int))")).otherwise(F.lit(""))))
    rows = winnow(rows, "text", "fingerprint").drop("text")
    rows = winnow(rows, "next_text", "next_fingerprint").withColumn("next_hashes", hashes(F.col("next_fingerprint"))).drop("next_text", "next_fingerprint")
    rows = winnow(rows, "edited_text", "edited_fingerprint")
    rows = rows.withColumn("own_hashes", hashes(F.col("fingerprint"))).withColumn("edited_hashes", hashes(F.col("edited_fingerprint")))
    return rows.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_text", "fingerprint", "edited_fingerprint",
        likeness(F.col("own_hashes"), F.col("edited_hashes")).alias("near_edited"), likeness(F.col("own_hashes"), F.col("next_hashes")).alias("near_next"),
    )
