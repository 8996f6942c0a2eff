"""Tokenizer and scalar functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A word is a maximal run of characters with the Unicode properties Alphabetic or Numeric.
WORD = r"[\p{IsAlphabetic}\p{N}]+"


def _text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def tokens(text: Column | str) -> Column:
    """Words in order with repeats, lower-cased after the split; null text has none."""
    return F.transform(F.regexp_extract_all(_text(text), F.lit(WORD), F.lit(0)), lambda w: F.lower(w))


def query_terms(query: Column | str) -> Column:
    """Distinct words of a query in byte order."""
    return F.array_sort(F.array_distinct(tokens(query)))


def token_stream(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, term): every word with its place from 0."""
    return docs.select(F.col(id_col), F.posexplode(tokens(text_col)).alias("pos", "term"))


def varint_length(value: Column) -> Column:
    """Bytes of an unsigned value of 7 bits a byte."""
    out = F.lit(5)
    for n in (4, 3, 2, 1):
        out = F.when(value < (1 << (7 * n)), F.lit(n)).otherwise(out)
    return out


def grouped_digits(n: Column) -> Column:
    return F.format_number(n, 0)


def human_bytes(n: Column) -> Column:
    """B, KB, MB or GB in steps of 1024; one decimal but for bytes."""
    out = F.format_string("%.1f GB", n / float(1 << 30))
    for unit, shift in (("MB", 20), ("KB", 10)):
        out = F.when(n < (1 << (shift + 10)), F.format_string(f"%.1f {unit}", n / float(1 << shift))).otherwise(out)
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).otherwise(out)


def micros(ns: Column) -> Column:
    return F.format_string("%.2f µs", ns / 1000.0)
