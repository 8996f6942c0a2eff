"""Loading corpora: tab-separated lines, directories of text files, and Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def numbered(rows: DataFrame, order: list) -> DataFrame:
    """Dense ids from 0 in the given order: counts by part of the order first, so no task has all rows."""
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    counts = spread.groupBy("part").agg(F.count("*").alias("n"))
    base = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = Window.partitionBy("part").orderBy(*order)
    return spread.withColumn("k", F.row_number().over(own) - 1).join(F.broadcast(base), "part").withColumn("doc_id", (F.col("base") + F.col("k")).cast("long"))


def from_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, name, text) of lines ``title<TAB>body``, numbered in file order from 0.

    The first tab splits; lines without one are left out before numbering; empty
    titles and bodies are documents. One carriage return at the end of a line goes, others stay.
    Invalid UTF-8 fails the load. Files are read in splits that end at line ends.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row")
    )
    line = F.regexp_replace(F.validate_utf8("value"), "\r$", "")
    kept = lines.select("file", "at", "row", line.alias("line")).where(F.instr("line", "\t") > 0)
    cut = F.instr("line", "\t")
    rows = kept.select("file", "at", "row", F.substring_index("line", "\t", 1).alias("name"), F.col("line").substr(cut + 1, F.length("line")).alias("text"))
    return numbered(rows, ["file", "at", "row"]).select("doc_id", "name", "text")


def _hidden(spark: SparkSession, path: str) -> list[str]:
    """Paths of a directory's text files that the reader leaves out as hidden, from the names alone."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    names = [(s.getPath().toString(), s.getPath().getName()) for s in found if s.isFile()]
    return [p for p, n in names if n[0] in "._" and n.endswith(".txt") and len(n) > 4]


def from_directory(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, name, text) of the files with the extension ``txt`` right in a directory, one document each, by path.

    Names that begin with a dot or an underscore count, but for ``.txt``, which has no extension. Invalid UTF-8 fails the load.
    """
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=False)
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))  # percent signs only
    rows = files.select(name.alias("name"), F.validate_utf8("value").alias("text"))
    hidden = _hidden(spark, path)
    if hidden:

        def read(batches):
            from pyarrow import fs

            for b in batches:
                texts = []
                for p in b["path"]:
                    files, at = fs.FileSystem.from_uri(p.replace("file:/", "file:///", 1) if p.startswith("file:/") and not p.startswith("file://") else p)
                    with files.open_input_stream(at) as f:
                        texts.append(f.read().decode("utf-8"))
                yield b.assign(text=texts)[["name", "text"]]

        listed = spark.createDataFrame([(p, p.rsplit("/", 1)[1]) for p in hidden], "path string, name string")
        rows = rows.unionByName(listed.mapInPandas(read, "name string, text string"))
    return numbered(rows, ["name"]).select("doc_id", "name", "text")


def from_table(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, name, text) of a Parquet table that has ids of its own."""
    docs = spark.read.parquet(path)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.concat(F.lit("d"), F.col(id_col).cast("string")).alias("name"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def from_rows(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, name, text) of (name, text) pairs, numbered in order."""
    return spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(rows)], "doc_id long, name string, text string")


def load(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: ``.tsv`` lines, ``.parquet`` a table, anything else a directory of text files."""
    if path.rstrip("/").endswith(".tsv"):
        return from_tsv(spark, path)
    if path.rstrip("/").endswith(".parquet"):
        return from_table(spark, path)
    return from_directory(spark, path)
