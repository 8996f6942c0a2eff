"""The inverted index as DataFrames: build, statistics, save, load and append."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.functions.text import tokens
from quarry.storage import delete


def spread(docs: DataFrame) -> DataFrame:
    """Documents over all cores, where they come in fewer partitions, as a file of one row group does."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def counted(docs: DataFrame, only: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", name_col: str | None = None) -> DataFrame:
    """(doc_id, name, len, runs array<struct<term, tf>>): each document's distinct words in order, ``len`` being all its words.

    Words are counted inside the row, by runs of the sorted words, so there is no shuffle. ``only`` keeps these words alone, before the sort.
    """
    name = F.col(name_col) if name_col else F.concat(F.lit("d"), F.col(id_col).cast("string"))
    words = docs.select(F.col(id_col).alias("doc_id"), name.alias("name"), tokens(text_col).alias("w"))
    some = F.col("w") if only is None else F.filter("w", lambda x: x.isin(only) if only else F.lit(False))
    words = words.select("doc_id", "name", F.size("w").alias("len"), F.sort_array(some).alias("s"))
    first = F.filter(F.sequence(F.lit(0), F.greatest(F.size("s") - 1, F.lit(0))), lambda i: (i < F.size("s")) & ((i == 0) | (F.get("s", i) != F.get("s", i - 1))))
    words = words.select("doc_id", "name", "len", "s", first.alias("f"))
    runs = F.transform("f", lambda i, j: F.struct(F.get("s", i).alias("term"), (F.coalesce(F.get("f", j + 1), F.size("s")) - i).alias("tf")))
    return words.select("doc_id", "name", "len", runs.alias("runs"))


def listed(rows: DataFrame) -> DataFrame:
    """(term, doc_id, tf, len) of counted documents."""
    # outer, as for an inner one the optimizer would count all words a second time to leave out documents without any
    return rows.select("doc_id", "len", F.inline_outer("runs")).where("term IS NOT NULL").select("term", "doc_id", "tf", "len")


def save_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, len, runs, words) of (doc_id, text), saved: what lists are made from, ``words`` being the distinct ones. No shuffle of rows."""
    counted(spread(docs.select("doc_id", "text"))).select("doc_id", "len", "runs", F.size("runs").alias("words")).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def postings(docs: DataFrame, only: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, doc_id, tf, len): one row for each distinct word of a document, ``len`` being the document's words. No shuffle."""
    return listed(counted(docs, only, id_col, text_col))


def doc_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_col: str | None = None) -> DataFrame:
    """(doc_id, name, len) of every document, those without words too."""
    name = F.col(name_col) if name_col else F.concat(F.lit("d"), F.col(id_col).cast("string"))
    return docs.select(F.col(id_col).alias("doc_id"), name.alias("name"), F.size(tokens(text_col)).alias("len"))


def term_stats(posts: DataFrame) -> DataFrame:
    """(term, df): documents that have the word."""
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def save_terms(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(term, df) of documents, saved. Each task counts the distinct words of its texts before the shuffle; no lists are made."""
    words = spread(docs.select(text_col)).select(F.explode_outer(F.array_distinct(tokens(text_col))).alias("term")).where("term IS NOT NULL")
    term_stats(words).write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path)


@dataclass(frozen=True)
class TextIndex:
    """Postings, document and term statistics, one row of sizes (n_docs, total_len, avg_len), and one of all corpus statistics."""

    postings: DataFrame
    docs: DataFrame
    terms: DataFrame
    sizes: DataFrame
    corpus: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, only: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", name_col: str | None = None) -> TextIndex:
        """Index documents lazily: what is read of it is made from the texts. With ``only`` an index of these words alone: documents and lengths are
        whole, so scores are too, while terms and postings, and their numbers, are of these words."""
        posts, stats = postings(docs, only, id_col, text_col), doc_stats(docs, id_col, text_col, name_col)
        terms, sizes = term_stats(posts), doc_sizes(stats)
        return cls(posts, stats, terms, sizes, corpus_stats(sizes, terms))

    @classmethod
    def create(cls, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", name_col: str | None = None, only: list[str] | None = None) -> TextIndex:
        """Index documents and save: texts are tokenized once, and everything else is made from the counts that this writes. ``only`` is that of ``build``."""
        spark, rough = docs.sparkSession, f"{path}/_counted"
        counted(spread(docs.select(*dict.fromkeys([id_col, text_col, *([name_col] if name_col else [])]))), only, id_col, text_col, name_col).write.mode("overwrite").parquet(rough)
        rows = spark.read.parquet(rough)
        out = cls._save(spark, rows.select("doc_id", "name", "len"), listed(rows), path, None)
        delete(spark, rough)
        return out

    def save(self, path: str, files: int | None = None) -> TextIndex:
        """Write the index: postings ranged and sorted by (term, doc_id), so that a word's rows lie in few row groups."""
        return self._save(self.postings.sparkSession, self.docs, self.postings, path, files)

    @classmethod
    def _save(cls, spark: SparkSession, docs: DataFrame, posts: DataFrame, path: str, files: int | None) -> TextIndex:
        docs.write.mode("overwrite").parquet(f"{path}/docs")
        ranged = posts.repartitionByRange(files, "term", "doc_id") if files else posts.repartitionByRange("term", "doc_id")
        ranged.sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        terms = term_stats(spark.read.parquet(f"{path}/postings"))
        terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        doc_sizes(spark.read.parquet(f"{path}/docs")).coalesce(1).write.mode("overwrite").parquet(f"{path}/sizes")
        corpus_stats(spark.read.parquet(f"{path}/sizes"), spark.read.parquet(f"{path}/terms")).coalesce(1).write.mode("overwrite").parquet(f"{path}/corpus")
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextIndex:
        return cls(*(spark.read.parquet(f"{path}/{k}") for k in ("postings", "docs", "terms", "sizes", "corpus")))

    def append(self, other: TextIndex) -> TextIndex:
        """This index and one of further documents with ids of their own; statistics are merged, not recounted."""
        terms = self.terms.unionByName(other.terms).groupBy("term").agg(F.sum("df").cast("long").alias("df"))
        both = self.sizes.unionByName(other.sizes).agg(*[F.sum(c).cast("long").alias(c) for c in ("n_docs", "total_len")])
        sizes = both.select("n_docs", "total_len", average(F.col("total_len"), F.col("n_docs")).alias("avg_len"))
        return TextIndex(self.postings.unionByName(other.postings), self.docs.unionByName(other.docs), terms, sizes, corpus_stats(sizes, terms))

    def lookup(self, term: str) -> DataFrame:
        """(doc_id, tf) of one word, already lower-cased; the filter reaches the scan of a saved index."""
        return self.postings.where(F.col("term") == term).select("doc_id", "tf")

    def tf_for(self, term: str, ids: DataFrame) -> DataFrame:
        """(doc_id, tf) of the given documents that have the word."""
        return self.lookup(term).join(ids, "doc_id")


def average(total, n):
    return F.when(n > 0, total / n).otherwise(F.lit(0.0))


def doc_sizes(stats: DataFrame) -> DataFrame:
    """One row: n_docs, total_len, avg_len."""
    lens = stats.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("len"), F.lit(0)).cast("long").alias("total_len"))
    return lens.select("n_docs", "total_len", average(F.col("total_len"), F.col("n_docs")).alias("avg_len"))


def corpus_stats(sizes: DataFrame, terms: DataFrame) -> DataFrame:
    """One row: n_docs, total_len, avg_len, n_terms, n_postings."""
    counts = terms.agg(F.count("*").alias("n_terms"), F.coalesce(F.sum("df"), F.lit(0)).cast("long").alias("n_postings"))
    return sizes.crossJoin(counts).select("n_docs", "total_len", "avg_len", "n_terms", "n_postings")
