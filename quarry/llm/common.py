"""Helpers shared by the training-data operators: table access and lineage cuts."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []


#: Bytes of an Arrow batch. Batches stand in memory several times over, in the JVM and in Python, for each running task.
BATCH_BYTES, DEFAULT_BATCH_BYTES = "8m", "67108864b"
_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task, such as a cache: one thing at a time, as workers serve many operators.

    The room of what goes is given back to the system, where it has a call for that.
    """
    if name not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass
        _KEPT[name] = make()
    return _KEPT[name]


def reachable(spark: SparkSession) -> None:
    """Bound Arrow batches, unless the session has a bound, and put the folder that holds this package on the path of Python workers started from now on.

    The path matters where the session began without it; on a cluster the folder must be there, or the package installed.
    Plans run after the call that makes them, so the bound stays.
    """
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound, None) in (None, DEFAULT_BATCH_BYTES):
        spark.conf.set(bound, BATCH_BYTES)
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and the master local, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", found)
        _WRITTEN.append((spark, found))
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    Unlike a local checkpoint the files survive lost executors; unlike
    ``checkpoint()`` they are columnar and compressed. They go at ``forget``, at ``release``, or when the driver
    process ends.
    """
    spark = df.sparkSession
    reachable(spark)
    path = f"{shared_dir(spark)}/quarry-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session or its JVM has gone first
        pass


def forget(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more, as what was made of them has been written itself."""
    paths = {p for t in tables if (p := getattr(t, "_quarry_path", None))}
    for item in [w for w in _WRITTEN if w[1] in paths]:
        _WRITTEN.remove(item)
        _delete(*item)


def release() -> None:
    """Delete what ``written`` has left in the shared folder."""
    while _WRITTEN:
        _delete(*_WRITTEN.pop())


atexit.register(release)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns of just these names; others go, those too whose names differ in case only."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{df.columns.index(n)}").alias(n) for n in names])


def fold_of(doc_id) -> F.Column:
    """crc32 of the id's decimal text modulo 5; fold 0 is held out from every fit. Null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
