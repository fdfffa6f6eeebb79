"""Shared helpers: tables, scratch tables in the cluster's shared folder, gapless distributed ranks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship

_claimed: list = ["", None]


def claim(owner: str, clear: Callable[[], None] | None = None) -> None:
    """Say in a Python worker that ``owner`` works now: a worker serves many stages, and the caches of the last owner would stay beside the new ones."""
    if _claimed[0] != owner:
        if _claimed[1]:
            _claimed[1]()
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)
        _claimed[:] = [owner, clear]


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound the Arrow batches that Python workers hold, since a single text may be very long. A lower bound of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names, which driver and executors share.

    What is there is deleted when the application ends, unless ``discard`` or ``transient`` has done so before.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = "file://" + tempfile.mkdtemp(prefix="sluice-")
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top}/{tag}-{uuid.uuid4().hex}"
    _files(spark, path).deleteOnExit(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))
    return path


def _files(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(spark: SparkSession, path: str) -> None:
    _files(spark, path).delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)


_transient: list[list[str]] = []


@contextlib.contextmanager
def transient(spark: SparkSession) -> Iterator[None]:
    """Tables saved inside are deleted at the end, but for those saved with ``keep``."""
    _transient.append([])
    try:
        yield
    finally:
        for path in _transient.pop():
            discard(spark, path)


def saved(df: DataFrame, tag: str = "", at: str = "", keep: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it again."""
    spark = df.sparkSession
    path = at or scratch(spark, tag)
    if _transient and not keep:
        _transient[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salts(spark: SparkSession) -> int:
    return min(65536, max(16, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def with_rank(df: DataFrame, key: str, spread: Column, order: list, name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... without gaps in each value of ``key``.

    A key may hold most rows, so rows are numbered in (key, salt) groups, and the group's start
    comes from the counts of the salts before it. ``spread`` chooses the salt: it should differ between rows.
    """
    n = salts(df.sparkSession)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(n)))
    counts = salted.groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col(key).alias("_k"), F.col("_salt").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    own = salted.withColumn("_own", F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order)) - 1)
    joined = own.join(starts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_salt") == F.col("_s")))
    return joined.withColumn(name, (F.col("_start") + F.col("_own")).cast("long")).drop("_salt", "_k", "_s", "_start", "_own")
