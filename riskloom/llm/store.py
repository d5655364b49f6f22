"""Tables written to the folder that driver and executors share, to cut lineage in a way that survives lost executors."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch at most; texts make batches large, and each task holds two.
BATCH_ROWS = 1000
#: Rows and bytes of a batch where the bytes are limited, so that narrow rows come in larger batches than texts.
WIDE_ROWS, BATCH_BYTES = 1 << 14, 2 << 20
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the cluster names it; only where that is unset, a folder of our own, which needs a local master:
    executors elsewhere would write to their own disks and rows would be lost."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(folder, "own"):
        folder.own = "file://" + tempfile.mkdtemp(prefix="riskloom-")
    return folder.own


_written: list[str] = []


def tidy(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of jobs that nothing refers to any more; it notices that only when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


#: Spark removes a query's shuffle files as soon as it ends.
_LET_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def put(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet under a fresh name and returns it as read back; the shuffle files of the write are gone when it ends."""
    spark = df.sparkSession
    lean(spark)
    tidy(spark)
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_LET_GO)
    spark.conf.set(_LET_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_LET_GO, before)
    _written.append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._riskloom_path = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _written:
        _written.remove(path)


def drop(*tables: DataFrame) -> None:
    """Removes tables that put() wrote and that nothing needs any more."""
    for df in tables:
        path = getattr(df, "_riskloom_path", None)
        if path:
            _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Removes all tables of this process that are still there.  Results read from them, so call it once those are written or gone."""
    for path in list(_written):
        _delete(spark, path)


#: Bits of a sieve at most (4 MB).
SIEVE_BITS = 1 << 25


def sieve(rows: DataFrame, column: str, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows whose ``column`` may be among the ids: a filter in front of a join, so that of a large table only what the join needs is shuffled.

    A bit map of hashes goes to all tasks, 16 bits an id and SIEVE_BITS at most, whatever the number of ids: with more of them it lets more rows
    pass, never fewer than the join needs.
    """
    count = ids.count()
    bits = min(SIEVE_BITS, 1 << max(16, (16 * count).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    at = ids.select(place(F.col(id_col).cast("long")).alias("at"))
    words = at.groupBy(F.shiftrightunsigned("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 31 AS INT))")).alias("bits")).toArrow()
    held = np.zeros(bits >> 5, np.uint32)
    held[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)

    def run(at: pa.Array) -> pa.Array:
        x = at.fill_null(0).to_numpy(zero_copy_only=False)
        return pa.array((held[x >> 5] >> (x & 31).astype(np.uint32)) & 1 == 1)

    return rows.where(F.arrow_udf(run, "boolean")(place(F.col(column).cast("long"))))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lean(spark: SparkSession) -> None:
    """Makes the session's Arrow batches small enough for long texts."""
    now = int(spark.conf.get(_ROWS))
    if not 0 < now <= BATCH_ROWS and spark.conf.get(_BYTES) != str(BATCH_BYTES):
        spark.conf.set(_ROWS, BATCH_ROWS)


@contextmanager
def by_bytes(spark: SparkSession) -> Iterator[None]:
    """Jobs within have Arrow batches of BATCH_BYTES at most, and of more rows."""
    before = {k: spark.conf.get(k) for k in (_ROWS, _BYTES)}
    spark.conf.set(_BYTES, str(BATCH_BYTES))
    spark.conf.set(_ROWS, WIDE_ROWS)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
