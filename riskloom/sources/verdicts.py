"""S10, C2, C3, C9 on files: a store of verdicts that is written to, looked up and compacted.

A store is a folder.  Each write adds a folder ``delta-<number>``: entries, or invalidations, which are entries too (``deleted``).
``compact`` writes the last entry of each key to a folder ``base-<number>``, which stands for all numbers below.  A folder counts once its
writer has put ``_SUCCESS`` there, so readers see a write as a whole or not at all, and a lost job leaves nothing that is read.
Rows lie in buckets of their key: a look-up of some keys reads their buckets only, and compaction combines within buckets, a hot key's
entries before the shuffle.  Writers take numbers in turn; two at the same time must be kept apart by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import config
from riskloom.operators import history

BUCKETS = 16


def bucket(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _folders(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Numbers of the bases and deltas that are complete."""
    fs, top = _files(spark, path)
    out: dict[str, list[int]] = {"base": [], "delta": []}
    for f in fs.listStatus(top) if fs.exists(top) else []:
        kind, _, n = f.getPath().getName().partition("-")
        if kind in out and n.isdigit() and fs.exists(_files(spark, f"{path}/{kind}-{n}/_SUCCESS")[1]):
            out[kind].append(int(n))
    return out


def _next(spark: SparkSession, path: str) -> int:
    """Above all numbers that were ever given, those of unfinished writes too."""
    fs, top = _files(spark, path)
    names = [f.getPath().getName().partition("-") for f in fs.listStatus(top)] if fs.exists(top) else []
    return max([int(n) for _, _, n in names if n.isdigit()], default=0) + 1


def put(entries: DataFrame, path: str) -> int:
    """Adds entries as ``history.stamped`` makes them; the folder's number."""
    spark, n = entries.sparkSession, _next(entries.sparkSession, path)
    _write(entries, f"{path}/delta-{n}")
    return n


def _write(entries: DataFrame, path: str) -> None:
    """A bucket's rows are brought together, and split again where they are many, so that files are few and tasks even."""
    entries.withColumn("bucket", bucket(F.col("cache_key"))).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)


def invalidate(keys: DataFrame, path: str, ts: str, order: str) -> int:
    """Entries without content for these keys (``cache_key``, ``ts``, ``order``); a later look-up misses until something is written."""
    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in (("verdict", "string"), ("cache_version", "int"))]
    return put(keys.select("cache_key", ts, order, *nothing, F.lit(True).alias("deleted")), path)


def entries(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame | None:
    """All entries that may still count, or those of ``keys`` (``cache_key``); None: nothing has been written."""
    found = _folders(spark, path)
    base = max(found["base"], default=0)
    parts = [f"{path}/base-{base}"] * bool(base) + [f"{path}/delta-{n}" for n in sorted(found["delta"]) if n >= base]
    if not parts:
        return None
    rows = None
    for p in parts:
        part = spark.read.parquet(p)
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    if keys is not None:
        wanted = keys.select("cache_key").distinct().withColumn("bucket", bucket(F.col("cache_key")))
        rows = rows.join(wanted, ["bucket", "cache_key"], "left_semi")
    return rows.drop("bucket")


def look_up(spark: SparkSession, path: str, ts: str, order: str, now: str, version: int, keys: DataFrame | None = None) -> DataFrame | None:
    """The entries that a look-up returns at ``now``; keys that miss have no row."""
    rows = entries(spark, path, keys)
    return None if rows is None else history.latest(rows, "cache_key", ts, now, order, version)


def compact(spark: SparkSession, path: str, ts: str, order: str, now: str) -> int | None:
    """Writes a base with one entry a key up to ``now``, and removes what it stands for; look-ups at earlier times are no longer possible.

    An entry that is deleted or expired goes only when anything older has expired as well, so a write that arrives late can't bring
    back what an invalidation had ended.
    """
    rows, n = entries(spark, path), _next(spark, path)
    if rows is None:
        return None
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    last = history.last_entries(rows, "cache_key", ts, order, now).where(age < max(config.TTL_SECONDS.values()) * 1_000_000)
    last = last.unionByName(rows.where(F.col(ts) > F.lit(now).cast("timestamp")))
    _write(last, f"{path}/base-{n}")
    found, fs = _folders(spark, path), _files(spark, path)[0]
    for kind, numbers in found.items():
        for k in numbers:
            if k < n:
                fs.delete(_files(spark, f"{path}/{kind}-{k}")[1], True)
    return n
