"""Keyed verdict history: expiry, last entries, revalidation and rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import config
from riskloom.operators import renewal


def ttl(verdict: Column) -> Column:
    """Seconds that an entry stays."""
    return F.when(verdict == "MALICIOUS", config.TTL_SECONDS["MALICIOUS"]).otherwise(config.TTL_SECONDS["other"])


def cache_key(url: Column) -> Column:
    """Key of an address in the store."""
    return F.sha2(F.concat(F.lit("scan:"), url), 256)


def stamped(results: DataFrame, url: str, ts: str, version: int) -> DataFrame:
    """Results as entries of the keyed store: key, when they expire, the version of the features they hold, and that they stand."""
    return results.withColumns({"cache_key": cache_key(F.col(url)), "expires": (F.col(ts).cast("timestamp") + F.make_dt_interval(secs=ttl(F.col("verdict")))), "cache_version": F.lit(version), "deleted": F.lit(False)})


def of_version(entries: DataFrame, version: int) -> DataFrame:
    """Entries whose features have the shape of this version; others, and those without one, count as absent."""
    return entries.where(F.col("cache_version") == version)


def last_entries(entries: DataFrame, key: str, ts: str, order: str, now: str | None = None) -> DataFrame:
    """The last entry of each key, whatever it is: a write takes the place of the one before, and so does an invalidation.

    Of entries at one instant the greater ``order`` is the last.  max_by combines before the shuffle, so a hot key sends one row a task.
    A row without a time is no entry.  Null keys are one key.
    """
    rest = [c for c in entries.columns if c != key]
    seen = entries.where(F.col(ts).isNotNull() if now is None else F.col(ts) <= F.lit(now).cast("timestamp"))
    return seen.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(ts, order)).alias("__last")).select(key, *[F.col("__last")[c].alias(c) for c in rest])


def standing(last: DataFrame, ts: str, now: str, version: int | None = None) -> DataFrame:
    """Of last entries, those that a look-up at ``now`` returns: neither deleted, nor of another version, nor expired.

    ``deleted`` and ``cache_version`` are looked at where the table has them; a null verdict expires like any but MALICIOUS.
    """
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    good = age < F.coalesce(ttl(F.col("verdict")), F.lit(config.TTL_SECONDS["other"])).cast("long") * 1_000_000
    if "deleted" in last.columns:
        good &= ~F.coalesce(F.col("deleted"), F.lit(False))
    if version is not None:
        good &= F.coalesce(F.col("cache_version") == version, F.lit(False))
    return last.where(good)


def latest(entries: DataFrame, key: str, ts: str, now: str, order: str, version: int | None = None) -> DataFrame:
    """What a look-up of every key returns at ``now``; the last entry decides, and if it doesn't stand, the look-up is a miss."""
    return standing(last_entries(entries, key, ts, order, now), ts, now, version)


def rate_limited(requests: DataFrame, key: str, ts: str, most: int = 60, window: str = "1 minute") -> DataFrame:
    """Requests by key and fixed window, how many pass and how many don't."""
    counts = requests.groupBy(key, F.window(ts, window).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(key, F.col("w.start").alias("window_start"), "n", F.least("n", F.lit(most)).alias("allowed"), F.greatest(F.col("n") - most, F.lit(0)).alias("rejected"))


def newest(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The newest rows; a top-k plan, no global sort."""
    return rows.orderBy(*order).limit(most)


def window_stats(results: DataFrame, ts: str, verdict: str, value: str, window: str) -> DataFrame:
    """Results and mean of a value by window and verdict; on a stream, after a watermark."""
    by = results.groupBy(F.window(ts, window).alias("w"), verdict).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"))
    return by.select(F.col("w.start").alias("window_start"), verdict, "n", "mean")


def revalidation(entries: DataFrame, key: str, ts: str, order: str, block: int = renewal.BLOCK) -> DataFrame:
    """What to do at each observation, given what was written under its key.

    A scan or rescan writes the observation's ``verdict`` and ``html_hash``; one that is served writes nothing, so entries age from their
    writing.  A null verdict is a scan that failed, which writes nothing; a null hash can't be verified and counts as changed.
    """
    verdict, hashed = F.col("verdict"), F.col("html_hash").isNotNull()
    known = renewal.found(
        entries, key, ts, order,
        keep=F.when(verdict.isNotNull(), ttl(verdict).cast("long") * 1_000_000),
        check=F.when((verdict == "SAFE") & hashed, F.lit(-1)).when((verdict == "MALICIOUS") & hashed, F.lit(config.REVERIFY_SECONDS * 1_000_000)),
        mark=F.col("html_hash"), always=(verdict == "SAFE") & ~hashed, out="action", block=block,
    )
    says = {"absent": "scan", "renewed": "rescan", "changed": "invalidate_rescan", "same": "recheck_serve", "held": "serve"}
    return known.withColumn("action", F.element_at(F.create_map(*[F.lit(x) for pair in says.items() for x in pair]), F.col("action")))


def lookup_due(rows: DataFrame, key: str, ts: str, order: str, seconds: int = 86400, block: int = renewal.BLOCK) -> DataFrame:
    """Adds ``lookup``: whether a row's key was never looked up, or longer ago than ``seconds``; only a look-up starts the time anew."""
    known = renewal.found(rows, key, ts, order, keep=F.lit(seconds * 1_000_000 + 1), out="lookup", block=block)
    return known.withColumn("lookup", F.col("lookup") == "absent")
