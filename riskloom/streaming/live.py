"""The batch operators on streams: late rows wait as long as the watermark says, and state older than it is dropped."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from riskloom import config
from riskloom.operators import history


def rate_limited(events: DataFrame, key: str, ts: str, limit: int, window: str, late: str) -> DataFrame:
    """C7 on a stream: requests allowed and rejected of each key and window."""
    return history.rate_limited(events.withWatermark(ts, late), key, ts, limit, window)


def first_seen(events: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """One row of those that repeat the keys within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def drain(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Writes what is there to Parquet, exactly once over restarts, and stops."""
    rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def revalidation(observations: DataFrame, key: str, ts: str, order: str, late: str) -> DataFrame:
    """C2, C3, C5 and C6 on a stream: what to do at each observation (``key``, ``ts``, ``order``, ``verdict``, ``html_hash``), given the entry written last under its key.

    Only that entry is kept: a scan or rescan puts a new one in its place, serving leaves it as it is, and it is dropped when it has
    expired by the watermark, so state follows the live keys.  A null verdict is a scan that failed and leaves no entry.  Rows of a
    trigger are taken in order of time; one older than the entry kept for its key is judged, but writes nothing.  The source's bound on a trigger's size bounds what a key brings to a task at once.  Null keys are one key.
    """
    columns = [key, ts, order, "verdict", "html_hash"]
    kinds = {f.name: f.dataType for f in observations.schema.fields}
    seconds, other = config.TTL_SECONDS["MALICIOUS"], config.TTL_SECONDS["other"]
    day = config.REVERIFY_SECONDS
    micros = lambda at: at.astype("datetime64[us]").astype("int64")

    def act(before, seen, at) -> str:
        if before is None:
            return "scan"
        verdict, held, then = before
        age = at - then
        if age >= (seconds if verdict == "MALICIOUS" else other) * 1_000_000:
            return "scan"
        if verdict == "SAFE" and held is None:
            return "rescan"
        if verdict == "SAFE" or (verdict == "MALICIOUS" and held is not None and age > day * 1_000_000):
            return "recheck_serve" if held == seen else "invalidate_rescan"
        return "serve"

    def step(keys, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        before = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values([ts, order])
        actions = []
        for verdict, held, at in zip(rows["verdict"], rows["html_hash"], micros(rows[ts])):
            verdict, held = (None if pd.isna(v) else v for v in (verdict, held))
            actions.append(act(before, held, at))
            if actions[-1] in ("scan", "rescan", "invalidate_rescan") and (before is None or at >= before[2]):
                before = None if verdict is None else (verdict, held, int(at))
        if before is None:
            if state.exists:
                state.remove()
        else:
            state.update(before)
            expires = before[2] // 1000 + (seconds if before[0] == "MALICIOUS" else other) * 1000
            state.setTimeoutTimestamp(max(expires, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({order: rows[order].to_numpy(), "action": actions})

    known = observations.select(*columns).withWatermark(ts, late).groupBy(key)
    return known.applyInPandasWithState(step, f"`{order}` {kinds[order].simpleString()}, action string", "verdict string, html_hash string, at long", "append", "EventTimeTimeout")
