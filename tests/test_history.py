"""The keyed store and what observations find in it, against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from riskloom import config
from riskloom.operators import history, renewal
from riskloom.sources import verdicts
from riskloom.streaming import live

DAY = dt.datetime(2024, 1, 1)


def at(days):
    return DAY + dt.timedelta(days=days)


def entries(spark, rows):
    """url, verdict, days, order, version, deleted."""
    df = spark.createDataFrame([(u, v, at(d), n, x) for u, v, d, n, _, x in rows], "url string, verdict string, ts timestamp, n int, gone boolean")
    out = history.stamped(df, "url", "ts", 7).withColumn("deleted", F.col("gone")).drop("gone")
    versions = {n: w for _, _, _, n, w, _ in rows}
    return out.withColumn("cache_version", F.element_at(F.create_map(*[F.lit(x) for pair in versions.items() for x in pair]), F.col("n")))


def test_a_dead_entry_is_a_miss_whatever_stood_before(spark):
    rows = [
        ("overwritten", "MALICIOUS", 1, 1, 7, False), ("overwritten", "SAFE", 2, 2, 7, False),  # the safe one has expired by day 3.5
        ("deleted", "MALICIOUS", 3, 3, 7, False), ("deleted", None, 3.2, 4, 7, True),
        ("again", None, 3.2, 5, 7, True), ("again", "SAFE", 3.2, 6, 7, False), ("old", "MALICIOUS", 1, 7, 7, False), ("old", "SAFE", 3.4, 8, 6, False),
        ("kept", "MALICIOUS", 1, 9, 7, False), ("later", "SAFE", 3, 10, 7, False), ("later", "MALICIOUS", 4, 11, 7, False), (None, "SAFE", 3.1, 12, 7, False),
    ]
    found = history.latest(entries(spark, rows), "url", "ts", str(at(3.5)), "n", version=7).collect()
    assert {(r["url"], r["n"]) for r in found} == {("again", 6), ("kept", 9), ("later", 10), (None, 12)}


def test_expiry_is_at_the_instant(spark):
    rows = entries(spark, [("a", "SAFE", 1, 1, 7, False), ("b", "MALICIOUS", 1, 2, 7, False)])
    look = lambda now: {r["url"] for r in history.latest(rows, "url", "ts", str(now), "n", 7).collect()}
    assert look(at(2) - dt.timedelta(microseconds=1)) == {"a", "b"} and look(at(2)) == {"b"} and look(at(4)) == set()
    assert history.latest(rows.limit(0), "url", "ts", str(at(1)), "n").count() == 0


def plain_store(rows, now):
    out = {}
    for u, v, d, n, w, x in sorted(rows, key=lambda r: (r[2], r[3])):
        if d <= now:
            out[u] = (v, d, n, w, x)
    return {(u, n) for u, (v, d, n, w, x) in out.items() if not x and w == 7 and now - d < (3 if v == "MALICIOUS" else 1)}


def test_store_on_files_against_a_plain_one(spark, tmp_path):
    r, path = random.Random(4), str(tmp_path / "store")
    assert verdicts.look_up(spark, path, "ts", "n", str(at(1)), 7) is None and verdicts.compact(spark, path, "ts", "n", str(at(1))) is None
    rows, n, now = [], 0, 0.0
    for step in range(6):
        fresh = []
        for _ in range(60):
            n += 1
            when = round(now + r.random() * 0.5 - (2.0 if r.random() < 0.1 else 0), 3)  # some arrive late
            gone = r.random() < 0.2
            fresh.append((f"u{r.randrange(25)}", None if gone else r.choice(["SAFE", "MALICIOUS", "SUSPICIOUS"]), when, n, r.choice([7, 7, 7, 6]), gone))
        rows += fresh
        now += 0.5
        df = entries(spark, fresh)
        verdicts.put(df.where("NOT deleted"), path)
        verdicts.invalidate(df.where("deleted"), path, "ts", "n")
        if step in (2, 4):
            verdicts.compact(spark, path, "ts", "n", str(at(now)))
        got = verdicts.look_up(spark, path, "ts", "n", str(at(now)), 7)
        assert {(x["url"], x["n"]) for x in got.collect()} == plain_store(rows, now)
    keys = spark.createDataFrame([("u1",), ("u2",), ("nobody",)], "url string").select(history.cache_key(F.col("url")).alias("cache_key"))
    some = verdicts.look_up(spark, path, "ts", "n", str(at(now)), 7, keys)
    assert {(x["url"], x["n"]) for x in some.collect()} == {x for x in plain_store(rows, now) if x[0] in ("u1", "u2")}
    assert sorted(p.name.split("-")[0] for p in (tmp_path / "store").iterdir()).count("base") == 1


def test_unfinished_writes_are_not_read(spark, tmp_path):
    path = str(tmp_path / "store")
    verdicts.put(entries(spark, [("a", "SAFE", 1, 1, 7, False)]), path)
    verdicts.put(entries(spark, [("a", "MALICIOUS", 1.1, 2, 7, False)]), path)
    (tmp_path / "store" / "delta-2" / "_SUCCESS").unlink()
    assert [x["n"] for x in verdicts.look_up(spark, path, "ts", "n", str(at(1.5)), 7).collect()] == [1]
    assert verdicts.put(entries(spark, [("b", "SAFE", 1.2, 3, 7, False)]), path) == 3


def plain_fold(rows):
    """rows: key, time, order, keep, check, mark, always; one after the other."""
    held, out = {}, {}
    for k, t, n, keep, check, mark, always in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        found, e = "absent", held.get(k)
        if e and t - e[0] < e[1]:
            due = e[2] is not None and t - e[0] > e[2]
            found = "renewed" if e[4] else ("changed" if mark is None or mark != e[3] else "same") if due else "held"
        if found in ("absent", "renewed", "changed"):
            held[k] = (t, keep or 0, check, mark, always)
        out[n] = found
    return out


@pytest.mark.parametrize("seed", range(4))
def test_fold_against_a_plain_loop_with_a_hot_key_in_many_blocks(spark, seed):
    r, rows = random.Random(seed), []
    for n in range(500):
        k = r.choice([None, "a", "b"]) if r.random() < 0.4 else "hot"
        t = r.randrange(0, r.choice([50, 2000])) if seed % 3 else n * 3
        mark = r.choice(["h", "h", "h", "i", None]) if seed % 4 else "h"
        kind = r.choice("SMXNZ") if seed % 2 else r.choice("SSSSX")
        d = r.choice([20, 300]) if seed % 5 == 0 else 100
        rows.append((k, t, n, *{"S": (d, -1 if mark else None, mark, mark is None), "M": (3 * d, d if mark else None, mark, False), "X": (d, None, mark, False), "N": (None, None, mark, False), "Z": (d, None, mark, False)}[kind]))
    df = spark.createDataFrame(rows, "k string, t long, n int, keep long, check long, mark string, always boolean").withColumn("ts", F.timestamp_micros("t"))
    found = renewal.found(df, "k", "ts", "n", F.col("keep"), F.col("check"), F.col("mark"), F.col("always"), block=20)
    tasks = found.select("n", F.spark_partition_id().alias("p"), "k").collect()
    largest = max(sum(x["p"] == p for x in tasks if x["k"] == "hot") for p in {x["p"] for x in tasks})
    assert largest < 100 and {x["n"]: x["outcome"] for x in found.collect()} == plain_fold(rows)


def test_served_entries_age_from_when_they_were_written(spark):
    observed = lambda rows: spark.createDataFrame([(k, at(d), n, v, h) for n, (k, d, v, h) in enumerate(rows)], "k string, ts timestamp, n int, verdict string, html_hash string")
    half = [("a", d / 2, "SUSPICIOUS", None) for d in range(7)]  # every twelve hours
    twenty = [("b", d * 20 / 24, "MALICIOUS", None) for d in range(9)]  # expires after three days, however often it is read
    df = observed(half + twenty)
    actions = {r["n"]: r["action"] for r in history.revalidation(df, "k", "ts", "n").collect()}
    assert [actions[n] for n in range(7)] == ["scan", "serve"] * 3 + ["scan"]
    assert [actions[n] for n in range(7, 16)] == ["scan", "serve", "serve", "serve", "scan", "serve", "serve", "serve", "scan"]
    due = {r["n"]: r["lookup"] for r in history.lookup_due(df, "k", "ts", "n").collect()}
    assert [due[n] for n in range(7)] == [True, False, False, True, False, False, True]  # at exactly a day it is not due yet
    assert history.lookup_due(df.limit(0), "k", "ts", "n").count() == 0


def test_revalidation_on_a_stream_agrees_with_the_table(spark, tmp_path):
    r, rows = random.Random(9), []
    for n in range(300):
        rows.append((r.choice(["a", "b", "c"]), at(r.random() * 20), n, r.choice(["SAFE", "SAFE", "MALICIOUS", "SUSPICIOUS", None]), r.choice(["h", "h", "h", "i", None])))
    table = spark.createDataFrame(rows, "k string, ts timestamp, n int, verdict string, html_hash string")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    live.drain(live.revalidation(stream, "k", "ts", "n", "30 days"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {x["n"]: x["action"] for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {x["n"]: x["action"] for x in history.revalidation(table, "k", "ts", "n", block=30).collect()}
    assert got == want and len(set(want.values())) == 5 and config.TTL_SECONDS["MALICIOUS"] == 259200
