"""Ranks, quantiles and metrics by blocks on skewed values, and the smaller operators, against plain versions."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from riskloom import config
from riskloom.functions import markup, urls
from riskloom.operators import modelling, profile, registration, vectors


def test_quantiles_of_skewed_values(spark):
    r = random.Random(1)
    rows = [("a", 7.0)] * 400 + [("a", r.gauss(0, 1)) for _ in range(300)] + [("b", float(k)) for k in range(5)] + [(None, r.random() * 1e9) for _ in range(101)] + [("c", None), ("d", 3.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {x.g: (x.q1, x.median, x.q3) for x in profile.quantiles(df, "g", "v", {"q1": 0.25, "median": 0.5, "q3": 0.75}).collect()}
    assert set(got) == {"a", "b", None, "d"}
    for g in got:
        own = sorted(v for k, v in rows if k == g and v is not None)
        for q, x in zip((0.25, 0.5, 0.75), got[g]):
            at = q * (len(own) - 1)
            lo, hi = own[int(at)], own[min(int(at) + 1, len(own) - 1)]
            assert x == pytest.approx(lo + (hi - lo) * (at - int(at)))
    whole = profile.class_distribution(df, "g", "v").collect()
    assert {x.g: x.n for x in whole} == {"a": 700, "b": 5, None: 101, "c": 1, "d": 1} and next(x for x in whole if x.g == "c").median is None
    assert profile.quantiles(df.limit(0), "g", "v", {"m": 0.5}).count() == 0
    filled = profile.imputed(df.select("v", F.col("g").alias("name")), ["v"], ["name"]).collect()
    middle = statistics.median(v for _, v in rows if v is not None)
    assert len(filled) == len(rows) and sorted(x.v for x in filled)[len(rows) // 2] == pytest.approx(middle) and all(x.name for x in filled)


def test_ranks_and_metrics(spark):
    r = random.Random(2)
    rows = [(k, "x" if k % 10 else None) for k in range(3000)]
    df = spark.createDataFrame(rows, "i long, y string")
    got = profile.ranked(df, "y", "i").collect()
    for y in ("x", None):
        own = [x for x in got if x.y == y]
        assert sorted(x["__rank"] for x in own) == list(range(1, len(own) + 1)) and {x["__size"] for x in own} == {len(own)}
    assert sorted(map(tuple, got)) == sorted(map(tuple, profile.ranked(df.repartition(5), "y", "i").collect()))
    scored = [(k, int(r.random() < 0.3), r.choice([0.5, 0.5, 0.5, round(r.random(), 3)])) for k in range(2000)]
    m = profile.metrics(spark.createDataFrame(scored, "i long, y int, s double"), F.col("y"), F.col("s")).first()
    pos, neg = [s for _, y, s in scored if y], [s for _, y, s in scored if not y]
    assert m.auc == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg), abs=1e-6)
    assert (m.tp, m.fp) == (sum(s >= 0.5 for s in pos), sum(s >= 0.5 for s in neg))
    plan = profile.metrics(df, F.lit(1), F.col("i"))._jdf.queryExecution().toString()
    assert plan.count("SinglePartition") <= 4  # of block sums and of one-row aggregates


def test_nearest_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 4)
    r = random.Random(3)
    rows = [(k, [r.gauss(0, 1) for _ in range(5)]) for k in range(40)] + [(40, None), (41, [0.0] * 5)]
    known = [(f"b{k}", [r.gauss(0, 1) for _ in range(5)]) for k in range(11)]
    got = vectors.nearest(spark.createDataFrame(rows, "i long, v array<double>"), "i", "v", spark.createDataFrame(known, "name string, w array<double>"), "name", "w", 3).collect()
    norm = lambda v: sum(x * x for x in v) ** 0.5
    for k, v in rows[:40]:
        want = sorted((-sum(a * b for a, b in zip(v, w)) / norm(v) / norm(w), n) for n, w in known)[:3]
        assert [(x.name, round(x.similarity, 9)) for x in sorted((x for x in got if x.i == k), key=lambda x: x.place)] == [(n, round(-s, 9)) for s, n in want]
    assert {x.similarity for x in got if x.i >= 40} == {0.0} and len(got) == 3 * len(rows)


def test_repeated_ids_are_rows_of_their_own_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, None)], "i long, v array<double>")
    known = spark.createDataFrame([("a", [1.0, 0.1]), ("b", [0.1, 1.0]), ("c", [-1.0, 0.0])], "name string, w array<double>")
    want = None
    for block in (1024, 2, 1):
        monkeypatch.setattr(vectors, "BLOCK", block)
        got = sorted((x.i, x.name, round(x.similarity, 9), x.place) for x in vectors.nearest(rows, "i", "v", known, "name", "w", 2).collect())
        assert len(got) == 8 and (want is None or got == want)
        want = got


def test_smaller_operators(spark):
    rows = spark.createDataFrame([("com",), ("zz",)], "tld string")
    assert {x.tld: x.risk for x in urls.with_suffix_risk(rows, "tld", spark.createDataFrame([("com", 0.1), ("tk", 1.0)], "tld string, risk double")).collect()} == {"com": 0.1, "zz": 1.0}
    one = spark.range(1)
    assert one.select(*[c.alias(k) for k, c in registration.bounded_counts(F.lit(30), F.lit(2)).items()]).first()[:] == (10, 2)
    df = one.select(F.lit(1).alias("a"), F.lit(None).cast("int").alias("b"), F.lit(3).alias("c"))
    kept, missing = modelling.known_columns(df, ["c", "z", "a", "c", "b"], ["b"])
    assert (kept.columns, missing) == (["c", "a"], ["z"])
    assert modelling.clean_names(["a b", "a-b", "a_b", "é"]) == ["a_b", "a_b_1", "a_b_2", "_"]
    train, test = modelling.encoded_alike(spark.createDataFrame([("x",)], "n string"), spark.createDataFrame([("new",)], "n string"), "n", ["x", "y"])
    assert train.columns == test.columns == ["n_x", "n_y"] and tuple(test.first()) == (0.0, 0.0)
    assert [(x.column, x.percent) for x in profile.worst_nulls(df).collect()] == [("b", 100.0)]
    cases = [("https://a.bank.test/", "/in", "bank.test", True, False, False), ("https://x.test/", "https://bank.test/p", "bank.test", True, True, False), ("https://x.test/", "mailto:a@b", "bank.test", True, True, None), ("https://x.test/", "/p", None, False, None, None), ("https://x.test/", None, "bank.test", True, True, None)]
    for page, action, official, *want in cases:
        got = one.select(*[c.alias(k) for k, c in modelling.mismatches(F.lit(page), F.lit(action).cast("string"), F.lit(official).cast("string")).items()]).first()
        assert list(got) == want, (page, action)
    url = F.lit("https://sso.example.test/login?validate=1")
    assert [one.select(urls.structure(url, F.lit("sso.example.test"), w)["sensitive_words"]).first()[0] for w in (config.SENSITIVE_WORDS, config.OFFLINE_SENSITIVE_WORDS)] == [1, 3]


def test_offline_reading_of_pages(spark):
    html = "<html><head><title> T  x </title><script>eval (1)</script><script> </script></head><body><p><b>a</b>b<template>no</template><svg><text>no</text></svg><form action=\"\"><input type='hidden'></form><p oncontextmenu='return false'>c  d</p><link rel='shortcut icon'></body>"
    rows = spark.createDataFrame([(html,), (None,), ("",)], "h string")
    got = rows.select(markup.offline_text(F.col("h")).alias("t"), *[c.alias(k) for k, c in markup.offline_scripts(F.col("h")).items()]).collect()
    assert tuple(got[0]) == ("T x a b c d", 1, 0, True, True, False, True, 1) and set(got[1]) == {None} and got[2].t == ""
    same = rows.limit(1).select(*[c.alias(k) for k, c in markup.content_hashes(F.col("h")).items()], *[c.alias(f"o_{k}") for k, c in markup.content_hashes(F.regexp_replace("h", "eval", "none")).items()]).first()
    assert same.content_hash == same.o_content_hash and same.body_hash == same.o_body_hash and same.raw_hash != same.o_raw_hash
