import random

import pytest
from pyspark.sql import functions as F

from riskloom.functions import urls
from riskloom.operators import brands, scan, suffix_rules

FILE = """// a comment
com
uk
co.uk // after a rule
*.ck
!www.ck
jp
*.kawasaki.jp
!city.kawasaki.jp
// ===BEGIN PRIVATE DOMAINS===
github.io
// ===END PRIVATE DOMAINS===
io
"""
GOLDEN = {
    "example.com": "example.com", "a.b.example.com": "example.com", "com": "com", "b.c.example.co.uk": "example.co.uk", "co.uk": "co.uk", "x.ck": "x.ck", "a.x.ck": "a.x.ck", "b.a.x.ck": "a.x.ck",
    "www.ck": "www.ck", "a.www.ck": "www.ck", "c.kawasaki.jp": "c.kawasaki.jp", "a.c.kawasaki.jp": "a.c.kawasaki.jp", "b.a.c.kawasaki.jp": "a.c.kawasaki.jp", "x.city.kawasaki.jp": "city.kawasaki.jp",
    "me.github.io": "github.io", "unlisted": "unlisted", "a.b.unlisted": "b.unlisted", "192.0.2.7": "192.0.2.7", "": "", None: None, "A.Example.COM.": "example.com",
}


def plain(host, rules):
    """Every rule tried on the host."""
    if host is None:
        return None
    host = host.lower().removesuffix(".")
    parts = host.split(".")
    if len(parts) == 4 and host.replace(".", "").isdigit():
        return host
    fits = []
    for r in rules:
        labels = r.lstrip("!").split(".")
        tail = parts[-len(labels) :]
        if len(parts) >= len(labels) and all(a in ("*", b) for a, b in zip(labels, tail)):
            fits.append((r.startswith("!"), len(labels) - r.startswith("!")))
    n = max(fits, default=(False, 1))[1]
    return ".".join(parts[-n - 1 :])


@pytest.fixture(scope="module")
def rules(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("rules") / "list.dat"
    path.write_text(FILE)
    return suffix_rules.read_rules(spark, str(path)).cache()


def test_golden_hosts(spark, rules):
    rows = spark.createDataFrame([(h, k, "clash") for k, h in enumerate(GOLDEN)], "host string, k int, suffix string")
    got = {r["host"]: r["registered"] for r in suffix_rules.with_registered(rows, "host", rules).collect()}
    held = suffix_rules.Rules(rules)
    assert got == GOLDEN and {h: held.of(h) for h in GOLDEN} == GOLDEN
    assert suffix_rules.with_registered(rows.limit(0), "host", rules).count() == 0 and "github.io" not in held.rules


def test_private_rules_are_read_if_asked_for(spark, tmp_path):
    (tmp_path / "l").write_text(FILE)
    assert suffix_rules.Rules(suffix_rules.read_rules(spark, str(tmp_path / "l"), private=True)).of("a.me.github.io") == "me.github.io"


def test_random_hosts_against_every_rule(spark):
    r = random.Random(2)
    labels = ["a", "b", "c", "d"]
    name = lambda n: ".".join(r.choice(labels) for _ in range(n))
    table = sorted({r.choice(["", "*.", "!"]) + name(r.randint(1, 3)) for _ in range(40)})
    hosts = [name(r.randint(1, 6)) for _ in range(3000)] + ["a.b"] * 2000  # one host has many rows
    rows = spark.createDataFrame([(k, h) for k, h in enumerate(hosts)], "k int, host string")
    df = spark.createDataFrame([(x,) for x in [*table, table[0], None, ""]], "rule string")
    got = {x["k"]: x["registered"] for x in suffix_rules.with_registered(rows, "host", df).collect()}
    held = suffix_rules.Rules(df)
    assert got == {k: plain(h, table) for k, h in enumerate(hosts)} and all(held.of(h) == plain(h, table) for h in set(hosts))
    lists = rows.select("k", held.column(F.when(F.col("k") % 7 > 0, F.array("host", F.lit(None).cast("string"), "host"))).alias("d")).collect()
    assert all(x["d"] == ([got[x["k"]], None, got[x["k"]]] if x["k"] % 7 else []) for x in lists)


def test_too_many_rules_are_refused(spark, monkeypatch):
    monkeypatch.setattr(suffix_rules, "MOST", 2)
    with pytest.raises(ValueError, match="with_registered"):
        suffix_rules.Rules(spark.createDataFrame([("a",), ("b",), ("c",)], "rule string"))


def test_rules_decide_in_structure_anchors_and_scan(spark, rules):
    held = suffix_rules.Rules(rules)
    url = F.lit("https://paypal-x.c.kawasaki.jp/login")
    one = spark.range(1).select(urls.structure(url, urls.host(url), own=F.lit("paypal-x.c.kawasaki.jp"))["prefix_suffix_hyphen"], urls.structure(url, urls.host(url))["prefix_suffix_hyphen"]).first()
    assert list(one) == [True, False]
    html = '<html><body><a href="https://a.example.co.uk/x">paypal</a> sign in <a href="/y">google</a></body></html>'
    pages = spark.createDataFrame([("https://m.c.kawasaki.jp/", html), ("https://m.c.kawasaki.jp/", None), (None, html)], "url string, html string")
    plain_, ruled = (scan.scan(pages, rules=x).collect() for x in (None, held))
    assert len(plain_) == len(ruled) == 3
    off = brands.anchors_off(F.array(F.struct(F.lit("https://a.c.kawasaki.jp/x").alias("href"), F.lit("paypal").alias("text"))), F.lit("h.test"), domains=held.column(F.array(F.lit("a.c.kawasaki.jp"))))
    assert spark.range(1).select(off.alias("o")).first()["o"][0]["domain"] == "a.c.kawasaki.jp"
