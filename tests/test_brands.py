"""Brand layers against plain versions over thousands of made-up rows, and golden rows worked by hand."""

import random
import re

import pytest
from pyspark.sql import functions as F

from riskloom.functions import phonetic, urls
from riskloom.operators import brands, scan

CAT = brands.CATALOGUE
NAMES = sorted(CAT)


def variants(b):
    return [v for v in (b, *CAT[b][1]) if len(v) >= 3]


def named(text):
    return [b for b in NAMES if any(re.search(rf"(?<![A-Za-z0-9_]){re.escape(v)}(?![A-Za-z0-9_])", text.lower()) for v in variants(b))]


def longest(text):
    best, size = None, 0
    for b in NAMES:
        for v in variants(b):
            if len(v) > size and re.search(rf"(?<![A-Za-z0-9_]){re.escape(v)}(?![A-Za-z0-9_])", text.lower()):
                best, size = b, len(v)
    return best


def own(host, b):
    return any(host == d or host.endswith("." + d) for d in CAT[b][0])


def page(host, text):
    found = named(text)
    if not found or own(host, found[0]):
        return 0.0
    tokens = [re.sub("[-_0-9]", "", t) for t in (found[0], *CAT[found[0]][1])]
    if any(p.startswith(t) or p.endswith(t) for p in (re.sub("[-_0-9]", "", x) for x in host.split(".")) for t in tokens):
        return 0.95
    return 0.85 if found[0] in host else round(min(0.4 + 0.15 * len(found), 0.9), 3)


def registered(host):
    parts = host.split(".")
    return ".".join(parts[-3:] if ".".join(parts[-2:]) in ("co.uk", "co.nz", "co.jp", "co.kr", "co.in", "co.za") else parts[-2:])


def anchors(links, host):
    seen = {}
    every = {d for ds, *_ in CAT.values() for d in ds}
    for href, text in links:
        b = longest(text or "")
        if not href or b is None:
            continue
        d = registered(href.split("/")[2]) if href.startswith("http") else registered(host)
        if not own(d, b) and (b, d) not in seen:
            seen[b, d] = 0.2 if d in every else 0.7 if d.endswith((".github.io", ".vercel.app", ".netlify.app", ".web.app")) else 0.9 if b in d else 0.5
    return sorted(seen.items(), key=lambda x: -x[1])


def misspelt(r):
    b = r.choice(NAMES)
    d = r.choice(CAT[b][0]) if r.random() < 0.7 else f"{b}.test"
    for _ in range(r.randint(0, 3)):
        k = r.randrange(len(d))
        d = r.choice((d[:k] + r.choice("abcdefghijklmnopqrstuvwxyz0123456789-") + d[k + 1 :], d[:k] + d[k + 1 :], d[:k] + r.choice("aeiou01") + d[k:])) or "x"
    return d.replace("/", "")


def plain_nearest(domain):
    """Every domain of the catalogue, one after the other."""
    label = domain.split(".")[0]
    if not label:
        return None, 0.0
    best, who = 0.0, None
    for b, (ds, *_) in CAT.items():
        for d in ds:
            if d.split(".")[0] == label:
                return b, 1.0
            s = brands.similarity(label, d)
            if s > best:
                best, who = s, b
    return who, best


def test_catalogue():
    assert len(CAT) == 70 and CAT["paypal"][0][0] == "paypal.com" and CAT["zoom"][0] == ("zoom.us", "zoom.com") and CAT["usps"][1] == ("us postal", "postal-service")
    assert len({e[2] for e in CAT.values()}) == 10


def test_texts_and_hosts_against_plain_search(spark):
    r, rows = random.Random(11), []
    words = ["the", "Log", "in", "x", "9", "é", "at", "t", *NAMES, *[v for b in NAMES for v in variants(b)], *[v.upper() for b in NAMES for v in variants(b)]]
    tails = ["test", "com", "co.uk", "github.io", "web.app", "xyz"]
    for k in range(2000):
        text = "".join(r.choice(words) + r.choice([" ", ", ", "-", "_", "", ".", "/"]) for _ in range(r.randint(0, 8)))
        b = r.choice(NAMES)
        host = r.choice([f"www.{r.choice(CAT[b][0])}", f"{b}-secure.test", f"a.{b}{k % 10}.b.test", f"pre{b}post.test", f"{misspelt(r)}"]).replace("/", "")
        links = [(r.choice(["", "/x", f"https://{r.choice(CAT[r.choice(NAMES)][0])}/a", f"http://{b}-x.{r.choice(tails)}/b", f"https://u.{r.choice(tails)}/c"]), r.choice([text, b, f"see {r.choice(NAMES)}", ""])) for _ in range(r.randint(0, 7))]
        rows.append((k, host, text, links))
    df = spark.createDataFrame(rows, "i int, host string, text string, anchors array<struct<href:string,text:string>>")
    df = df.withColumn("named", brands.mentions(F.col("text"))).withColumn("off", brands.anchors_off(F.col("anchors"), F.col("host")))
    got = {x.i: x for x in df.select("i", "named", brands.primary(F.col("text")).alias("longest"), brands.page_mismatch(F.col("host"), F.col("named")).alias("page"), "off", brands.anchor_score(F.col("off")).alias("score")).collect()}
    for k, host, text, links in rows:
        assert (list(got[k].named), got[k].longest, got[k].page) == (named(text), longest(text), page(host, text)), (host, text)
        want = anchors(links, host)
        assert [((m.brand, m.domain), m.severity) for m in got[k].off] == want, (host, links)
        total = sum(s * (1 if j < 3 else 0.3) for j, (_, s) in enumerate(want))
        assert got[k].score == pytest.approx(min(1.0, total / 2.5), abs=6e-4)


def test_nearest_and_sounds_against_all_domains(spark):
    r = random.Random(12)
    hosts = sorted({misspelt(r) for _ in range(1500)} | {"", "a", "paypa1.com", "xn--pypal-4ve.com", "co.uk", "google.my-site.com"})
    domains = brands.Domains(CAT)
    for h in hosts:
        b, s, _, d, distance = domains.nearest(h)
        assert (b, s) == plain_nearest(h), h
        assert (d is None) == (b is None) and (distance == 0) == (s == 1.0 and d.split(".")[0] == h.split(".")[0])
    df = spark.createDataFrame([(h, r.choice([None, None, *NAMES])) for h in hosts], "host string, brand string")
    for x in df.select("host", "brand", *[c.alias(n) for n, c in brands.sound_alike(F.col("host"), F.col("brand")).items()]).collect():
        label = re.sub("[-_0-9]", "", x.host.split(".")[0])
        like = [b for b in ([x.brand] if x.brand else NAMES) if label != re.sub("[-_]", "", b) and phonetic.alike(label, re.sub("[-_]", "", b))] if len(label) >= 3 else []
        assert (x.phonetic_brand, x.phonetic_score) == ((like[0], 0.8 if x.brand else 0.7) if like else (None, 0.0)), x


def test_first_brand_by_name_decides_the_page(spark):
    """On its own domain, a brand named beside one with a longer name is no mismatch."""
    rows = spark.createDataFrame([("www.apple.com", "apple and microsoft"), ("www.microsoft.com", "apple and microsoft")], "host string, text string")
    assert [x[0] for x in rows.select(brands.page_mismatch(F.col("host"), brands.mentions(F.col("text")))).collect()] == [0.0, 0.7]


def test_hyphens_count_in_the_registered_domain_alone(spark):
    hosts = ["paypal.my-site.com", "paypal-secure.com", "a-b.paypal.com", "x.my-paypal.co.uk"]
    rows = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = rows.select(urls.structure(F.concat(F.lit("https://"), "host"), F.col("host"))["prefix_suffix_hyphen"]).collect()
    assert [x[0] for x in got] == [False, True, False, True]


def test_entropy(spark):
    r = random.Random(13)
    texts = ["", "a", "aabc", "https://192.168.0.10/login", "http://user@evil.example.com/a//b", *["".join(r.choice("abcdé:/.?=&ß0123") for _ in range(r.randint(1, 300))) for _ in range(300)]]
    from collections import Counter
    from math import log2

    for x in spark.createDataFrame([(t,) for t in texts], "t string").select("t", urls.entropy(F.col("t")).alias("e")).collect():
        assert x.e == pytest.approx(-sum(c / len(x.t) * log2(c / len(x.t)) for c in Counter(x.t).values()) if x.t else 0.0, abs=1e-9)


#: Worked by hand from the rules: (url, html, similarity, verdict, confidence, level)
SCANS = (
    ("https://www.google.com/", "<title>Hi there friend</title><p>plain words here", None, "SAFE", 1.0, "L1_WHITELIST"), ("http://example.com/", "<p>plain words here", 0.9, "SAFE", None, "L2_HEURISTICS"),
    ("http://paypal-secure.com/", '<title>PayPal</title><body><p>verify your account</p><form action="http://collector.test/x.php" method="post"><input type="password"></form>', None, "MALICIOUS", None, "L2_HEURISTICS"),
    ("https://a.b.c.d.zzqq.com/", None, 0.9, "MALICIOUS", 0.9025, "L3_ML"),
)


def test_scan(spark):
    rows = spark.createDataFrame([(u, h, s, "paypal.com") for u, h, s, *_ in SCANS], "url string, html string, similarity double, expected_domain string")
    got = {x.url: (x.verdict, x.confidence, x.level_caught) for x in scan.scan(rows, spark.createDataFrame([("google.com",)], "domain string")).collect()}
    assert got == {u: (v, c, level) for u, _, _, v, c, level in SCANS}
