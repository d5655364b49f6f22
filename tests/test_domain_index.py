import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import brands, domain_index as di


def name(r, n=None):
    return "".join(r.choice("abcdeimnorst") for _ in range(n or r.randint(2, 12)))


def misspelt(r, s):
    t = list(s)
    for _ in range(r.randint(0, 3)):
        k = r.randrange(len(t)) if t else 0
        kind = r.random()
        if kind < 0.3 and t:
            t[k] = r.choice("abcdeimnorst")
        elif kind < 0.55:
            t.insert(k, r.choice("abcdeimnorst"))
        elif kind < 0.8 and len(t) > 2:
            del t[k]
        elif len(t) > 1:
            k = min(k, len(t) - 2)
            t[k], t[k + 1] = t[k + 1], t[k]
    return "".join(t) or "a"


def test_alike_strings_share_what_the_bounds_say():
    r = random.Random(1)
    tried = 0
    for _ in range(40_000):
        a = name(r)
        b = misspelt(r, a) if r.random() < 0.7 else "".join(r.sample(a, len(a)))
        sim = 0.7 * brands.jaro_winkler(a, b) + 0.3 * brands.common_run(a, b) / max(len(a), len(b))
        if a == b or sim < 0.7:
            continue
        tried += 1
        pairs = len(set(di._occurrences([a[i : i + 2] for i in range(len(a) - 1)])) & set(di._occurrences([b[i : i + 2] for i in range(len(b) - 1)])))
        letters = len(set(di._occurrences(sorted(a))) & set(di._occurrences(sorted(b))))
        same = sorted(a) == sorted(b)
        assert same or pairs >= di.shared_pairs(len(a), len(b)), (a, b)
        assert letters >= di.shared_letters(len(a), len(b)), (a, b)
        assert min(len(a), len(b)) / max(len(a), len(b)) >= 0.14 / 0.44 - 1e-6
        if not same and (di.least_shared(len(a))[0] < 1 or di.least_shared(len(b))[0] < 1):
            assert max(len(a), len(b)) <= di.SHORT, (a, b)
    assert tried > 6_000


def test_the_least_number_of_shared_pairs_never_falls():
    got = [min(di.shared_pairs(n, b) for b in range(max(1, n // 4), 3 * n + 8)) for n in (30, 40, 50, 70)]
    assert got == sorted(got) and di.least_shared(63) == di.least_shared(40)
    assert all(di.least_shared(n)[0] >= 1 for n in range(di.SHORT + 1, 41))


@pytest.mark.parametrize("seed", range(1))
def test_nearest_domains_against_plain_search(spark, seed):
    r = random.Random(seed)
    domains = [f"{name(r)}.{r.choice(['com', 'org', 'co.uk'])}" for _ in range(300)] + ["same.com", "same.org"]
    cat = {f"b{k:03}": ((d,), ()) for k, d in enumerate(domains)} | {"z": (("same.com", "two.net"), ())}
    table = spark.createDataFrame([(b, d, k) for k, (b, d) in enumerate((b, d) for b, e in cat.items() for d in e[0])], "brand string, domain string, rank int")
    hosts = [f"www.{misspelt(r, r.choice(domains).split('.')[0])}.com" for _ in range(300)] + [name(r) + ".com" for _ in range(100)] + ["same.com", "www.same.org", "two.net", "", None, "localhost", "10.0.0.1"]
    rows = spark.createDataFrame([(k, h, "clash") for k, h in enumerate(hosts)], "k int, host string, brand string")
    want = {x["k"]: x for x in rows.select("k", brands.nearest(F.col("host"), cat).alias("n")).select("k", "n.*").collect()}
    got = di.nearest_in(rows, "host", table).collect()
    assert len(got) == len(hosts)
    compared = 0
    for x in got:
        w = want[x["k"]]
        if w["similarity"] >= 0.7:
            compared += 1
            assert (x["brand"], x["domain"], x["similarity"], x["distance"]) == (w["brand"], w["domain"], w["similarity"], w["distance"]) and abs(x["score"] - w["score"]) < 1e-9, (hosts[x["k"]], x, w)
        else:
            assert (x["brand"], x["similarity"], x["score"], x["distance"]) == (None, 0.0, 0.0, -1) and w["score"] == 0.0
    assert compared > 250


def test_a_large_catalogue_against_plain_search(spark):
    """100000 domains; the plain search goes over all of them for each host, bounded by what a domain can reach at most."""
    r = random.Random(5)
    domains = sorted({name(r, r.randint(5, 14)) + ".com" for _ in range(100_000)})
    r.shuffle(domains)
    table = spark.createDataFrame([(d, d, k) for k, d in enumerate(domains)], "brand string, domain string, rank int")
    hosts = [misspelt(r, misspelt(r, r.choice(domains).split(".")[0])) + ".com" for _ in range(20)] + [name(r, 9) + ".com" for _ in range(6)]
    got = {x["host"]: (x["domain"], x["similarity"]) for x in di.nearest_in(spark.createDataFrame([(h,) for h in hosts], "host string"), "host", table).collect()}
    plain = brands.Domains({d: ((d,), ()) for d in domains})
    for h in set(hosts):
        _, sim, _, own, _ = plain.nearest(h)
        assert got[h] == ((own, sim) if sim >= 0.7 else (None, 0.0)), h
    assert np.mean([v[0] is not None for v in got.values()]) > 0.7


def test_lower_bounds_are_refused(spark):
    with pytest.raises(ValueError):
        di.alike(spark.range(1).selectExpr("'a' AS l"), "l", spark.createDataFrame([], "brand string, domain string, rank int"), 0.6)
