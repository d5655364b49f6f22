"""J7 and A7 against a catalogue of any size: the likest domain of each host by an index over pairs of letters.

A host's registered label and a form of a domain (its first label, or the whole) that are alike enough must share so many pairs of
neighbouring letters, or consist of the same letters, or be short and share so many letters.  How many follows from the measure: with m matched letters of
a and b, ``swapped`` of them out of order, at least 3m - 1 - a - b - 2 swapped pairs stay side by side in both, and the share of matched letters, the common start and the common run bound
the likeness from above (``least_shared`` searches all cases).  Of a string with n pairs, n - least + 1 of the rarest meet at least one of another's
rarest, so only those are keys of the join; what meets is compared exactly, after a cheap bound by letters in common.

No side is a list on the driver, and no task holds a key's rows together: the join is one of equal keys, which Spark splits where a key is
hot.  The rarity table has a row for each pair of letters.

Defined results: hosts whose likest domain is under ``least`` have no row in the result of ``alike`` and null brand, similarity 0 and score 0 in that of
``nearest_in``; ties go to the lower rank; null and empty hosts are such hosts; repeated domains count once each, by rank; repeated rows get equal results.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import urls
from riskloom.operators.brands import closer, edit_distance, similarity

LEAST = 0.7
#: Lengths beyond which the least number of shared pairs isn't searched any more (it never falls; tests hold that).
LONGEST = 40
#: Strings of so many letters at most are found by letters in common.
SHORT = 6


@lru_cache(maxsize=None)
def shared_pairs(a: int, b: int, least: float = LEAST) -> int:
    """Least number of neighbouring pairs that strings of a and b letters have in common if they are alike enough and aren't made of the same letters; a
    large number if they can't be alike enough."""
    best, high = 1 << 20, max(a, b)
    for m in range(1, min(a, b) + 1):
        if m == a == b:
            continue
        for swapped in (0, *range(2, m + 1)):
            j = (m / a + m / b + (m - swapped / 2) / m) / 3
            if 0.7 * (0.6 * j + 0.4) + 0.3 * m / high < least - 1e-4:
                continue
            kept = 3 * m - 1 - a - b - 2 * swapped
            for p in range(min(4, m) + 1):
                run = max(1.0, (least - 1e-4 - 0.7 * (j + 0.1 * p * (1 - j))) / 0.3 * high)
                if run <= m:
                    best = min(best, max(kept, int(np.ceil(run)) - 1, p - 1, 0))
    return best


@lru_cache(maxsize=None)
def shared_letters(a: int, b: int, least: float = LEAST) -> int:
    """The same of single letters."""
    high = max(a, b)
    for m in range(1, min(a, b) + 1):
        j = (m / a + m / b + 1) / 3
        if 0.7 * (0.6 * j + 0.4) + 0.3 * m / high >= least - 1e-4:
            return m
    return 1 << 20


def least_shared(n: int, least: float = LEAST) -> tuple[int, int]:
    """Pairs, and letters, that a string of n letters shares with any that is alike enough (of other letters)."""
    n = min(n, LONGEST)
    return min(shared_pairs(n, b, least) for b in range(1, 4 * n + 8)), min(shared_letters(n, b, least) for b in range(1, 4 * n + 8))


def _occurrences(parts: list[str]) -> list[str]:
    """Parts with how often each has come before, so that repeated ones differ."""
    seen: Counter = Counter()
    out = []
    for p in parts:
        out.append(f"{p}{seen[p]}")
        seen[p] += 1
    return out


def _keys(rarity: dict[str, int], least: float):
    """Of strings, their keys: the rarest pairs that must meet another's; of short ones letters as well; and all letters in order."""
    needs = [least_shared(n, least) if n else (1, 1) for n in range(LONGEST + 1)]

    def of(s: str) -> list[str]:
        pairs, letters = needs[min(len(s), LONGEST)]
        out = ["s" + "".join(sorted(s))]
        if pairs >= 1:
            tokens = sorted(_occurrences([s[i : i + 2] for i in range(len(s) - 1)]), key=lambda t: (rarity.get(t[:2], 0), t))
            out += ["p" + t for t in tokens[: max(0, len(tokens) - pairs + 1)]]
        if len(s) <= SHORT:
            tokens = sorted(_occurrences(sorted(s)))
            out += ["l" + t for t in tokens[: max(0, len(tokens) - letters + 1)]]
        return out

    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if s is None else of(s) for s in column.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")


def _possible(least: float):
    """Whether two strings may be alike enough, by letters in common and the common start."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out, counts = [], {}
        for x, y in zip(a.to_pylist(), b.to_pylist()):
            cx, cy = (counts.get(s) or counts.setdefault(s, Counter(s)) for s in (x, y))
            m = sum(min(n, cy[c]) for c, n in cx.items())
            p = next((i for i, (u, v) in enumerate(zip(x[:4], y[:4])) if u != v), min(len(x), len(y), 4))
            j = (m / len(x) + m / len(y) + 1) / 3 if m else 0.0
            out.append(0.7 * (j + 0.1 * p * (1 - j)) + 0.3 * m / max(len(x), len(y)) >= least - 1e-4)
        return pa.array(out, pa.bool_())

    return F.arrow_udf(run, "boolean")


def _similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([similarity(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


def _distance(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else edit_distance(x, closer(x, y)) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())


def alike(labels: DataFrame, label: str, catalogue: DataFrame, least: float = LEAST) -> DataFrame:
    """(label, brand, domain, rank, similarity): of each distinct label the domain it is most like, of those at least so like; catalogue: brand, domain, rank."""
    if least < LEAST:
        raise ValueError(f"the bounds hold from {LEAST} on")
    known = catalogue.select("brand", F.lower("domain").alias("domain"), "rank").where(F.col("domain") != "")
    forms = known.select("domain", F.explode(F.array_distinct(F.array(F.substring_index("domain", ".", 1), F.col("domain")))).alias("form")).where("form <> ''").distinct()
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length("form") - 1, F.lit(1))), lambda i: F.substring("form", i, F.lit(2)))
    counted = forms.select(F.explode(pairs).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    rarity = {r["p"]: r["n"] for r in counted.collect()}  # one for each pair of letters in use
    keys = _keys(rarity, least)
    own = labels.select(F.col(label).alias("label")).where(F.col("label") != "").distinct()
    own = own.select("label", F.length("label").alias("n"), F.explode(keys("label")).alias("key"))
    theirs = forms.select("domain", "form", F.length("form").alias("m"), F.explode(keys("form")).alias("key"))
    near = F.least("n", "m") / F.greatest("n", "m") >= (least - 0.56) / 0.44 - 1e-6  # longer ones can't be alike enough
    met = own.join(theirs, "key").where(near).select("label", "domain", "form").distinct()
    met = met.where(_possible(least)(F.col("label"), F.col("form"))).select("label", "domain").distinct()
    scored = met.withColumn("similarity", F.arrow_udf(_similarity, "double")(F.col("label"), F.col("domain"))).where(F.col("similarity") >= least)
    best = scored.join(known.groupBy("domain").agg(F.min(F.struct("rank", "brand")).alias("k")), "domain").select("label", "domain", "similarity", "k.rank", "k.brand")
    exact = F.substring_index("domain", ".", 1) == F.col("label")  # a label of the catalogue is its own likest, the first by rank
    first = best.groupBy("label").agg(F.max_by(F.struct("brand", "domain", "rank", "similarity"), F.struct(exact, "similarity", -F.col("rank"))).alias("b"))
    return first.select("label", "b.*").withColumn("similarity", F.when(F.substring_index("domain", ".", 1) == F.col("label"), 1.0).otherwise(F.col("similarity")))


def nearest_in(rows: DataFrame, host: str, catalogue: DataFrame, own: Column | None = None, least: float = LEAST) -> DataFrame:
    """The rows with (brand, similarity, score, domain, distance) of their nearest domain as ``brands.nearest`` finds it, if it is at least so like.

    ``own``: the hosts' registered domains where rules gave them.
    """
    columns = [c for c in rows.columns if c not in ("brand", "similarity", "score", "domain", "distance")]
    registered = F.coalesce(urls.registered(F.lower(F.col(host))) if own is None else own, F.lit(""))
    labelled = rows.select(*columns, registered.alias("__own")).withColumn("__label", F.substring_index("__own", ".", 1))
    found = alike(labelled, "__label", catalogue, least).withColumn("distance", F.arrow_udf(_distance, "int")(F.col("label"), F.col("domain")))
    theirs = catalogue.select(F.col("brand").alias("__b"), F.lower("domain").alias("__d")).distinct()
    joined = labelled.join(found, F.col("__label") == F.col("label"), "left").join(theirs, (F.col("__b") == F.col("brand")) & (F.col("__d") == F.col("__own")), "left")
    off = F.col("__d").isNull() & (F.col("similarity") > 0.7)
    score = F.when(off, F.least(F.pow((F.col("similarity") - 0.7) / 0.3, F.lit(1.5)), F.lit(1.0))).otherwise(0.0)
    return joined.select(*columns, "brand", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), score.alias("score"), "domain", F.coalesce("distance", F.lit(-1)).alias("distance"))
