"""URL filters: ordered allow and block rules, and gradient-boosted trees on lexical features for all other addresses.

A rule is ``host/path``; it fits its host and all subdomains if the address's path starts with the rule's; the longest that
fits wins.  Addresses that a rule decides are the labelled ones: the trees learn from at most MAX_ROWS distinct ones, those with
the least hashes of each verdict, half of either where both have as many, weighted by their copies, and judge the rest.  Features: lengths, depth, digit ratio, entropy, parameter counts, and statistics of suffixes
(how common a last label or a last pair of labels is among all addresses, and how often it is blocked among labelled ones), by
SUFFIXES hashed buckets, so that what the driver holds doesn't grow with the number of hosts.

Defined results: host and path are empty for null and for text without ``://``; those, like any other, get the trees' verdict;
without labelled addresses of both kinds the verdict is the only kind there is, else ``allow``; repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, text

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
MAX_ROWS, SUFFIXES, TREES, DEPTH, BINS, RATE = 20000, 512, 60, 4, 32, 0.2
NAMES = ("length", "host_length", "path_length", "depth", "labels", "digits", "host_digits", "entropy", "host_entropy", "params", "query_length", "fragment", "hyphens", "secure", "longest_segment", "digit_run", "dotted_name", "tld_common", "tld_blocked", "pair_common", "pair_blocked", "first_blocked")
SUFFIX_KINDS = ("tld", "pair", "first")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null.  Rules are a short list, tried longest first."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def suffixes(host: Column, path: Column) -> Column:
    """Buckets of the last label, the last two labels and the first segment of the path."""
    bucket = lambda kind, x: F.pmod(F.xxhash64(F.lit(kind), x), F.lit(SUFFIXES)).cast("int")
    return F.array(bucket("tld", F.substring_index(host, ".", -1)), bucket("pair", F.substring_index(host, ".", -2)), bucket("first", F.substring_index(path, "/", 2)))


_DIGIT, _LETTER = np.isin(np.arange(256), list(b"0123456789")), np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))


def _counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of each row by value, number of bytes, entropy in bits."""
    b, off = text.raw(column)
    n = np.diff(off)
    c = np.bincount(np.repeat(np.arange(len(n)), n) * 256 + b, minlength=256 * len(n)).reshape(-1, 256)
    p = c / np.maximum(n, 1)[:, None]
    return c, n, -(p * np.log2(np.where(p > 0, p, 1))).sum(1)


def lexical(url: pa.Array, host: pa.Array, path: pa.Array, buckets: np.ndarray, common: np.ndarray, blocked: np.ndarray) -> np.ndarray:
    """(rows, NAMES); common and blocked: (SUFFIX_KINDS, SUFFIXES) statistics."""
    out = np.zeros((len(url), len(NAMES)), np.float32)
    for i in range(0, len(url), 1024):
        u, h, p = (x.slice(i, 1024) for x in (url, host, path))
        cu, nu, eu = _counts(u)
        ch, nh, eh = _counts(h)
        cp, np_, _ = _counts(p)
        k = buckets[i : i + 1024]
        texts, paths = [x or "" for x in u.to_pylist()], [x or "" for x in p.to_pylist()]
        query = [x.partition("#")[0].partition("?")[2] for x in texts]
        cols = [
            nu, nh, np_, cp[:, 47], np.where(nh > 0, ch[:, 46] + 1, 0), cu[:, _DIGIT].sum(1) / np.maximum(nu, 1), ch[:, _DIGIT].sum(1) / np.maximum(nh, 1), eu, eh,
            [q.count("&") + 1 if q else 0 for q in query], [len(q) for q in query], ["#" in x for x in texts], cu[:, 45], [x[:8].lower() == "https://" for x in texts],
            [max(map(len, x.split("/"))) for x in paths], [max(map(len, "".join(y if y.isdigit() else " " for y in x).split()), default=0) for x in paths], ["." in x.rpartition("/")[2] for x in paths],
            common[0, k[:, 0]], blocked[0, k[:, 0]], common[1, k[:, 1]], blocked[1, k[:, 1]], blocked[2, k[:, 2]],
        ]
        out[i : i + 1024] = np.stack([np.asarray(c, np.float32) for c in cols], 1)
    return out


@dataclass
class Trees:
    """Binary trees of one depth: by level the feature and threshold of each node, then the leaves' values."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - (1 << DEPTH) + 1]
        return out


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, l2: float = 1.0, weight: np.ndarray | None = None) -> Trees:
    """Histogram boosting on logistic loss with second-order leaves; rows count by ``weight`` (default: alike)."""
    weight = np.ones(len(y)) if weight is None else weight
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
    bad = float((weight * y).sum())
    base = float(np.log((bad + 1) / (weight.sum() - bad + 1)))
    margin, nodes = np.full(len(y), base), (1 << DEPTH) - 1
    d, feats, cuts, leaves = x.shape[1], [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        at, feature, cut = np.zeros(len(y), np.int64), np.zeros(nodes, np.int64), np.full(nodes, np.inf, np.float32)
        for level in range(DEPTH):
            first, width = (1 << level) - 1, 1 << level
            flat = ((at - first)[:, None] * d + np.arange(d)) * BINS + binned
            gs, hs = (np.bincount(flat.ravel(), np.repeat(w, d), width * d * BINS).reshape(width, d, BINS).cumsum(2) for w in (g, h))
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
            gain[(hs < 1e-2) | (ht - hs < 1e-2)] = 0
            for k in range(width):
                f, b = np.unravel_index(int(gain[k].argmax()), gain[k].shape)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    feature[first + k], cut[first + k] = f, edges[f][b]
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
        slot = at - nodes
        leaf = -RATE * np.bincount(slot, g, nodes + 1) / (np.bincount(slot, h, nodes + 1) + l2)
        margin += leaf[slot]
        feats.append(feature), cuts.append(cut), leaves.append(leaf)
    return Trees(base, np.array(feats), np.array(cuts), np.array(leaves))


@dataclass
class Filter:
    common: np.ndarray
    blocked: np.ndarray
    trees: Trees | None
    default: str


def _rows(pages: DataFrame, url_col: str, rules: tuple) -> DataFrame:
    rows = pages.select("*", F.struct(*[x.alias(n) for x, n in zip(parts(F.col(url_col)), ("host", "path"))]).alias("__p"))
    rows = rows.withColumn("__r", rule_of(F.col("__p.host"), F.col("__p.path"), rules))
    return rows.withColumn("__b", suffixes(F.col("__p.host"), F.col("__p.path")))


def learn(pages: DataFrame, url_col: str = "url", rules: tuple = RULES) -> Filter:
    rows = _rows(pages.select(F.col(url_col).alias("url")), "url", rules)
    stats = rows.select(F.posexplode("__b").alias("kind", "bucket"), F.col("__r.verdict").alias("v")).groupBy("kind", "bucket").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("v") == "block", 1)).alias("bad"), F.count("v").alias("known")).collect()  # 3 * SUFFIXES rows at most
    total, common, blocked = max(1, sum(r["n"] for r in stats if r["kind"] == 0)), np.zeros((3, SUFFIXES), np.float32), np.full((3, SUFFIXES), 0.5, np.float32)
    bad, known = sum(r["bad"] for r in stats if r["kind"] == 0), sum(r["known"] for r in stats if r["kind"] == 0)
    prior = bad / known if known else 0.5
    blocked[:] = prior
    for r in stats:
        common[r["kind"], r["bucket"]] = np.log1p(r["n"]) - np.log1p(total)
        blocked[r["kind"], r["bucket"]] = (r["bad"] + 10 * prior) / (r["known"] + 10)
    if not known or bad in (0, known):
        return Filter(common, blocked, None, "block" if known and bad else "allow")
    # an address's verdict, host, path and buckets follow from the address, so copies are counted before anything is drawn
    distinct = rows.where(F.col("__r").isNotNull()).groupBy("url").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(a) for c, a in (("__p.host", "host"), ("__p.path", "path"), ("__b", "__b"), ("__r.verdict", "v"))])
    drawn = {v: distinct.where(F.col("v") == v).orderBy(F.xxhash64("url"), "url").limit(MAX_ROWS).toPandas() for v in ("allow", "block")}
    rooms = {v: max(MAX_ROWS // 2, MAX_ROWS - len(drawn[other])) for v, other in (("allow", "block"), ("block", "allow"))}
    drawn = {v: d.head(rooms[v]) for v, d in drawn.items()}
    # rows that each address of the sample stands for
    weight = np.concatenate([drawn[v].n.to_numpy(float) * (rows_of / drawn[v].n.sum()) for v, rows_of in (("allow", known - bad), ("block", bad))])
    sample = pd.concat([drawn["allow"], drawn["block"]], ignore_index=True)
    x = lexical(*(pa.array(sample[c], pa.string()) for c in ("url", "host", "path")), np.array(sample["__b"].tolist()), common, blocked)
    return Filter(common, blocked, grow(x, (sample.v == "block").to_numpy(float), weight=weight / weight.mean()), "allow")


def judge(pages: DataFrame, model: Filter, url_col: str = "url", keep: list[str] | None = None, rules: tuple = RULES) -> DataFrame:
    """The columns ``keep`` (default: all) and host, path, rule, verdict, block_score (null where a rule decides); kept
    columns of these names give way."""
    own = ("host", "path", "rule", "verdict", "block_score")
    keep = [c for c in (keep or pages.columns) if c not in own]
    kinds = dict(zip(pages.columns, [f.dataType for f in pages.schema.fields]))
    rows = _rows(pages.select(*[F.col(f"`{c}`") for c in keep], F.col(url_col).alias("__url")), "__url", rules)
    rows = rows.select(*[F.col(f"`{c}`") for c in keep], "__p.host", "__p.path", "__r.rule", "__r.verdict", "__url", "__b")
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdict, score = batch.column(n + 3).to_pylist(), [None] * len(batch)
            open_ = np.flatnonzero([v is None for v in verdict])
            if len(open_):
                part = batch.take(pa.array(open_))
                if model.trees is None:
                    bad = np.full(len(open_), 1.0 if model.default == "block" else 0.0)
                else:
                    x = lexical(part.column(n + 4), part.column(n), part.column(n + 1), np.array(part.column(n + 5).to_pylist()), model.common, model.blocked)
                    bad = 1 / (1 + np.exp(-model.trees.margin(x)))
                for k, b in zip(open_, bad):
                    verdict[k], score[k] = "block" if b >= 0.5 else "allow", float(b)
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 3], pa.array(verdict, pa.string()), pa.array(score, pa.float64())], names=[*keep, *own])

    schema = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{schema}, host string, path string, rule string, verdict string, block_score double")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = store.table(spark, sf_dir, "pages")
    return judge(pages, learn(pages), keep=["page_id"])


QUERIES = {"op8_url_filter": op8_url_filter}
ORACLE_SQL: dict[str, str] = {}
