"""The levels of a scan as one plan: allow-list, cheap rules, models for what stays open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import config
from riskloom.operators import scoring


def request_reason(url: Column, most: int = 2048) -> Column:
    """Why an address can't be scanned; null if it can."""
    return F.when(url.isNull() | (F.trim(url) == ""), "empty").when(F.length(url) > most, "too_long").when(~url.rlike("(?i)^https?://"), "scheme")


def rank_bucket(rows: DataFrame, key: str, ranks: DataFrame | None, rank: str = "rank", cuts: tuple[tuple[int, str], ...] = ((1000, "top1k"), (10000, "top10k"))) -> DataFrame:
    """Adds ``bucket`` by rank, ``none`` for keys that aren't listed; null for all without a list.  Only as many ranks as the last cut count."""
    if ranks is None:
        return rows.withColumn("bucket", F.lit(None).cast("string"))
    known = ranks.where(F.col(rank) <= cuts[-1][0]).groupBy(F.col(key).alias("__key")).agg(F.min(rank).alias("__rank"))
    bucket = F.lit("none")
    for most, name in reversed(cuts):
        bucket = F.when(F.col("__rank") <= most, name).otherwise(bucket)
    return rows.join(known, F.col(key) == F.col("__key"), "left").withColumn("bucket", bucket).drop("__key", "__rank")


def bounded(columns: dict[str, Column]) -> dict[str, Column]:
    """What goes to the models and into a report, cut to config.LIMITS characters; nulls stay."""
    return {n: F.substring(c, 1, config.LIMITS[n]) for n, c in columns.items()}


def gate(rows: DataFrame, allowed: DataFrame, domain: str = "domain") -> DataFrame:
    """Adds ``fast_path`` and ``partial_match``: allowed domains pass, those where anyone can host only match in part.

    The list may be long, so the join is left to the planner, which broadcasts by size; repeated entries count once.
    A null domain, like one not listed, is neither.
    """
    known = allowed.select(F.lower(F.col(domain)).alias("__domain")).where(F.col("__domain").isNotNull()).distinct().withColumn("__known", F.lit(True))
    shared = F.coalesce(F.col(domain).isin(*config.WILDCARD_HOSTING), F.lit(False))
    found = rows.join(known, F.lower(rows[domain]) == F.col("__domain"), "left").withColumn("__known", F.coalesce("__known", F.lit(False)))
    return found.withColumn("fast_path", F.col("__known") & ~shared).withColumn("partial_match", F.col("__known") & shared).drop("__domain", "__known")


def decided(fast_path: Column, cached: Column, l2: Column, fused: dict[str, Column]) -> dict[str, Column]:
    """The level that decides, its verdict, score and confidence, in one pass over scores that are columns.

    ``cached`` is a verdict or null.  Where the models gave no score (``final_score`` null), the rules' score stays, with
    confidence 0.5, as a fallback.  Rules alone have no confidence.
    """
    rules = scoring.l2_verdict(l2)
    level = F.when(fast_path, "L1_WHITELIST").when(cached.isNotNull(), "L1_CACHE").when(rules != "SUSPICIOUS", "L2_HEURISTICS").when(fused["final_score"].isNull(), "L2_FALLBACK").otherwise("L3_ML")
    pick = lambda listed, kept, ruled, fallback, model: F.when(level == "L1_WHITELIST", listed).when(level == "L1_CACHE", kept).when(level == "L2_HEURISTICS", ruled).when(level == "L2_FALLBACK", fallback).otherwise(model)
    none = F.lit(None).cast("double")
    return {
        "level_caught": level, "verdict": pick(F.lit("SAFE"), cached, rules, F.lit("SUSPICIOUS"), fused["verdict"]),
        "score": pick(F.lit(0.0), none, l2, l2, fused["final_score"]), "confidence": pick(F.lit(1.0), none, none, F.lit(0.5), fused["confidence"]),
    }


def only_open(rows: DataFrame, open_: Column, model: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Applies a costly model to the open rows alone, by splitting: a CASE doesn't keep Python from running on the others.

    The model adds columns; they are null for the rest.
    """
    rest = rows.where(~F.coalesce(open_, F.lit(False)))
    return model(rows.where(F.coalesce(open_, F.lit(False)))).unionByName(rest, allowMissingColumns=True)


def spoof(similarity: Column, domain: Column, expected: Column) -> Column:
    """The similarity itself if it is high and the page isn't on the brand's domain, else 0; nulls are 0."""
    own = F.coalesce((expected != "") & ((domain == expected) | domain.endswith(F.concat(F.lit("."), expected))), F.lit(False))
    return F.when((similarity >= config.VISUAL_OVERRIDE) & ~own, similarity).otherwise(0.0)
