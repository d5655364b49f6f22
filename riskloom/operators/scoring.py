"""Signals, weighted scores, verdicts and fusion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import config
from riskloom.functions.urls import pattern_hits, total


def weighted(signals: dict[str, Column]) -> Column:
    """A1: weighted sum of known signals (booleans count 1), three decimals, 1 at most."""
    value = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return F.least(F.lit(1.0), F.round(total(value(c) * config.SIGNAL_WEIGHTS[k] for k, c in signals.items() if k in config.SIGNAL_WEIGHTS), 3))


def banded(score: Column, safe_below: float, malicious_from: float) -> Column:
    return F.when(score < safe_below, "SAFE").when(score >= malicious_from, "MALICIOUS").otherwise("SUSPICIOUS")


def l2_verdict(score: Column) -> Column:
    return banded(score, config.L2_SAFE_BELOW, config.L2_MALICIOUS_FROM)


def patterns(text: Column) -> dict[str, Column]:
    """A3: hits of each kind and the score; null for texts under 10 characters except the score, which is 0."""
    long = F.length(text) >= 10
    n = {k: F.when(long, pattern_hits(text, p)) for k, p in (("urgency_hits", config.URGENCY_PATTERNS), ("fear_hits", config.FEAR_PATTERNS), ("credential_hits", config.CREDENTIAL_PATTERNS))}
    score = F.coalesce(0.15 * n["urgency_hits"] + 0.2 * n["fear_hits"] + 0.15 * n["credential_hits"], F.lit(0.0))  # least() passes over nulls
    return n | {"pattern_score": F.round(F.least(F.lit(1.0), score), 3)}


def form_signals(forms: Column, page_url: Column, page_host: Column) -> dict[str, Column]:
    """P4 and P5 over an array of structs with ``action``."""
    host = lambda u: F.lower(F.regexp_extract(u, r"^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return {
        "cross_origin_form": F.exists(forms, lambda f: f["action"].startswith("http") & (host(f["action"]) != page_host)),
        "https_downgrade": F.exists(forms, lambda f: page_url.startswith("https:") & f["action"].startswith("http:")),
    }


def form_score(form: Column, page_origin: Column, page_url: Column) -> Column:
    """A12 for one form (action, method, n_password, n_hidden), three decimals, 1 at most; a null action counts as empty, other nulls as no sign."""
    action = F.coalesce(form["action"], F.lit(""))
    origin = F.lower(F.regexp_extract(action, r"^(https?://[^/?#]*)", 1))
    exfil = "(?i)" + "|".join(config.EXFILTRATION_PATTERNS)
    rules = [
        (form["n_password"] > 0, 0.3), ((origin != "") & (origin != page_origin), 0.5), (page_url.startswith("https:") & action.startswith("http:"), 0.4), (action.rlike(exfil), 0.35),
        ((F.lower(form["method"]) == "post") & (form["n_password"] > 0), 0.2), (form["n_hidden"] > 3, 0.15), (F.trim(action).isin("", "#"), 0.1),
    ]
    return F.round(F.least(F.lit(1.0), total(F.coalesce(c.cast("int"), F.lit(0)) * w for c, w in rules)), 3)


def _forms_part(scores: Column) -> Column:
    """The worst form and 0.05 for each other one with a score, 0.2 of those at most; 0 without any."""
    told = F.filter(scores, lambda s: s > 0)
    return F.when(F.size(told) > 0, F.array_max(told) + F.least(F.lit(0.2), (F.size(told) - 1) * 0.05)).otherwise(0.0)


def forms_score(scores: Column) -> Column:
    """A12 for the forms of a page, three decimals, 1 at most."""
    return F.round(F.least(F.lit(1.0), _forms_part(scores)), 3)


def page_form_score(scores: Column, html: Column, page_origin: Column) -> Column:
    """A12 for a whole page: its forms, a password input that forbids completion, and a frame from elsewhere; null markup has neither."""
    tag = lambda name: F.coalesce(F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b([^>]*)>"), F.lit(1)), F.array().cast("array<string>"))
    secret = F.exists(tag("input"), lambda a: a.rlike("(?i)(?:^|\\s)type\\s*=\\s*[\"']?password\\b") & a.rlike("\\sautocomplete\\s*=\\s*[\"']?off\\b"))
    sources = F.transform(tag("iframe"), lambda a: F.regexp_extract(a, "(?i)(?:^|\\s)src\\s*=\\s*[\"']?([^\"'\\s>]*)", 1))
    origin = lambda u: F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    foreign = F.exists(sources, lambda u: (u != "") & (origin(u) != page_origin))
    return F.round(F.least(F.lit(1.0), _forms_part(scores) + secret.cast("int") * 0.15 + foreign.cast("int") * 0.25), 3)


def fused(parts: dict[str, Column], l2: Column) -> dict[str, Column]:
    """Final score, verdict and confidence; null scores count 0."""
    parts, l2 = {k: F.coalesce(c, F.lit(0.0)) for k, c in parts.items()}, F.coalesce(l2, F.lit(0.0))
    l3 = total(parts[k] * w for k, w in config.L3_WEIGHTS.items()) / sum(config.L3_WEIGHTS.values())
    fired = total((c > 0).cast("int") for c in parts.values())
    influence = F.when(fired == 0, 0.85).otherwise(0.3)
    final = l2 * influence + l3 * (1 - influence)
    plain = banded(final, config.L3_SAFE_BELOW, config.L3_MALICIOUS_FROM)
    override = parts["visual_score"] >= config.VISUAL_OVERRIDE
    coverage = fired / 4
    cap = F.when(plain == "SAFE", 0.75 + 0.22 * coverage).otherwise(0.45 + 0.52 * coverage)
    confidence = F.least(0.5 + F.abs(final - 0.5), cap)
    return {
        "final_score": F.round(final, 4), "verdict": F.when(override, "MALICIOUS").otherwise(plain),
        "confidence": F.round(F.when(override, F.least(F.lit(1.0), confidence + 0.15)).otherwise(confidence), 4),
    }


def safety(verdict: Column, score: Column) -> Column:
    """0 to 100; a safe result without a score is 100."""
    s = F.coalesce(score, F.lit(0.0))
    return F.when((verdict == "SAFE") & (s == 0), 100).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), F.floor((1 - s) * 100 + 0.5)))).cast("long")
