"""What a reader of one result sees: risk flags, the state of each level, bands and the list of scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# When a feature counts as a risk; a null feature never does.
RISKS = {
    "url_entropy": "> 4.5", "url_digit_ratio": "> 0.3", "url_num_hyphens": ">= 2", "url_num_percent": "> 0", "url_num_double_slash": "> 0", "url_num_sensitive_words": ">= 2", "url_has_at_symbol": "= true", "url_prefix_suffix_hyphen": "= true",
    "html_num_eval_calls": "> 0", "html_num_unescape_calls": "> 0", "html_has_right_click_disabled": "= true", "sfh_is_empty": "= true", "sfh_is_about_blank": "= true", "html_has_favicon": "= false", "html_num_hidden_inputs": "> 2",
    "fearDetected": "= true", "credentialDetected": "= true", "brand_domain_match": "= false", "whitelistPartialMatch": "= true", "tranco_in_top10k": "= false", "domain_age_days": "< 30", "registrar_category": "= 'budget'", "has_registrant_org": "= false",
}
LEVELS = ("L1_WHITELIST", "L1_CACHE", "L2_HEURISTICS", "L3_ML")
NOT_SIGNALS = ("score", "l2_score", "l3_score", "final_score")


def risk_flags(columns: list[str]) -> Column:
    """names of the features, of those given, that look risky, in the table's order."""
    return F.array_compact(F.array(*[F.when(F.expr(f"`{c}` {rule}"), c) for c, rule in RISKS.items() if c in columns]))


def level_status(level: str, caught: Column, verdict: Column, cached: Column) -> Column:
    """pass before the level that decided, then what it decided, skip after it; all skip for a level outside the order."""
    at = F.array_position(F.array(*map(F.lit, LEVELS)), F.when(F.coalesce(cached, F.lit(False)), "L1_CACHE").otherwise(F.coalesce(caught, F.lit("L3_ML"))))
    this = LEVELS.index(level) + 1
    return F.when(at == 0, "skip").when(at > this, "pass").when(at < this, "skip").when(verdict == "SAFE", "pass").when(verdict == "MALICIOUS", "catch").otherwise("warning")


def flattened(signals: dict[str, Column], model: dict[str, Column]) -> Column:
    """array of (name, score): numbers from 0 to 1 but totals, then the model's parts as they are; nulls are left out."""
    row = lambda name, c: F.struct(F.lit(name).alias("name"), c.cast("double").alias("score"))
    plain = [F.when(c.between(0, 1), row(k.replace("_", " "), c)) for k, c in signals.items() if k not in NOT_SIGNALS]
    return F.array_compact(F.array(*plain, *[F.when(c.isNotNull(), row(f"ML: {k}", c)) for k, c in model.items()]))


def bands(form: Column, visual: Column, fear_over: Column, n_ocr_flags: Column, fired: Column) -> dict[str, Column]:
    """ok, neutral or bad for each part of the last level; null parts are ok but for the count of signals."""
    low = lambda c: F.coalesce(c, F.lit(0))
    return {
        "form_band": F.when(low(form) >= 0.5, "bad").when(low(form) < 0.3, "ok").otherwise("neutral"), "visual_band": F.when(low(visual) >= 0.82, "bad").otherwise("ok"),
        "fear_band": F.when(F.coalesce(fear_over, F.lit(False)), "bad").otherwise("ok"), "ocr_band": F.when(low(n_ocr_flags) > 0, "bad").otherwise("ok"), "fired_band": F.when(low(fired) >= 1, "ok").otherwise("neutral"),
    }


def colour(score: Column) -> Column:
    """F32."""
    return F.when(score.isNull(), "none").when(score < 0.33, "safe").when(score < 0.66, "suspicious").otherwise("malicious")
