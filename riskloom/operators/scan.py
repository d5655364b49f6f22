"""A table of addresses and pages to verdicts: every level of the scan in one plan.

Nothing is shuffled but by the join with the allow-list, if there is one; Python runs in Arrow batches for the markup, the
nearest domain and the sound codes alone.
"""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import layout, markup, urls
from riskloom.operators import brands, cascade, lexicon, scoring, suffix_rules

#: Columns that models and other systems may have added, with their types; absent ones are null.
OPTIONAL = {"anger": "double", "joy": "double", "sadness": "double", "ocr_text": "string", "similarity": "double", "expected_domain": "string", "cached_verdict": "string", "repo_new": "boolean", "repo_few_commits": "boolean", "repo_password": "boolean"}
MODELS = ("anger", "ocr_text", "similarity")


def _forms(forms: Column) -> Column:
    """Forms as the form rules read them."""
    count = lambda f, kind: F.size(F.filter(f["inputs"], lambda i: F.lower(i["type"]) == kind))
    return F.transform(forms, lambda f: F.struct(F.coalesce(f["action"], F.lit("")).alias("action"), F.coalesce(f["method"], F.lit("get")).alias("method"), count(f, "password").alias("n_password"), count(f, "hidden").alias("n_hidden")))


#: Expressions that scans of one session share, by what they depend on; making them is most of the work of building a plan.
_MADE: dict[tuple, tuple] = {}


def _expressions(cat: brands.Catalogue, ruled: bool) -> dict:
    """All expressions of a scan, over its own names of columns; made once a session and catalogue."""
    context = SparkContext._active_spark_context
    if (held := _MADE.get((id(context), id(cat), ruled))) is None or held[0] is not context or held[1] is not cat:
        _MADE.clear()
        held = _MADE[id(context), id(cat), ruled] = (context, cat, _made(cat, ruled))
    return held[2]


def _made(cat: brands.Catalogue, ruled: bool) -> dict:
    own, led = (F.col("u.registered"), F.slice("domains", 2, F.greatest(F.size("domains") - 1, F.lit(0)))) if ruled else (None, None)
    host, page, m, url, html = F.col("u.host"), F.col("p"), F.col("m"), F.col("url"), F.col("html")
    struct = lambda columns: F.struct(*[c.alias(n) for n, c in columns.items()])
    squat, sound = brands.combosquat(host, F.col("brand"), cat), brands.sound_alike(host, F.col("brand"), cat)
    mismatch = brands.composite([brands.page_mismatch(host, F.col("named"), cat), brands.anchor_score(F.col("off")), F.col("near.score"), squat["combosquat_score"], sound["phonetic_score"], urls.tld_risk(urls.tld(host))])
    forms = _forms(page["forms"])
    signals = {
        "urgency_keyword": scoring.patterns(page["visible_text"])["pattern_score"], "domain_mismatch": mismatch, "url_obfuscation": urls.flag_score(F.col("flags")), "form_password_field": page["n_password"] > 0,
        **scoring.form_signals(forms, url, host), "github_new_repo": m["repo_new"], "github_few_commits": m["repo_few_commits"], "github_password_in_readme": m["repo_password"], "ip_based_url": F.col("u.is_ip"), "fetch_failed": html.isNull(),
    }
    # the forms of a page that couldn't be read are none
    found = F.coalesce(F.transform("forms", lambda f: scoring.form_score(f, urls.origin(url), url)), F.array().cast("array<double>"))
    parts = {
        "fear_score": lexicon.fear(page["visible_text"], *(F.coalesce(m[c], F.lit(0.0)) for c in ("anger", "joy", "sadness")))["fear_score"], "form_score": scoring.page_form_score(found, html, urls.origin(url)),
        "ocr_score": lexicon.image_text(m["ocr_text"])["ocr_score"], "visual_score": cascade.spoof(m["similarity"], F.col("u.registered"), m["expected_domain"]),
    }
    fused = scoring.fused({n: F.col("parts")[n] for n in parts}, F.col("l2"))
    none = {n: F.lit(None).cast("string" if n == "verdict" else "double") for n in fused}
    decided = lambda f: [c.alias(n) for n, c in cascade.decided(F.col("fast_path"), m["cached_verdict"], F.col("l2"), f).items()]
    ready = ["k", "url", "u", "m", "html", "p", "brand", "flags", "near"]
    breakdown = F.struct("signals", "parts", "flags", "brand", F.col("near.brand").alias("nearest_brand"), "phonetic_brand", "combosquat_pattern", "handler_empty", "handler_blank", "partial_match")
    return {
        "read": {"u": struct(urls.parsed(url)), "p": markup.page(html)},
        "said": {"said": F.when(html.isNotNull(), F.concat_ws(" ", "p.title", "p.visible_text", F.array_join("p.image_alts", " "), "p.meta_description")), "near": brands.nearest(host, cat, own), "flags": urls.obfuscation_flags(url, host), "off": brands.anchors_off(page["anchors"], host, cat, led)},
        "named": {"named": brands.mentions(F.col("said"), cat)}, "brand": {"brand": brands.page_brand(F.col("named"))},
        "ready": [*map(F.col, ready), F.struct(*[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in signals.items()]).alias("signals"), forms.alias("forms"), *[c.alias(n) for n, c in (squat | sound | layout.handlers(page["forms"])).items()]],
        "scored": {"l2": scoring.weighted({n: F.col("signals")[n] for n in signals}), "parts": F.struct(*[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in parts.items()])}, "domain": F.col("u.registered"), "no": F.lit(False),
        "decided": {True: decided(fused), False: decided(none)}, "out": ["url", "verdict", "score", "confidence", "level_caught", scoring.safety(F.col("verdict"), F.col("score")).alias("safety"), F.col("l2").alias("l2_score"), breakdown.alias("breakdown")],
    }


def scan(pages: DataFrame, allowed: DataFrame | None = None, keep: tuple[str, ...] = (), cat: brands.Catalogue = brands.CATALOGUE, rules: suffix_rules.Rules | None = None) -> DataFrame:
    """``url`` and ``html`` (null: the page couldn't be read), and any of OPTIONAL, to the columns of ``keep``, then url, verdict, score, confidence,
    level_caught, safety, l2_score and a breakdown.

    Without any model's column, addresses that the rules leave open fall back to the rules' score.  Null addresses get the verdict
    of an address without parts; repeated rows give repeated results; other columns are dropped.  With ``rules``, registered domains are
    those of the suffix rules.
    """
    x = _expressions(cat, rules is not None)
    optional = ", ".join(f"CAST({n if n in pages.columns else 'NULL'} AS {t}) AS {n}" for n, t in OPTIONAL.items())
    rows = pages.select(F.struct(*[F.col(c) for c in keep], F.lit(0).alias("__")).alias("k"), F.expr("coalesce(url, '') AS url"), "html", F.expr(f"struct({optional}) AS m"))
    for step in ("read", "said", "named", "brand"):
        rows = rows.withColumns(x[step])
        if step == "read" and rules is not None:
            anchors = F.coalesce(brands.anchor_hosts(F.col("p")["anchors"], F.col("u.host")), F.array().cast("array<string>"))
            rows = rows.withColumn("domains", rules.column(F.concat(F.array("u.host"), anchors)))
            rows = rows.withColumn("u", F.struct(*[c.alias(n) for n, c in urls.parsed(F.col("url"), F.get("domains", F.lit(0))).items()]))
    ready = rows.select(*x["ready"]).withColumns(x["scored"])
    if allowed is not None:
        ready = cascade.gate(ready.withColumn("domain", x["domain"]), allowed)
    else:
        ready = ready.withColumns({"fast_path": x["no"], "partial_match": x["no"]})
    result = ready.select("*", *x["decided"][any(c in pages.columns for c in MODELS)])
    return result.select(*[F.col("k")[c].alias(c) for c in keep], *x["out"])
