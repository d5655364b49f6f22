"""URL expressions: pure Column functions, all inside whole-stage code generation."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import config
from riskloom.functions import actions


def let(value: Column, then) -> Column:
    """then(value), with the value worked out once, also where it is used for each element of an array."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def total(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def hits(text: Column, words) -> Column:
    """How many of the words the text contains."""
    count = lambda t: F.when(t.isNotNull(), F.size(F.filter(F.from_json(F.lit(json.dumps(list(words))), "array<string>"), lambda w: F.contains(t, w))))
    return let(text, count)


def pattern_hits(text: Column, patterns) -> Column:
    return total(text.rlike(f"(?i){p}").cast("int") for p in patterns)


def normalised(url: Column) -> Column:
    """Trimmed, with ``https://`` before anything without a web scheme."""
    t = F.trim(url)
    return F.when(t.rlike("(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), t))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def suffixes(host_: Column) -> Column:
    """A host and all domains above it, the longest first."""
    labels = F.split(host_, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def registered(host_: Column) -> Column:
    """The last two labels, three where the last two are a known pair; an IP address is its own."""
    two = F.substring_index(host_, ".", -2)
    return F.when(is_ip(host_), host_).when(two.isin(*config.TWO_LABEL_TLDS), F.substring_index(host_, ".", -3)).otherwise(two)


def is_ip(host_: Column) -> Column:
    return host_.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$")


def tld(host_: Column) -> Column:
    """Last label, or the last two if they form a known pair."""
    two = F.substring_index(host_, ".", -2)
    return F.when(two.isin(*config.TWO_LABEL_TLDS), two).otherwise(F.substring_index(host_, ".", -1))


def tld_risk(tld_: Column) -> Column:
    """Registration risk of a suffix; unknown ones get the default."""
    out = F.lit(config.TLD_RISK_UNKNOWN)
    for risk, names in config.TLD_RISK.items():
        out = F.when(tld_.isin(*names), risk).otherwise(out)
    return out


def with_suffix_risk(rows, suffix: str, scores, out: str = "risk"):
    """Joins the offline statistics of suffixes (tld, risk); a suffix that isn't among them gets the greatest risk."""
    known = scores.groupBy(F.col("tld").alias("__tld")).agg(F.max("risk").alias("__risk"))
    most = known.agg(F.max("__risk").alias("__most"))
    joined = rows.join(known, F.col(suffix) == F.col("__tld"), "left").join(F.broadcast(most))
    return joined.withColumn(out, F.coalesce("__risk", "__most")).drop("__tld", "__risk", "__most")


def entropy(text: Column) -> Column:
    """Shannon entropy by code point, in bits (F1)."""
    n = F.length(text)

    def of(chars: Column) -> Column:
        # characters in order: each one's run ends where the next one differs, so one pass after the sort counts all
        ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get(chars, i - 1) != F.get(chars, i)))
        runs = lambda e: F.transform(e, lambda to, k: (to - F.when(k > 0, F.get(e, k - 1)).otherwise(0)).cast("double") / n)
        return let(ends, lambda e: F.aggregate(runs(e), F.lit(0.0), lambda a, x: a - x * F.log2(x)))

    return F.when(n > 0, let(F.array_sort(F.filter(F.split(text, ""), lambda c: c != "")), of)).otherwise(0.0)


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def structure(url: Column, host_: Column, words: tuple[str, ...] = config.SENSITIVE_WORDS, own: Column | None = None) -> dict[str, Column]:
    """Counts, ratios and flags of F1-F7; ``words`` are those of the online or of the offline variant of F5, ``own`` the registered domain where rules gave it."""
    own = registered(host_) if own is None else own
    n, lower = F.length(url), F.lower(url)
    count = lambda p: F.regexp_count(url, F.lit(p)).cast("long")
    return {
        "url_length": n.cast("long"), "entropy": F.round(entropy(url), 4), "digit_ratio": F.round(ratio(count("[0-9]"), n), 4), "letter_ratio": F.round(ratio(count("[A-Za-z]"), n), 4),
        "n_dots": count(r"\."), "n_slashes": count("/"), "n_hyphens": count("-"), "n_equals": count("="), "n_question": count(r"\?"), "n_amp": count("&"), "n_percent": count("%"),
        "n_double_slash": F.greatest(F.lit(0), count("//") - 1), "sensitive_words": hits(lower, words).cast("long"), "has_at": url.contains("@"),
        "prefix_suffix_hyphen": own.contains("-") & (hits(own, config.OBFUSCATION_BRANDS) > 0),
    }


def obfuscation_flags(url: Column, host_: Column) -> Column:
    """Flags of A11 in order."""
    brand = F.lit(None).cast("string")
    for b in reversed(config.OBFUSCATION_BRANDS):
        brand = F.when(host_.contains(b) & ~host_.endswith(f".{b}.com") & (host_ != f"{b}.com"), F.lit(f"brand_impersonation_{b}")).otherwise(brand)
    registered = F.substring_index(host_, ".", -2)
    flag = lambda when, name: F.when(when, F.lit(name))
    early = F.array_compact(F.array(
        flag(host_.isin(*config.SHORTENERS) | registered.isin(*config.SHORTENERS), "url_shortener"), flag(is_ip(host_), "ip_based_url"), flag(host_.contains("xn--"), "idn_homograph"),
        flag(F.size(F.split(host_, r"\.")) > 4, "excessive_subdomains"),
    ))
    late = F.array_compact(F.array(flag(F.regexp_count(url, F.lit("https?://")) > 1, "url_in_url_redirect"), flag(url.rlike("(?i)https?://[^@]+@"), "at_symbol_trick"), brand))
    return F.concat(early, F.coalesce(base64_flags(url), F.array().cast("array<string>")), late)


def base64_flags(url: Column) -> Column:
    """A flag for each parameter that hides a decoded address, password or login (F8), in order."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    return F.transform(actions.hidden_parameters(query), lambda p: F.concat(F.lit("base64_param_"), p["name"]))


FLAG_SCORES = {"url_shortener": 0.4, "ip_based_url": 0.35, "idn_homograph": 0.45, "excessive_subdomains": 0.25, "url_in_url_redirect": 0.35, "at_symbol_trick": 0.5}
BASE64_SCORE = 0.3


def flag_score(flags: Column) -> Column:
    """Sum of the flags' scores, BASE64_SCORE for each hidden parameter, 1 at most."""
    s = total(F.array_contains(flags, k).cast("int") * v for k, v in FLAG_SCORES.items())
    s = s + F.size(F.filter(flags, lambda f: f.startswith("base64_param_"))) * BASE64_SCORE
    return F.least(F.lit(1.0), s + F.exists(flags, lambda f: f.startswith("brand_impersonation_")).cast("int") * 1.0)


def parameters(query: Column) -> Column:
    """a query's parameters as a map; of a repeated name the last counts; text that isn't valid coding stays as it is; null for null."""
    read = lambda c: F.coalesce(F.try_url_decode(c), c)
    parts = F.filter(F.split(F.regexp_replace(query, r"^\?", ""), "&"), lambda p: p != "")
    pairs = F.transform(parts, lambda p: F.struct(read(F.substring_index(p, "=", 1)).alias("name"), read(F.regexp_extract(p, "^[^=]*=?(.*)$", 1)).alias("value")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["name"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda p: p["name"] == n), -1)["value"]))


def origin(url: Column) -> Column:
    """scheme and authority with its port, in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))


def parsed(url: Column, own: Column | None = None) -> dict[str, Column]:
    """The parts of an address; ``registered`` is ``own`` where rules gave it, else the last two labels, three for known pairs; nulls stay null."""
    u = normalised(url)
    h = host(u)
    own, p = registered(h) if own is None else own, path(u)
    return {
        "scheme": F.lower(F.regexp_extract(u, "^([A-Za-z]+):", 1)), "host": h, "path": F.when(p == "", "/").otherwise(p), "query": F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), "registered": own,
        "subdomain": F.when(h == own, "").otherwise(F.substring(h, F.lit(1), F.length(h) - F.length(own) - 1)), "is_ip": is_ip(h), "is_localhost": h.isin("localhost", "127.0.0.1"),
    }
