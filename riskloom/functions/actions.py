"""Targets of forms: kinds and resolution against the page.  Relative resolution is Python's; the rest is native."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions import urls

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?//(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?"


def _part(url: Column, group: int) -> Column:
    return F.lower(F.regexp_extract(F.ltrim(url), _PARTS, group))


def normalised_path(path: Column) -> Column:
    """one leading slash, none repeated, none at the end but for the root."""
    p = F.regexp_replace(F.concat(F.lit("/"), F.trim(path)), "/+", "/")
    return F.when(F.length(p) > 1, F.regexp_replace(p, "/$", "")).otherwise(p)


def belongs(host: Column, domain: Column) -> Column:
    """Whether the host is the domain or under it; false for a null or empty domain."""
    d = F.regexp_replace(F.lower(domain), r"^\.+", "")
    return F.coalesce((domain != "") & ((host == d) | F.endswith(host, F.concat(F.lit("."), d))), F.lit(False))


def action_kind(page_url: Column, action: Column, platform: Column, official: Column) -> Column:
    """the first kind that fits; ``official`` is null where the brand's domain is unknown."""
    value = F.lower(F.trim(F.coalesce(action, F.lit(""))))
    page, target = _part(page_url, 2), _part(action, 2)
    port = lambda u: F.coalesce(_part(u, 3).try_cast("int"), F.lit(-1))
    same = (_part(page_url, 1) == _part(action, 1)) & (page == target) & (port(page_url) == port(action))
    return (
        F.when(value == "", "empty").when(value == "about:blank", "about_blank").when(value.startswith("javascript:"), "javascript").when(value.startswith("mailto:"), "mailto")
        .when(target == "", "relative").when(same, "same_origin").when(belongs(page, platform) & belongs(target, platform), "same_platform_cross_origin")
        .when(official.isNotNull(), F.when(belongs(target, official), "official_brand_cross_origin").otherwise("external_cross_origin")).otherwise("unknown_brand_cross_origin")
    )


def _join(page, action) -> str:
    value = (action or "").strip()
    if not value or value.lower() == "about:blank" or value.lower().startswith(("javascript:", "mailto:")):
        return value
    try:
        return urljoin(page or "", value)
    except ValueError:
        return value


def resolved_action(page_url: Column, action: Column) -> Column:
    """the address a form sends to; special targets stay, null and empty ones are empty, unreadable ones stay as given."""

    @F.pandas_udf("string")
    def resolve(page: pd.Series, to: pd.Series) -> pd.Series:
        return pd.Series([_join(p, a) for p, a in zip(page, to)], dtype=object)

    return resolve(page_url, action)


def hidden_parameters(query: Column) -> Column:
    """F8: names and decoded values of parameters that hide readable text in base64 about an address, password or login."""
    pairs = F.map_entries(urls.parameters(query)).cast("array<struct<name:string,value:string>>")
    long = F.filter(pairs, lambda p: (F.length(p["value"]) > 20) & p["value"].rlike("[A-Za-z0-9_-]{20,}"))

    def decoded(v: Column) -> Column:
        letters = F.regexp_replace(F.translate(F.substring_index(v, "=", 1), "-_", "+/"), "[^A-Za-z0-9+/]", "")
        plain = F.regexp_replace(letters, r"^((?:.{4})*).$", "$1")
        padded = F.concat(plain, F.repeat(F.lit("="), ((4 - F.length(plain) % 4) % 4).cast("int")))
        return F.decode(F.try_to_binary(padded, F.lit("base64")), "ISO-8859-1")

    read = F.transform(long, lambda p: F.struct(p["name"].alias("name"), decoded(p["value"]).alias("text")))
    found = F.filter(read, lambda p: p["text"].rlike(r"^[\x20-\x7E]+$") & p["text"].rlike("http|password|login"))
    return F.transform(found, lambda p: F.struct(p["name"].alias("name"), F.substring(p["text"], 1, 200).alias("text")))
