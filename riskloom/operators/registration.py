"""Features of registration records and of the repository behind a page.  Native expressions; no look-ups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import config
from riskloom.functions import urls


def _field(raw: Column, keys) -> Column:
    """The value of the first line that has one of the keys."""
    line = r"(?i)^\s*(?:" + "|".join(keys) + r")\s*:\s*(.+)\z"
    found = F.filter(F.split(raw, "\n"), lambda x: x.rlike(line) & (F.trim(F.regexp_extract(x, line, 1)) != ""))
    return F.trim(F.regexp_extract(F.get(found, F.lit(0)), line, 1))


def _date(text: Column) -> Column:
    """The first of four forms that can be read."""
    by = F.regexp_extract(text, r"(\d{2})-([A-Za-z]{3})-(\d{4})", 1), F.initcap(F.regexp_extract(text, r"(\d{2})-([A-Za-z]{3})-(\d{4})", 2)), F.regexp_extract(text, r"(\d{2})-([A-Za-z]{3})-(\d{4})", 3)
    tries = [(F.regexp_extract(text, p, 1), f) for p, f in ((r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})", "yyyy-MM-dd'T'HH:mm:ss"), (r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})", "yyyy-MM-dd HH:mm:ss"), (r"(\d{4}-\d{2}-\d{2})", "yyyy-MM-dd"))]
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for t, f in [*tries, (F.concat_ws("-", *by), "dd-MMM-yyyy")]])


def days(a: Column, b: Column) -> Column:
    """Days from a to b, rounded, halves up; null if either is."""
    return F.floor((F.unix_millis(b) - F.unix_millis(a)) / 86400000.0 + 0.5)


def registrar_kind(registrar: Column) -> Column:
    """Major before budget; unknown for others and null."""
    lower = F.lower(registrar)
    return F.when(urls.hits(lower, config.MAJOR_REGISTRARS) > 0, "major").when(urls.hits(lower, config.BUDGET_REGISTRARS) > 0, "budget").otherwise("unknown")


def features(raw: Column, now: Column, brand: Column) -> dict[str, Column]:
    """Eight features of a record; all null where there is none, and ages null where a date can't be read."""
    f = {k: _field(raw, keys) for k, keys in config.REGISTRATION_KEYS.items()}
    known = lambda c: F.when(raw.isNotNull(), c)
    return {
        "domain_age_days": days(_date(f["created"]), now), "domain_expiry_days": days(now, _date(f["expires"])), "days_since_last_update": days(_date(f["updated"]), now), "registrar_category": known(registrar_kind(f["registrar"])),
        "has_registrant_org": known(f["org"].isNotNull()), "has_registrant_email": known(f["email"].isNotNull()), "has_registrant_phone": known(f["phone"].isNotNull()), "domain_name_match": F.lower(f["org"]).contains(F.lower(brand)),
    }


def repository(url: Column) -> Column:
    """(owner, repo) that an address names, else null."""
    host, parts = urls.host(url), F.filter(F.split(urls.path(url), "/"), lambda p: p != "")
    pair = lambda a, b: F.struct(a.alias("owner"), b.alias("repo"))
    named = host.isin("github.com", "raw.githubusercontent.com") & (F.size(parts) >= 2)
    return F.when(named, pair(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))).when(host.endswith(".github.io") & (F.size(parts) >= 1), pair(F.replace(host, F.lit(".github.io"), F.lit("")), F.get(parts, F.lit(0))))


def repository_score(age_days: Column, commits: Column, has_password: Column, cross_origin: Column, url: Column) -> dict[str, Column]:
    """Risk of a page served from a repository; unknown age or commit count adds nothing."""
    critical = has_password & (url.contains("github.io") | url.contains("githubusercontent.com"))
    is_ = lambda c: F.coalesce(c, F.lit(False))
    score = F.when(is_(critical), 0.8).when(is_(has_password), 0.5).otherwise(0.0) + is_(cross_origin).cast("int") * 0.6 + is_(age_days < 7).cast("int") * 0.4 + is_(commits < 3).cast("int") * 0.3
    return {"critical_password": is_(critical), "repo_score": F.round(F.least(F.lit(1.0), score), 3)}


def bounded_counts(commits: Column, contributors: Column) -> dict[str, Column]:
    """A repository's commits and contributors as one page of each shows them: 10 and 5 at most."""
    return {"commit_count": F.least(commits, F.lit(10)), "contributor_count": F.least(contributors, F.lit(5))}
