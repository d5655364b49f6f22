"""Queries of the brand layers over addresses and markup of every page, with DuckDB SQL that works the layers out anew.

The tables' pages name no brands, so each page's own address and text are joined by names, domains and trust words of the catalogue,
chosen by its id.  One rule makes the inputs for both engines.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from riskloom import config
from riskloom.functions import urls
from riskloom.operators import brands, domain_index
from riskloom.plans.queries import _RISK, _load, query

CAT = brands.CATALOGUE
NAMES = sorted(CAT)
VARIANTS = sorted({(v, b) for b, (_, aliases, _c) in CAT.items() for v in (b, *aliases) if len(v) >= 3})
DOMAINS = [(d, b) for b, (ds, *_) in CAT.items() for d in ds]
TOKENS = sorted({(b, re.sub("[-_0-9]", "", t)) for b, (_, aliases, _c) in CAT.items() for t in (b, *aliases)} - {(b, "") for b in CAT})

#: {name(k)}, {variant(k)}, {domain(k)} and {trust(k)} are the k-th of each list; || and CASE are the same in both engines.
_HOSTS = """CASE page_id % 8 WHEN 1 THEN 'www.' || {domain:page_id} WHEN 2 THEN {name:page_id} || '-' || {trust:page_id * 3} || '-' || {trust:page_id * 5 + 1} || '.example.com' WHEN 3 THEN 'login.' || {name:page_id * 7} || '.evil.test'
WHEN 4 THEN 'my-' || {name:page_id * 11} || CAST(page_id % 10 AS VARCHAR(3)) || '-shop.xyz' WHEN 5 THEN {domain:page_id * 13} || '.phish.tk' WHEN 6 THEN {domain:page_id * 17} ELSE {own} END"""
_SAID = """{text} || CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN ' Welcome to ' || {variant:page_id} WHEN 2 THEN ' x' || {variant:page_id * 3} || ' of ' || {name:page_id * 7} || '!' WHEN 3 THEN ' ' || {name:page_id} || ', ' || {variant:page_id * 5} || ';' || {variant:page_id * 9}
WHEN 4 THEN ' (' || {name:page_id * 11} || ')' ELSE ' ' || {variant:page_id * 19} || '_' || {variant:page_id * 2} END"""
_ANCHORS = (
    ("'https://help.' || {domain:page_id * 3} || '/x'", "'Visit ' || {variant:page_id * 23} || ' and ' || {name:page_id * 3}"), ("'/rel/' || CAST(page_id AS VARCHAR(20))", "{variant:page_id * 29}"), ("'http://' || {name:page_id * 31} || '-help.test/a'", "'Get ' || {name:page_id * 31}"),
    ("'http://www.' || {name:page_id * 31} || '-help.test/b'", "'More ' || {name:page_id * 31}"), ("'https://user.github.io/' || {name:page_id}", "'See ' || {name:page_id * 37}"), ("''", "{name:page_id}"), ("'https://z.' || {name:page_id * 2} || '-pay.web.app'", "'Pay ' || {name:page_id * 2}"),
)


def _filled(rule: str, duck: bool) -> str:
    """The rule in the SQL of one engine."""
    lists = {"name": NAMES, "variant": [v for v, _ in VARIANTS], "domain": [d for d, _ in DOMAINS], "trust": [t for t in config.TRUST_WORDS if "-" not in t]}

    def pick(m):
        words = lists[m[1]]
        listed = ", ".join(f"'{w}'" for w in words)
        at = f"({m[2]}) % {len(words)} + 1"
        return f"([{listed}])[({at})::BIGINT]" if duck else f"element_at(array({listed}), CAST({at} AS INT))"

    own, text = (r"lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1))", r"regexp_replace(html, '<[^>]*>', ' ', 'g')") if duck else (r"lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1))", r"regexp_replace(html, '<[^>]*>', ' ')")
    return re.sub(r"\{(name|variant|domain|trust):([^}]*)\}", pick, rule).replace("{own}", own).replace("{text}", text)


def _rows(spark, sf_dir):
    struct = ", ".join(f"named_struct('href', {_filled(h, False)}, 'text', {_filled(t, False)})" for h, t in _ANCHORS)
    return _load(spark, sf_dir, "pages").selectExpr("page_id", f"{_filled(_HOSTS, False)} AS host", f"{_filled(_SAID, False)} AS text", f"array({struct}) AS anchors")


def _values(rows, names: str) -> str:
    quoted = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + f") AS t({names})"


_PATTERN = [(v, b, "(?:^|[^a-z0-9_])" + re.escape(v).replace("/", "\\/") + "(?:[^a-z0-9_]|$)") for v, b in VARIANTS]
_NAMED = ", ".join(f"'{n}'" for n in NAMES)
_PAIRS = ", ".join(f"'{t}'" for t in config.TWO_LABEL_TLDS)


def _registered(host: str) -> str:
    last = lambda k: f"array_to_string(string_split({host}, '.')[-{k}:], '.')"
    return f"(CASE WHEN regexp_matches({host}, '^([0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}$') THEN {host} WHEN {last(2)} IN ({_PAIRS}) THEN {last(3)} ELSE {last(2)} END)"


_SQL = f"""WITH cases AS (SELECT page_id, {_filled(_HOSTS, True)} AS host, {_filled(_SAID, True)} AS said FROM pages),
variants AS (SELECT * FROM {_values(_PATTERN, "v, b, p")}), domains AS (SELECT * FROM {_values(DOMAINS, "d, b")}), tokens AS (SELECT * FROM {_values(TOKENS, "b, t")}),
named AS (SELECT page_id, list_sort(list(DISTINCT b)) AS brands FROM cases JOIN variants ON regexp_matches(lower(said), p) GROUP BY page_id),
page AS (SELECT c.page_id, c.host, coalesce(n.brands, []) AS brands, n.brands[1] AS brand FROM cases c LEFT JOIN named n USING (page_id)),
owned AS (SELECT DISTINCT page_id FROM page p JOIN domains d ON d.b = p.brand AND (p.host = d.d OR ends_with(p.host, '.' || d.d))),
spoofed AS (SELECT DISTINCT page_id FROM (SELECT page_id, brand, regexp_replace(unnest(string_split(host, '.')), '[-_0-9]', '', 'g') AS label FROM page) l JOIN tokens t ON t.b = l.brand AND (starts_with(l.label, t.t) OR ends_with(l.label, t.t))),
one AS (SELECT page_id, host, brands, brand, CASE WHEN brand IS NULL OR page_id IN (SELECT page_id FROM owned) THEN 0 WHEN page_id IN (SELECT page_id FROM spoofed) THEN 0.95 WHEN contains(host, brand) THEN 0.85 ELSE round(least(0.9, len(brands) * 0.15::DOUBLE + 0.4), 3) END::DOUBLE AS page_score FROM page),
links AS ({" UNION ALL ".join(f"SELECT p.page_id, {k} AS i, {_filled(h, True)} AS href, {_filled(t, True)} AS words, c.host FROM pages p JOIN cases c USING (page_id)" for k, (h, t) in enumerate(_ANCHORS))}),
marked AS (SELECT page_id, i, href, words, host, arg_min(b, (-length(v), b)) AS brand FROM links JOIN variants ON regexp_matches(lower(words), p) WHERE href <> '' GROUP BY page_id, i, href, words, host),
led AS (SELECT page_id, i, brand, CASE WHEN starts_with(href, 'http') THEN {_registered("regexp_extract(href, '^[a-z]+://([^/?#:]*)', 1)")} ELSE {_registered("host")} END AS domain FROM marked),
astray AS (SELECT page_id, brand, domain, min(i) AS i FROM led l WHERE NOT EXISTS (SELECT 1 FROM domains d WHERE d.b = l.brand AND (l.domain = d.d OR ends_with(l.domain, '.' || d.d))) GROUP BY page_id, brand, domain),
weighed AS (SELECT page_id, brand, domain, i, CASE WHEN domain IN (SELECT d FROM domains) THEN 0.2 WHEN {" OR ".join(f"ends_with(domain, '{h}')" for h in config.FREE_HOSTING)} THEN 0.7 WHEN contains(domain, brand) THEN 0.9 ELSE 0.5 END::DOUBLE AS s FROM astray),
placed AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY s DESC, i) AS r FROM weighed),
two AS (SELECT page_id, round(least(1.0, sum(s * CASE WHEN r <= 3 THEN 1.0 ELSE 0.3 END::DOUBLE ORDER BY r) / 2.5)::DOUBLE::VARCHAR::DECIMAL(38, 18), 3)::DOUBLE AS anchor_score, count(*) AS n, string_agg(brand || '::' || domain, ',' ORDER BY r) AS off FROM placed GROUP BY page_id),
cut AS (SELECT page_id, host, brand, list_filter(regexp_split_to_array(host, '[^a-z0-9]'), lambda t: t <> '') AS tokens FROM one),
sorted_ AS (SELECT *, list_filter(tokens, lambda t: t IN ({_NAMED})) AS whole, list_filter(tokens, lambda t: NOT t IN ({_NAMED}) AND t IN ({", ".join(f"'{w}'" for w in config.TRUST_WORDS)})) AS trust FROM cut),
four AS (SELECT page_id, trust, CASE WHEN len(whole) > 0 THEN whole WHEN contains(host, brand) THEN [brand] ELSE [] END AS known FROM sorted_),
squat AS (SELECT page_id, CASE WHEN len(known) > 0 AND len(trust) > 0 THEN round(least(1.0, 0.5 + 0.2 * len(trust)), 3) ELSE 0 END::DOUBLE AS combosquat_score, CASE WHEN len(known) > 0 AND len(trust) > 0 THEN array_to_string(list_concat(known, trust), ' + ') END AS combosquat_pattern FROM four),
six AS (SELECT page_id, {_RISK}::DOUBLE AS risk FROM (SELECT page_id, CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN ({_PAIRS}) THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE string_split(host, '.')[-1] END AS tld FROM one))
SELECT page_id, array_to_string(o.brands, ',') AS brands, o.page_score, coalesce(t.anchor_score, 0)::DOUBLE AS anchor_score, coalesce(t.n, 0)::BIGINT AS n_anchors_off, coalesce(t.off, '') AS anchors_off, q.combosquat_score, q.combosquat_pattern,
round(least(1.0, 0.35 * o.page_score + 0.25 * coalesce(t.anchor_score, 0) + 0.10 * q.combosquat_score + 0.05 * x.risk)::DOUBLE::VARCHAR::DECIMAL(38, 18), 3)::DOUBLE AS mismatch FROM one o LEFT JOIN two t USING (page_id) JOIN squat q USING (page_id) JOIN six x USING (page_id)"""


@query(_SQL)
def A4_brand_mismatch(spark, sf_dir):
    """Layers 1, 2, 4 and 6 (A4, A5, A6, A8, J3-J6, T2); layers 3 and 5 have queries of their own and count 0 here."""
    rows = _rows(spark, sf_dir).withColumn("named", brands.mentions(F.col("text"))).withColumn("off", brands.anchors_off(F.col("anchors"), F.col("host")))
    rows = rows.withColumn("page_score", brands.page_mismatch(F.col("host"), F.col("named"))).withColumn("anchor_score", brands.anchor_score(F.col("off")))
    rows = rows.select("*", *[c.alias(n) for n, c in brands.combosquat(F.col("host"), brands.page_brand(F.col("named"))).items()])
    none = F.lit(0.0)
    mismatch = brands.composite([F.col("page_score"), F.col("anchor_score"), none, F.col("combosquat_score"), none, urls.tld_risk(urls.tld(F.col("host")))])
    pairs = F.array_join(F.transform("off", lambda m: F.concat_ws("::", m["brand"], m["domain"])), ",")
    return rows.select("page_id", F.array_join("named", ",").alias("brands"), "page_score", "anchor_score", F.size("off").cast("long").alias("n_anchors_off"), pairs.alias("anchors_off"), "combosquat_score", "combosquat_pattern", mismatch.alias("mismatch"))


_SUFFIXES = f"SELECT page_id, host, unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))) AS suffix FROM (SELECT page_id, {_filled(_HOSTS, True)} AS host FROM pages)"


@query(f"WITH x AS ({_SUFFIXES}), d AS (SELECT * FROM {_values([(d, b, CAT[b][2]) for d, b in DOMAINS], 'd, b, c')}) SELECT page_id, host, max(d || ' ' || b || ' ' || c) AS owner FROM x JOIN d ON x.suffix = d.d GROUP BY page_id, host")
def J5_host_suffix_match(spark, sf_dir):
    """Hosts on a brand's domain, with the brand and its category."""
    found = brands.owners_of(_rows(spark, sf_dir).select("page_id", "host"), "host")
    return found.groupBy("page_id", "host").agg(F.max(F.concat_ws(" ", "domain", "brand", "category")).alias("owner"))


#: How a domain is misspelt, by the page's id; the rule is plain SQL.
_MISSPELT = "CASE page_id % 5 WHEN 0 THEN {own} WHEN 1 THEN replace({domain:page_id}, 'a', '4') WHEN 2 THEN replace(replace({domain:page_id * 3}, 'o', '0'), 'e', '3') WHEN 3 THEN 'x' || {domain:page_id * 7} ELSE {name:page_id * 11} || CAST(page_id % 7 AS VARCHAR(3)) || '.test' END"


def A7_nearest_domain(spark, sf_dir):
    """Every page's own domain or a misspelt one of the catalogue; SQL's own measure differs, so tests hold this against plain search."""
    rows = _load(spark, sf_dir, "pages").selectExpr("page_id", f"{_filled(_MISSPELT, False)} AS host")
    near = rows.select("page_id", "host", brands.nearest(F.col("host")).alias("n"))
    return near.select("page_id", "host", "n.brand", "n.domain", "n.similarity", F.round("n.score", 3).alias("score"), "n.distance")


def A9_sounds_alike(spark, sf_dir):
    """The same hosts by sound, beside a brand named on every third page; tests hold it against plain comparison with all brands."""
    rows = _load(spark, sf_dir, "pages").selectExpr("page_id", f"{_filled(_MISSPELT, False)} AS host", f"CASE WHEN page_id % 3 = 0 THEN {_filled('{name:page_id * 3}', False)} END AS brand")
    return rows.select("page_id", "host", "brand", *[c.alias(k) for k, c in brands.sound_alike(F.col("host"), F.col("brand")).items()])


def J7_domain_index(spark, sf_dir):
    """The same hosts against a catalogue that is a table: the brands' domains and those of all pages; tests hold the index against plain search."""
    pages = _load(spark, sf_dir, "pages")
    own = pages.select(urls.registered(urls.host(F.col("url"))).alias("domain")).where("domain <> ''").distinct().select(F.col("domain").alias("brand"), "domain", (F.pmod(F.xxhash64("domain"), F.lit(1 << 40)) + 1000).alias("rank"))
    known = spark.createDataFrame([(b, d, k) for k, (d, b) in enumerate(DOMAINS)], "brand string, domain string, rank long")
    rows = pages.selectExpr("page_id", f"{_filled(_MISSPELT, False)} AS host")
    near = domain_index.nearest_in(rows, "host", known.unionByName(own))
    return near.withColumn("score", F.round("score", 3))


WITHOUT_SQL = {f.__name__: f for f in (A7_nearest_domain, A9_sounds_alike, J7_domain_index)}
