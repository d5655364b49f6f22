"""The library's registered queries (named by inventory id) and DuckDB SQL for each.

Detector queries run over whole tables; their inputs are variants of each row, chosen by its id with one SQL text that
both engines read, since the plain rows have no forms, brands or addresses of the kinds that the rules look for.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom import config
from riskloom.functions import markup, urls
from riskloom.operators import cascade, history, profile, scoring, vectors
from riskloom.sources import scratch, verdicts

#: Reserved names only, besides the brand tokens that the rules need.
URL_CASES = """SELECT page_id, CASE page_id % 9
  WHEN 0 THEN url WHEN 1 THEN 'http://192.0.2.' || CAST(page_id % 250 AS VARCHAR(9)) || '/login?id=' || CAST(page_id AS VARCHAR(9)) WHEN 2 THEN 'https://paypal-secure-' || CAST(page_id AS VARCHAR(9)) || '.example.com/verify?next=http://x.test/'
  WHEN 3 THEN 'http://user@evil.example.com/a//' || CAST(page_id AS VARCHAR(9)) WHEN 4 THEN 'https://a.b.c.d.example.net/account/update' WHEN 5 THEN 'https://bit.ly/' || CAST(page_id AS VARCHAR(9))
  WHEN 6 THEN 'https://xn--example-' || CAST(page_id AS VARCHAR(9)) || '.test/' WHEN 7 THEN 'https://login.google.' || CASE WHEN page_id % 2 = 0 THEN 'pay-example.xyz' ELSE 'my-google.co.uk' END || '/banking' ELSE 'https://www.google.com/search?q=a%20b&x=1' END AS url FROM {pages}"""
_CASES = "cases AS (" + URL_CASES.format(pages="pages") + ")"
_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
PHRASES = ("verify your account", "account suspended", "legal action", "sign in to continue", "enter your password", "expires in 3 days", "police report", "plain words")
TEXT_CASES = "SELECT doc_id, CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN '{p}; ' || '{PHRASES[(k * 3 + 1) % 8]} ' || lang" for k, p in enumerate(PHRASES)) + " ELSE '' END AS t FROM {documents}"


def _load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(URL_CASES, pages=_load(spark, sf_dir, "pages").select("page_id", "url"))
    return rows.withColumn("host", urls.host(F.col("url")))


QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _sql_flags() -> str:
    short = ", ".join(f"'{s}'" for s in config.SHORTENERS)
    brand = "CASE " + " ".join(f"WHEN contains(host, '{b}') AND NOT ends_with(host, '.{b}.com') AND host <> '{b}.com' THEN 'brand_impersonation_{b}'" for b in config.OBFUSCATION_BRANDS) + " END"
    return f"""{_CASES}, h AS (SELECT *, {_HOST} AS host FROM cases), f AS (SELECT *, list_filter([
      CASE WHEN host IN ({short}) THEN 'url_shortener' END, CASE WHEN regexp_matches(host, '^([0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}$') THEN 'ip_based_url' END, CASE WHEN contains(host, 'xn--') THEN 'idn_homograph' END,
      CASE WHEN len(string_split(host, '.')) > 4 THEN 'excessive_subdomains' END, CASE WHEN len(regexp_extract_all(url, 'https?://')) > 1 THEN 'url_in_url_redirect' END, CASE WHEN regexp_matches(url, 'https?://[^@]+@') THEN 'at_symbol_trick' END, {brand}], lambda x: x IS NOT NULL) AS flags FROM h),
    s AS (SELECT *, least(1.0, {" + ".join(f"CASE WHEN list_contains(flags, '{k}') THEN {v} ELSE 0 END" for k, v in urls.FLAG_SCORES.items())} + CASE WHEN len(list_filter(flags, lambda x: starts_with(x, 'brand_'))) > 0 THEN 1.0 ELSE 0 END) AS score FROM f)"""


@query(f"""WITH {_sql_flags()}, v AS (SELECT *, list_contains(flags, 'ip_based_url') AS ip FROM s), w AS (SELECT *, least(1.0, round(score * 0.20 + CASE WHEN ip THEN 0.20 ELSE 0 END, 3)) AS l2 FROM v)
SELECT page_id, url, host, round(score, 3) AS obfuscation_score, array_to_string(flags, ',') AS flags, l2 AS l2_score, CASE WHEN l2 < 0.2 THEN 'SAFE' WHEN l2 >= 0.85 THEN 'MALICIOUS' ELSE 'SUSPICIOUS' END AS verdict FROM w""")
def A11_url_risk(spark, sf_dir):
    rows = _cases(spark, sf_dir).withColumn("flags", urls.obfuscation_flags(F.col("url"), F.col("host"))).withColumn("s", urls.flag_score(F.col("flags")))
    l2 = scoring.weighted({"url_obfuscation": F.col("s"), "ip_based_url": F.array_contains("flags", "ip_based_url")})
    return rows.select("page_id", "url", "host", F.round("s", 3).alias("obfuscation_score"), F.array_join("flags", ",").alias("flags"), l2.alias("l2_score"), scoring.l2_verdict(l2).alias("verdict"))


#: Registered domain of a host.
_OWN = "(CASE WHEN regexp_matches(host, '^([0-9]{1,3}\\.){3}[0-9]{1,3}$') THEN host WHEN array_to_string(string_split(host, '.')[-2:], '.') IN (" + ", ".join(f"'{t}'" for t in config.TWO_LABEL_TLDS) + ") THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE array_to_string(string_split(host, '.')[-2:], '.') END)"


@query(f"""WITH {_CASES}, h AS (SELECT *, {_HOST} AS host, length(url) AS n FROM cases), c AS (SELECT h.*, k.c, k.n AS k FROM h, LATERAL (SELECT c, count(*) AS n FROM (SELECT unnest(string_split(h.url, '')) AS c) GROUP BY c) k),
e AS (SELECT page_id, sum(-(k / n) * log2(k / n)) AS e FROM (SELECT page_id, k::DOUBLE AS k, n::DOUBLE AS n FROM c) GROUP BY page_id)
SELECT page_id, n AS url_length, round(e, 4) AS entropy, round(len(regexp_extract_all(url, '[0-9]'))::DOUBLE / n, 4) AS digit_ratio, round(len(regexp_extract_all(url, '[A-Za-z]'))::DOUBLE / n, 4) AS letter_ratio,
{", ".join(f"len(string_split(url, '{c}')) - 1 AS {k}" for k, c in (("n_dots", "."), ("n_slashes", "/"), ("n_hyphens", "-"), ("n_equals", "="), ("n_question", "?"), ("n_amp", "&"), ("n_percent", "%")))},
greatest(0, len(regexp_extract_all(url, '//')) - 1) AS n_double_slash, {" + ".join(f"contains(lower(url), '{w}')::BIGINT" for w in config.SENSITIVE_WORDS)} AS sensitive_words, contains(url, '@') AS has_at,
contains({_OWN}, '-') AND ({" OR ".join(f"contains({_OWN}, '{b}')" for b in config.OBFUSCATION_BRANDS)}) AS prefix_suffix_hyphen FROM h JOIN e USING (page_id)""")
def F1_url_structure(spark, sf_dir):
    return _cases(spark, sf_dir).select("page_id", *[c.alias(k) for k, c in urls.structure(F.col("url"), F.col("host")).items()])


_TLD = "(CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN (" + ", ".join(f"'{t}'" for t in config.TWO_LABEL_TLDS) + ") THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE string_split(host, '.')[-1] END)"
_RISK = "CASE " + " ".join(f"WHEN tld IN ({', '.join(repr(n) for n in names)}) THEN {risk}" for risk, names in config.TLD_RISK.items()) + " ELSE 0.1 END"


@query(f"WITH {_CASES}, h AS (SELECT *, {_HOST} AS host FROM cases), t AS (SELECT page_id, {_TLD} AS tld FROM h) SELECT page_id, tld, CAST({_RISK} AS DOUBLE) AS risk, {_RISK} >= 0.3 AS suspicious FROM t")
def A10_tld_risk(spark, sf_dir):
    t = urls.tld(F.col("host"))
    return _cases(spark, sf_dir).select("page_id", t.alias("tld"), urls.tld_risk(t).alias("risk"), (urls.tld_risk(t) >= config.TLD_SUSPICIOUS_FROM).alias("suspicious"))


def _hits_sql(patterns) -> str:
    return " + ".join("regexp_matches(t, '(?i)" + p + "')::BIGINT" for p in patterns)


@query(f"""WITH c AS ({TEXT_CASES.format(documents="documents")}), h AS (SELECT doc_id, CASE WHEN length(t) >= 10 THEN {_hits_sql(config.URGENCY_PATTERNS)} END AS u, CASE WHEN length(t) >= 10 THEN {_hits_sql(config.FEAR_PATTERNS)} END AS f, CASE WHEN length(t) >= 10 THEN {_hits_sql(config.CREDENTIAL_PATTERNS)} END AS k FROM c)
SELECT doc_id, u AS urgency_hits, f AS fear_hits, k AS credential_hits, round(least(1.0, coalesce(0.15 * u + 0.2 * f + 0.15 * k, 0)), 3)::DOUBLE AS pattern_score FROM h""")
def A3_text_patterns(spark, sf_dir):
    rows = spark.sql(TEXT_CASES, documents=_load(spark, sf_dir, "documents").select("doc_id", "lang"))
    return rows.select("doc_id", *[(c.cast("long") if k.endswith("hits") else c).alias(k) for k, c in scoring.patterns(F.col("t")).items()])


@query("""WITH p AS (SELECT doc_id, (doc_id % 11) / 10.0::DOUBLE AS fear, (doc_id % 7) / 7.0::DOUBLE AS form, (doc_id % 5) / 5.0::DOUBLE AS ocr, (doc_id % 13) / 13.0::DOUBLE AS visual, (doc_id % 17) / 17.0::DOUBLE AS l2 FROM documents),
q AS (SELECT *, (0.25 * fear + 0.30 * form + 0.20 * ocr + 0.25 * visual) / 1.0 AS l3, (fear > 0)::INT + (form > 0)::INT + (ocr > 0)::INT + (visual > 0)::INT AS fired FROM p),
r AS (SELECT *, l2 * (CASE WHEN fired = 0 THEN 0.85 ELSE 0.3 END)::DOUBLE + l3 * (1 - (CASE WHEN fired = 0 THEN 0.85 ELSE 0.3 END)::DOUBLE) AS final FROM q),
s AS (SELECT *, CASE WHEN final < 0.30 THEN 'SAFE' WHEN final >= 0.70 THEN 'MALICIOUS' ELSE 'SUSPICIOUS' END AS plain FROM r),
t AS (SELECT *, least(0.5 + abs(final - 0.5), CASE WHEN plain = 'SAFE' THEN 0.75 + 0.22 * fired / 4.0 ELSE 0.45 + 0.52 * fired / 4.0 END) AS conf FROM s)
SELECT doc_id, round(final, 4) AS final_score, CASE WHEN visual >= 0.82 THEN 'MALICIOUS' ELSE plain END AS verdict, round(CASE WHEN visual >= 0.82 THEN least(1.0, conf + 0.15) ELSE conf END, 4)::DOUBLE AS confidence FROM t""")
def A16_score_fusion(spark, sf_dir):
    share = lambda k, of: F.col("doc_id") % k / float(of)
    parts = {"fear_score": share(11, 10), "form_score": share(7, 7), "ocr_score": share(5, 5), "visual_score": share(13, 13)}
    return _load(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in scoring.fused(parts, share(17, 17)).items()])


@query("""WITH f AS (SELECT page_id, url, CASE WHEN page_id % 4 = 0 THEN 'http://collector.test/x.php' WHEN page_id % 4 = 1 THEN '/login' WHEN page_id % 4 = 2 THEN '#' ELSE 'https://formspree.io/f' END AS action, CASE WHEN page_id % 3 = 0 THEN 'post' ELSE 'get' END AS method, page_id % 2 AS pw, page_id % 6 AS hidden FROM pages),
g AS (SELECT *, lower(regexp_extract(action, '^(https?://[^/?#]*)', 1)) AS origin, lower(regexp_extract(url, '^(https?://[^/?#]*)', 1)) AS page FROM f)
SELECT page_id, round(least(1.0, 0.3 * (pw > 0)::INT + 0.5 * (origin <> '' AND origin <> page)::INT + 0.4 * (starts_with(url, 'https:') AND starts_with(action, 'http:'))::INT + 0.35 * regexp_matches(action, '(?i)formspree\\.io|\\.php$')::INT + 0.2 * (method = 'post' AND pw > 0)::INT + 0.15 * (hidden > 3)::INT + 0.1 * (trim(action) IN ('', '#'))::INT), 3)::DOUBLE AS form_score,
starts_with(action, 'http') AND regexp_extract(action, '^https?://([^/?#:]*)', 1) <> regexp_extract(url, '^https?://([^/?#:]*)', 1) AS cross_origin_form, starts_with(url, 'https:') AND starts_with(action, 'http:') AS https_downgrade FROM g""")
def A12_form_behaviour(spark, sf_dir):
    i = F.col("page_id")
    form = F.struct(F.when(i % 4 == 0, "http://collector.test/x.php").when(i % 4 == 1, "/login").when(i % 4 == 2, "#").otherwise("https://formspree.io/f").alias("action"), F.when(i % 3 == 0, "post").otherwise("get").alias("method"), (i % 2).alias("n_password"), (i % 6).alias("n_hidden"))
    rows = _load(spark, sf_dir, "pages").select("page_id", "url", F.array(form).alias("forms")).withColumn("origin", F.lower(F.regexp_extract("url", "^(https?://[^/?#]*)", 1)))
    scores = F.transform("forms", lambda f: scoring.form_score(f, F.col("origin"), F.col("url")))
    return rows.select("page_id", scoring.forms_score(scores).alias("form_score"), *[c.alias(k) for k, c in scoring.form_signals(F.col("forms"), F.col("url"), urls.host(F.col("url"))).items()])


HISTORY = """SELECT event_id, user_id, ts, CASE event_type WHEN 'error' THEN 'MALICIOUS' WHEN 'click' THEN 'SUSPICIOUS' ELSE 'SAFE' END AS verdict, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'h' || CAST(event_id % 3 AS VARCHAR(4)) END AS html_hash, value FROM {events}"""


def _history(spark, sf_dir):
    return spark.sql(HISTORY, events=_load(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value"))


_HISTORY = "h AS (" + HISTORY.format(events="events") + ")"
_TTL = "CASE WHEN verdict = 'MALICIOUS' THEN 259200 ELSE 86400 END"


_NOW = "2024-01-20 00:00:00"
#: History as entries of the store: one in five invalidates, and one in ten has the features of an older version.
ENTRIES = f"SELECT user_id, event_id, ts, CASE WHEN value IS NULL THEN NULL WHEN event_id % 10 = 3 THEN 1 ELSE 2 END AS cache_version, event_id % 5 = 4 AS deleted, verdict FROM ({HISTORY})"
_STANDING = f"""l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM ({ENTRIES.format(events="events")}) WHERE ts <= TIMESTAMP '{_NOW}'),
k AS (SELECT *, epoch_us(TIMESTAMP '{_NOW}') - epoch_us(ts) AS age FROM l WHERE r = 1 AND NOT deleted AND cache_version = 2)"""


def _entries(spark, sf_dir):
    return spark.sql(ENTRIES, events=_load(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value"))


@query(f"WITH {_STANDING} SELECT user_id, event_id, verdict FROM k WHERE age < {_TTL} * 1000000::BIGINT")
def C3_cache_lookup(spark, sf_dir):
    """The last entry of each user decides; deleted, old or expired, it is a miss, whatever stood before."""
    return history.latest(_entries(spark, sf_dir), "user_id", "ts", _NOW, "event_id", version=2).select("user_id", "event_id", "verdict")


@query(f"WITH {_STANDING} SELECT sha256('scan:' || CAST(user_id AS VARCHAR)) AS cache_key, event_id, verdict FROM k WHERE age < {_TTL} * 1000000::BIGINT")
def S10_stored_verdicts(spark, sf_dir):
    """The same through a store on files: written in two parts, invalidated, compacted between, then looked up."""
    path = f"{scratch.folder(spark)}/verdicts-{uuid.uuid4().hex}"
    rows = _entries(spark, sf_dir).withColumn("url", F.col("user_id").cast("string")).withColumn("cache_key", history.cache_key(F.col("url")))
    written = rows.where("NOT deleted").drop("deleted", "user_id", "url").withColumn("deleted", F.lit(False))
    verdicts.put(written.where("event_id % 2 = 0 AND ts <= TIMESTAMP '2024-01-15 00:00:00'"), path)
    verdicts.invalidate(rows.where("deleted AND ts <= TIMESTAMP '2024-01-15 00:00:00'"), path, "ts", "event_id")
    verdicts.compact(spark, path, "ts", "event_id", "2024-01-15 00:00:00")
    verdicts.put(written.where("event_id % 2 = 1 OR ts > TIMESTAMP '2024-01-15 00:00:00'"), path)  # half of the old ones come late
    verdicts.invalidate(rows.where("deleted AND ts > TIMESTAMP '2024-01-15 00:00:00'"), path, "ts", "event_id")
    return verdicts.look_up(spark, path, "ts", "event_id", _NOW, 2).select("cache_key", "event_id", "verdict")


#: Each observation meets the entry that was written last; one after the other.
_FOLD = """r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM h)"""


@query(f"""WITH RECURSIVE {_HISTORY}, {_FOLD}, f AS (SELECT event_id, user_id, n, 'scan' AS action, verdict AS v, html_hash AS held, ts AS t FROM r WHERE n = 1 UNION ALL
SELECT event_id, user_id, n, action, CASE WHEN w THEN verdict ELSE v END, CASE WHEN w THEN html_hash ELSE held END, CASE WHEN w THEN ts ELSE t END FROM (SELECT *, action IN ('scan', 'rescan', 'invalidate_rescan') AS w FROM (SELECT r.*, f.v, f.held, f.t,
CASE WHEN epoch_us(r.ts) - epoch_us(f.t) >= 1000000::BIGINT * CASE WHEN f.v = 'MALICIOUS' THEN 259200 ELSE 86400 END THEN 'scan' WHEN f.v = 'SAFE' AND f.held IS NULL THEN 'rescan'
WHEN f.v = 'SAFE' OR (f.v = 'MALICIOUS' AND f.held IS NOT NULL AND epoch_us(r.ts) - epoch_us(f.t) > 86400000000) THEN CASE WHEN f.held = r.html_hash THEN 'recheck_serve' ELSE 'invalidate_rescan' END ELSE 'serve' END AS action FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)))
SELECT event_id, action FROM f""")
def C5_revalidation(spark, sf_dir):
    return history.revalidation(_history(spark, sf_dir), "user_id", "ts", "event_id").select("event_id", "action")


@query("SELECT user_id, date_trunc('hour', ts) AS window_start, count(*) AS n, least(count(*), 2) AS allowed, greatest(count(*) - 2, 0) AS rejected FROM events GROUP BY 1, 2")
def C7_rate_limit(spark, sf_dir):
    return history.rate_limited(_load(spark, sf_dir, "events"), "user_id", "ts", 2, "1 hour")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def W4_history_cap(spark, sf_dir):
    return history.newest(_load(spark, sf_dir, "events").select("event_id", "ts"), [F.desc("ts"), F.desc("event_id")], 100)


@query("SELECT event_id, sha256('scan:' || CAST(user_id AS VARCHAR) || ':' || event_type) AS cache_key FROM events")
def C1_cache_key(spark, sf_dir):
    return _load(spark, sf_dir, "events").select("event_id", history.cache_key(F.concat_ws(":", F.col("user_id").cast("string"), "event_type")).alias("cache_key"))


@query(f"WITH {_HISTORY} SELECT count(*) AS total, count(*) FILTER (verdict <> 'SAFE') AS threats, count(*) FILTER (verdict = 'SAFE') AS safe, CAST(floor(avg(coalesce(value, 0)) + 0.5) AS BIGINT) AS mean_ms FROM h")
def A19_dashboard_stats(spark, sf_dir):
    h = _history(spark, sf_dir)
    return h.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("verdict") != "SAFE").alias("threats"), F.count_if(F.col("verdict") == "SAFE").alias("safe"), F.floor(F.avg(F.coalesce("value", F.lit(0.0))) + 0.5).alias("mean_ms"))


@query("SELECT 'lang' AS \"column\", lang AS value, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 4)::DOUBLE AS share FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*), round(count(*)::DOUBLE / sum(count(*)) OVER (), 4)::DOUBLE FROM documents GROUP BY source")
def A20_group_shares(spark, sf_dir):
    return profile.shares(_load(spark, sf_dir, "documents").select("lang", "source"), ["lang", "source"])


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic")
def A22_label_counts(spark, sf_dir):
    return _load(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_HISTORY} SELECT 'verdict' AS \"column\", count(*) - count(verdict) AS n_null, round((count(*) - count(verdict)) * 100.0::DOUBLE / count(*), 4)::DOUBLE AS percent FROM h UNION ALL SELECT 'html_hash', count(*) - count(html_hash), round((count(*) - count(html_hash)) * 100.0::DOUBLE / count(*), 4)::DOUBLE FROM h")
def A23_null_profile(spark, sf_dir):
    return profile.nulls(_history(spark, sf_dir).select("verdict", "html_hash"))


@query("SELECT quality, count(*) AS n, round(avg(n_chars), 3) AS mean, min(n_chars) AS least, max(n_chars) AS most, quantile_cont(n_chars, 0.25)::DOUBLE AS q1, quantile_cont(n_chars, 0.5)::DOUBLE AS median, quantile_cont(n_chars, 0.75)::DOUBLE AS q3 FROM documents JOIN labels USING (doc_id) GROUP BY quality")
def A24_class_distribution(spark, sf_dir):
    rows = _load(spark, sf_dir, "documents").select("doc_id", "n_chars").join(_load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return profile.class_distribution(rows, "quality", "n_chars")


@query("SELECT event_id, coalesce(CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END, (SELECT quantile_cont(value, 0.5) FROM events WHERE event_id % 5 <> 0)) AS value, CASE WHEN event_id % 4 = 0 THEN 'unknown' ELSE event_type END AS event_type FROM events")
def A25_median_imputation(spark, sf_dir):
    rows = _load(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("event_type"))
    return profile.imputed(rows, ["value"], ["event_type"])


@query("""WITH s AS (SELECT quality AS y, (doc_id % 100) / 100.0::DOUBLE AS s FROM labels), c AS (SELECT count(*) FILTER (y = 1 AND s >= 0.5) AS tp, count(*) FILTER (y = 0 AND s >= 0.5) AS fp, count(*) FILTER (y = 1 AND s < 0.5) AS fn, count(*) FILTER (y = 0 AND s < 0.5) AS tn FROM s),
u AS (SELECT sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) AS u FROM s a, s b WHERE a.y = 1 AND b.y = 0)
SELECT tp, fp, fn, tn, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) AS accuracy, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall, round(2 * tp::DOUBLE / (2 * tp + fp + fn), 6) AS f1, round(u::DOUBLE / ((tp + fn) * (fp + tn)), 6) AS auc FROM c, u""")
def A26_metrics(spark, sf_dir):
    return profile.metrics(_load(spark, sf_dir, "labels"), F.col("quality"), F.col("doc_id") % 100 / 100.0)


@query("""WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, quality, CASE WHEN r <= round(n * 0.65) THEN 0 WHEN r <= round(n * 0.8) THEN 1 ELSE 2 END::BIGINT AS part FROM r""")
def K2_stratified_split(spark, sf_dir):
    return profile.stratified(_load(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id", [0.65, 0.15, 0.20])


@query("""WITH c AS (SELECT label, list(s ORDER BY i) AS c FROM (SELECT label, i, sum(x) AS s FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY label, i) GROUP BY label),
s AS (SELECT e.vec_id, c.label, list_cosine_similarity(list_transform(e.embedding, lambda x: x::DOUBLE), c.c) AS sim FROM embeddings e, c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS k FROM s) SELECT vec_id, label AS brand, round(sim, 4) AS similarity, k AS place FROM r WHERE k <= 3""")
def J9_nearest_brand(spark, sf_dir):
    """Each vector's three nearest centroids."""
    rows = _load(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    known = vectors.centroids(rows, "label", "embedding").select(F.col("label").alias("brand"), F.col("embedding").alias("centre"))
    near = vectors.nearest(rows, "vec_id", "embedding", known, "brand", "centre", 3)
    return near.select("vec_id", "brand", F.round("similarity", 4).alias("similarity"), "place")


_EVEN = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_BARE = "regexp_replace(html, '(?i)<script[\\s\\S]*?</script>', '', 'g')"
_BODY = "'(?i)<body[\\s\\S]*?>([\\s\\S]*)</body>'"


@query(f"""SELECT page_id, sha256(html) AS raw_hash, sha256({_EVEN.format("regexp_replace(html, '(?i)<script[^>]*>[" + chr(92) + "s" + chr(92) + "S]*?</script>', '', 'g')")}) AS content_hash, sha256({_EVEN.format(f"CASE WHEN regexp_matches({_BARE}, {_BODY}) THEN regexp_extract({_BARE}, {_BODY}, 1) ELSE {_BARE} END")}) AS body_hash,
len(regexp_extract_all(html, '(?i)<a\\s')) AS n_anchors, len(regexp_extract_all(html, '(?i)<script')) AS n_scripts, contains(lower(html), 'about:blank') AS about_blank FROM pages""")
def H16_page_fingerprint(spark, sf_dir):
    rows = _load(spark, sf_dir, "pages")
    return rows.select("page_id", *[c.alias(k) for k, c in markup.content_hashes(F.col("html")).items()], F.regexp_count("html", F.lit(r"(?i)<a\s")).cast("long").alias("n_anchors"), F.regexp_count("html", F.lit("(?i)<script")).cast("long").alias("n_scripts"), F.lower("html").contains("about:blank").alias("about_blank"))


@query("SELECT event_id, CASE WHEN event_type = 'signup' AND coalesce(value, 0) = 0 THEN 100 ELSE greatest(0, least(100, floor((1 - s) * 100 + 0.5))) END::BIGINT AS safety FROM (SELECT *, (event_id % 101) / 100.0::DOUBLE AS s FROM events)")
def F31_safety_score(spark, sf_dir):
    return _load(spark, sf_dir, "events").select("event_id", scoring.safety(F.when((F.col("event_type") == "signup") & (F.coalesce("value", F.lit(0.0)) == 0), "SAFE").otherwise("SUSPICIOUS"), F.when((F.col("event_type") == "signup") & (F.coalesce("value", F.lit(0.0)) == 0), 0.0).otherwise(F.col("event_id") % 101 / 100.0)).alias("safety"))


@query("SELECT event_id, floor((epoch_ms(TIMESTAMP '2024-02-01 00:00:00') - epoch_ms(ts)) / 86400000.0 + 0.5)::BIGINT AS age_days, epoch_ms(TIMESTAMP '2024-02-01 00:00:00') - epoch_ms(ts) < 7 * 86400000 AS under_7, epoch_ms(TIMESTAMP '2024-02-01 00:00:00') - epoch_ms(ts) < 30::BIGINT * 86400000 AS under_30 FROM events")
def E2_age_days(spark, sf_dir):
    ms = F.unix_millis(F.lit("2024-02-01 00:00:00").cast("timestamp")) - F.unix_millis(F.col("ts").cast("timestamp"))
    return _load(spark, sf_dir, "events").select("event_id", F.floor(ms / 86400000.0 + 0.5).alias("age_days"), (ms < 7 * 86400000).alias("under_7"), (ms < 30 * 86400000).alias("under_30"))


@query("WITH c AS (SELECT event_type AS model, round(avg(value), 6) AS combined FROM events GROUP BY 1) SELECT model, combined, rank() OVER (ORDER BY combined DESC) AS \"rank\" FROM c")
def A27_model_rank(spark, sf_dir):
    return profile.model_ranks(_load(spark, sf_dir, "events"), "event_type", "value")


@query("SELECT p_partkey, round(p_retailprice / max(p_retailprice) OVER (), 3) AS scaled FROM part")
def A28_max_scaling(spark, sf_dir):
    return profile.scaled_to_max(_load(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "scaled").drop("p_retailprice")


@query("SELECT c_custkey, CASE WHEN r <= 10 THEN 'top1k' WHEN r <= 100 THEN 'top10k' ELSE 'none' END AS bucket FROM (SELECT c.c_custkey, coalesce(k.r, 1000000) AS r FROM customer c LEFT JOIN (SELECT o_custkey, rank() OVER (ORDER BY n DESC, o_custkey) AS r FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)) k ON c.c_custkey = k.o_custkey)")
def J2_rank_bucket(spark, sf_dir):
    """Only the first 100 of the ranking matter, so it is a top-k, and its 100 rows are broadcast."""
    top = _load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "o_custkey").limit(100)
    ranked = top.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "o_custkey"))).select(F.col("o_custkey").alias("c_custkey"), "r")
    return cascade.rank_bucket(_load(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", ranked, "r", ((10, "top1k"), (100, "top10k")))
