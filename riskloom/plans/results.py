"""Queries of what a reader of a result sees, of page layout and of draws, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import layout, urls
from riskloom.operators import cascade, dashboard, extra_trees, history, lexicon, modelling, profile, suffix_rules
from riskloom.plans.queries import _CASES, _FOLD, _HISTORY, _HOST, _OWN, _cases, _history, _load, query


def _pick(key: str, cases: tuple, k: int) -> str:
    word = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"CASE {key} % {len(cases)} " + " ".join(f"WHEN {i} THEN {word(c[k])}" for i, c in enumerate(cases)) + " END"


@query(f"""WITH {_CASES}, h AS (SELECT page_id, url, {_HOST} AS host FROM cases), o AS (SELECT *, {_OWN} AS registered FROM h)
SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) AS scheme, host, CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) END AS path, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query, registered,
CASE WHEN host = registered THEN '' ELSE host[:length(host) - length(registered) - 1] END AS subdomain, host = registered AND host LIKE '192.%' AS is_ip, host IN ('localhost', '127.0.0.1') AS is_localhost FROM o""")
def P1_address_parts(spark, sf_dir):
    return _cases(spark, sf_dir).select("page_id", *[c.alias(k) for k, c in urls.parsed(F.col("url")).items()])


@query("""SELECT page_id, 'v' || CAST(page_id AS VARCHAR) AS a, 'x y&z' AS b, CASE page_id % 2 WHEN 0 THEN '100%' END AS c, 3 + CASE page_id % 2 WHEN 0 THEN 1 ELSE 0 END::BIGINT AS n FROM pages""")
def F9_parameters(spark, sf_dir):
    text = F.concat(F.lit("?a=1&b=x+y%26z&&flag&a=v"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, "&c=100%").otherwise(""))
    read = _load(spark, sf_dir, "pages").select("page_id", urls.parameters(text).alias("p"))
    return read.select("page_id", *[F.try_element_at("p", F.lit(k)).alias(k) for k in "abc"], F.size("p").cast("long").alias("n"))


#: Hosts of the pages and of the cases, with some under wildcards and exceptions; a table of rules.
_HOSTS_OF = """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'a.b.shop.co.uk' WHEN 1 THEN 'x' || CAST(page_id % 50 AS VARCHAR(9)) || '.city.kobe.example' WHEN 2 THEN 'www.y' || CAST(page_id % 50 AS VARCHAR(9)) || '.kobe.example' WHEN 3 THEN 'kobe.example' WHEN 4 THEN '192.0.2.' || CAST(page_id % 250 AS VARCHAR(9)) END AS made, url FROM {pages}"""
_RULES = "SELECT * FROM (VALUES ('com'), ('org'), ('net'), ('uk'), ('co.uk'), ('example'), ('*.kobe.example'), ('!city.kobe.example'), ('test'), ('shop.co.uk.'), ('com')) AS t(rule)"


@query(f"""WITH h AS (SELECT page_id, coalesce(made, {_HOST}) AS host FROM ({_HOSTS_OF.format(pages="pages")})), r AS (SELECT DISTINCT rtrim(rule, '.') AS rule FROM ({_RULES})),
x AS (SELECT page_id, host, k, len(l) - k AS n, array_to_string(l[k + 1:], '.') AS s, array_to_string(l[k + 2:], '.') AS tail FROM (SELECT page_id, host, string_split(host, '.') AS l, unnest(range(len(string_split(host, '.')))) AS k FROM h)),
f AS (SELECT page_id, max(CASE WHEN starts_with(rule, '!') THEN n - 1 END) AS e, max(CASE WHEN NOT starts_with(rule, '!') THEN n END) AS m FROM x JOIN r ON rule = s OR rule = '!' || s OR (tail <> '' AND rule = '*.' || tail) GROUP BY page_id),
b AS (SELECT page_id, host, string_split(host, '.') AS l, coalesce(e, m, 1) AS n, regexp_matches(host, '^([0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}$') AS ip FROM h LEFT JOIN f USING (page_id))
SELECT page_id, host, CASE WHEN NOT ip THEN array_to_string(l[-n:], '.') END AS suffix, CASE WHEN ip OR len(l) <= n + 1 THEN host ELSE array_to_string(l[-n - 1:], '.') END AS registered FROM b""")
def P1_public_suffix(spark, sf_dir):
    """P1 with rules, wildcards and exceptions from a table."""
    rows = spark.sql(_HOSTS_OF, pages=_load(spark, sf_dir, "pages").select("page_id", "url"))
    hosts = rows.select("page_id", F.coalesce("made", urls.host(F.col("url"))).alias("host"))
    return suffix_rules.with_registered(hosts, "host", spark.sql(_RULES))


#: The features of F33 as both engines read them.
FEATURES = """SELECT page_id, CASE WHEN page_id % 3 > 0 THEN 4.0 + page_id % 10 / 10.0 END AS url_entropy, page_id % 5 / 10.0 AS url_digit_ratio, page_id % 4 AS url_num_hyphens, page_id % 7 = 0 AS url_has_at_symbol, page_id % 2 = 0 AS html_has_favicon, page_id % 6 AS html_num_hidden_inputs,
CASE page_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS brand_domain_match, CASE WHEN page_id % 4 > 0 THEN page_id % 60 END AS domain_age_days, CASE page_id % 3 WHEN 0 THEN 'budget' WHEN 1 THEN 'major' END AS registrar_category FROM {pages}"""


@query(f"""SELECT page_id, array_to_string(list_filter([CASE WHEN url_entropy > 4.5 THEN 'url_entropy' END, CASE WHEN url_digit_ratio > 0.3 THEN 'url_digit_ratio' END, CASE WHEN url_num_hyphens >= 2 THEN 'url_num_hyphens' END, CASE WHEN url_has_at_symbol THEN 'url_has_at_symbol' END, CASE WHEN NOT html_has_favicon THEN 'html_has_favicon' END,
CASE WHEN html_num_hidden_inputs > 2 THEN 'html_num_hidden_inputs' END, CASE WHEN NOT brand_domain_match THEN 'brand_domain_match' END, CASE WHEN domain_age_days < 30 THEN 'domain_age_days' END, CASE WHEN registrar_category = 'budget' THEN 'registrar_category' END], lambda x: x IS NOT NULL), ',') AS flags FROM ({FEATURES.format(pages="pages")})""")
def F33_risk_flags(spark, sf_dir):
    rows = spark.sql(FEATURES, pages=_load(spark, sf_dir, "pages").select("page_id"))
    return rows.select("page_id", F.array_join(dashboard.risk_flags(rows.columns), ",").alias("flags"))


_CAUGHT = "CASE event_id % 5 WHEN 0 THEN 'L1_WHITELIST' WHEN 1 THEN 'L2_HEURISTICS' WHEN 2 THEN 'L3_ML' WHEN 3 THEN 'L2_FALLBACK' END"


def _status(level: str) -> str:
    at, this = f"coalesce(list_position({list(dashboard.LEVELS)}, c), 0)", dashboard.LEVELS.index(level) + 1
    return f"CASE WHEN {at} = 0 OR {at} < {this} THEN 'skip' WHEN {at} > {this} OR verdict = 'SAFE' THEN 'pass' WHEN verdict = 'MALICIOUS' THEN 'catch' ELSE 'warning' END AS {level.lower()}"


@query(f"WITH {_HISTORY}, c AS (SELECT event_id, verdict, CASE WHEN event_id % 11 = 0 THEN 'L1_CACHE' ELSE coalesce({_CAUGHT}, 'L3_ML') END AS c FROM h) SELECT event_id, {', '.join(map(_status, dashboard.LEVELS))} FROM c")
def F34_level_status(spark, sf_dir):
    return _history(spark, sf_dir).select("event_id", *[dashboard.level_status(v, F.expr(_CAUGHT), F.col("verdict"), F.col("event_id") % 11 == 0).alias(v.lower()) for v in dashboard.LEVELS])


@query("""SELECT doc_id, name, score FROM (SELECT doc_id, unnest([{'name': 'form score', 'score': doc_id % 12 / 10.0::DOUBLE}, {'name': 'page rank', 'score': doc_id % 3 / 2.0::DOUBLE}, {'name': 'ML: fear', 'score': CASE WHEN doc_id % 4 > 0 THEN doc_id % 4::DOUBLE END}], recursive := true) FROM documents)
WHERE score <= 1 OR (name = 'ML: fear' AND score IS NOT NULL)""")
def F35_signal_list(spark, sf_dir):
    i = F.col("doc_id")
    rows = dashboard.flattened({"form_score": i % 12 / 10.0, "l2_score": F.lit(0.5), "page_rank": i % 3 / 2.0}, {"fear": F.when(i % 4 > 0, (i % 4).cast("double"))})
    return _load(spark, sf_dir, "documents").select("doc_id", F.inline(rows))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 > 0 THEN doc_id % 10 / 10.0 END AS form, CASE WHEN doc_id % 3 > 0 THEN doc_id % 100 / 100.0 END AS visual FROM documents)
SELECT doc_id, CASE WHEN coalesce(form, 0) >= 0.5 THEN 'bad' WHEN coalesce(form, 0) < 0.3 THEN 'ok' ELSE 'neutral' END AS form_band, CASE WHEN coalesce(visual, 0) >= 0.82 THEN 'bad' ELSE 'ok' END AS visual_band, CASE WHEN doc_id % 5 = 1 THEN 'bad' ELSE 'ok' END AS fear_band, CASE WHEN doc_id % 3 > 0 THEN 'bad' ELSE 'ok' END AS ocr_band,
CASE WHEN doc_id % 4 > 0 THEN 'ok' ELSE 'neutral' END AS fired_band, CASE WHEN visual IS NULL THEN 'none' WHEN visual < 0.33 THEN 'safe' WHEN visual < 0.66 THEN 'suspicious' ELSE 'malicious' END AS colour FROM d""")
def F36_bands(spark, sf_dir):
    i = F.col("doc_id")
    form, visual = F.when(i % 7 > 0, i % 10 / 10.0), F.when(i % 3 > 0, i % 100 / 100.0)
    found = dashboard.bands(form, visual, F.when(i % 5 > 0, i % 5 == 1), i % 3, F.when(i % 4 > 0, i % 4))
    return _load(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in found.items()], dashboard.colour(visual).alias("colour"))


ALLOWED = ("google.com", "github.io", "bit.ly", "google.com")


@query(f"""WITH {_CASES}, h AS (SELECT page_id, {_HOST} AS host FROM cases), d AS (SELECT *, CASE WHEN page_id % 9 = 1 THEN host WHEN page_id % 18 = 4 THEN 'github.io' ELSE {_OWN} END AS domain FROM h)
SELECT page_id, domain, domain IN ('google.com', 'bit.ly') AS fast_path, domain = 'github.io' AS partial_match FROM d""")
def P2_allow_list(spark, sf_dir):
    domain = F.when(F.col("page_id") % 18 == 4, "github.io").otherwise(urls.parsed(F.col("url"))["registered"])
    rows = _cases(spark, sf_dir).select("page_id", domain.alias("domain"))
    return cascade.gate(rows, spark.createDataFrame([(d,) for d in ALLOWED], "domain string")).select("page_id", "domain", "fast_path", "partial_match")


@query("""WITH s AS (SELECT doc_id, doc_id % 13 = 0 AS fast, CASE WHEN doc_id % 11 = 0 THEN 'MALICIOUS' END AS kept, doc_id % 101 / 100.0::DOUBLE AS l2, CASE WHEN doc_id % 5 > 0 THEN doc_id % 10 / 10.0::DOUBLE END AS final FROM documents),
l AS (SELECT *, CASE WHEN fast THEN 'L1_WHITELIST' WHEN kept IS NOT NULL THEN 'L1_CACHE' WHEN l2 < 0.2 OR l2 >= 0.85 THEN 'L2_HEURISTICS' WHEN final IS NULL THEN 'L2_FALLBACK' ELSE 'L3_ML' END AS level_caught FROM s)
SELECT doc_id, level_caught, CASE level_caught WHEN 'L1_WHITELIST' THEN 'SAFE' WHEN 'L1_CACHE' THEN kept WHEN 'L2_HEURISTICS' THEN CASE WHEN l2 < 0.2 THEN 'SAFE' ELSE 'MALICIOUS' END WHEN 'L2_FALLBACK' THEN 'SUSPICIOUS' ELSE CASE WHEN final < 0.3 THEN 'SAFE' WHEN final >= 0.7 THEN 'MALICIOUS' ELSE 'SUSPICIOUS' END END AS verdict,
CASE level_caught WHEN 'L1_WHITELIST' THEN 0 WHEN 'L1_CACHE' THEN NULL WHEN 'L3_ML' THEN final ELSE l2 END::DOUBLE AS score, CASE level_caught WHEN 'L1_WHITELIST' THEN 1 WHEN 'L2_FALLBACK' THEN 0.5 WHEN 'L3_ML' THEN 0.75 END::DOUBLE AS confidence FROM l""")
def P3_cascade(spark, sf_dir):
    i = F.col("doc_id")
    final = F.when(i % 5 > 0, i % 10 / 10.0)
    fused = {"final_score": final, "verdict": F.when(final < 0.3, "SAFE").when(final >= 0.7, "MALICIOUS").otherwise("SUSPICIOUS"), "confidence": F.lit(0.75)}
    return _load(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in cascade.decided(i % 13 == 0, F.when(i % 11 == 0, "MALICIOUS"), i % 101 / 100.0, fused).items()])


@query("SELECT vec_id, CASE WHEN s >= 0.82 AND vec_id % 3 > 0 THEN s ELSE 0 END::DOUBLE AS visual_score FROM (SELECT vec_id, vec_id % 100 / 100.0 AS s FROM embeddings)")
def A15_visual_spoof(spark, sf_dir):
    i = F.col("vec_id")
    domain = F.when(i % 3 == 0, F.when(i % 2 == 0, "google.com").otherwise("mail.google.com")).when(i % 3 == 1, "notgoogle.com")
    return _load(spark, sf_dir, "embeddings").select("vec_id", cascade.spoof(i % 100 / 100.0, domain, F.lit("google.com")).alias("visual_score"))


@query("SELECT count(*) AS total, count(*) FILTER (length(text) > 0) AS with_text, count(*) FILTER (doc_id % 3 = 0) AS page_mismatch FROM documents")
def A21_coverage(spark, sf_dir):
    i = F.col("doc_id")
    return profile.coverage(_load(spark, sf_dir, "documents").withColumn("page_mismatch", F.when(i % 3 == 0, True).when(i % 3 == 1, False)), {"with_text": "text"}, ["page_mismatch"])


#: Layout put into each page's own markup, by its id; the rule is plain SQL of both engines.
_LAYOUT = """CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '<form style="position: fixed; inset: 0; z-index: ' || CAST(page_id % 90 AS VARCHAR(9)) || '"><input type=password><button></button><button> go </button><button type=button></button></form><canvas><svg>'
WHEN 2 THEN '<img src="data:image/png;base64,AAAA" style="width:100vw;height:100vh;object-fit:cover"><p style="z-index:-' || CAST(page_id % 7 AS VARCHAR(9)) || '">' ELSE '<IMG><form><input TYPE=password></form><style>a{position:absolute;background:transparent}</style>' END
|| CASE page_id % 3 WHEN 0 THEN '<img src="/a"><img src="data:image/jpeg;base64,AAECAwQ="><button type="submit"> </button>' ELSE '' END"""
LAYOUT = f"replace(html, '</article>', {_LAYOUT} || '</article>')"


def _n(pattern: str) -> str:
    return f"len(regexp_extract_all(l, '{pattern}'))::BIGINT"


def _has(pattern: str) -> str:
    return f"regexp_matches(l, '{pattern}')"


@query(f"""WITH m AS (SELECT page_id, {LAYOUT} AS h, lower({LAYOUT}) AS l FROM pages), n AS (SELECT page_id, h, l, {_n("<img")} AS n_images, {_n("<form")} AS n_forms, {_n("type=.?password")} AS n_password_inputs FROM m)
SELECT page_id, n_images, {_n('src="data:image/')} AS n_embedded_images, coalesce(list_sum(list_transform(regexp_extract_all(h, 'base64,([A-Za-z0-9+/=]+)', 1), lambda d: octet_length(from_base64(d)))), 0)::BIGINT AS embedded_bytes, n_forms, n_password_inputs, {_n("<canvas")} AS n_canvas, {_n("<svg")} AS n_svg,
{_n('<button(?: type="submit")?> *</button>')} AS n_empty_submit, coalesce(list_max(list_transform(regexp_extract_all(l, 'z-index: ?(-?[0-9]+)', 1), lambda z: z::BIGINT)), 0)::BIGINT AS max_z_index, {_n("position: ?absolute")} AS n_absolute, {_n("position: ?fixed")} AS n_fixed,
{_has("<img")} AND {_has("width:100vw")} AND {_has("height:100vh")} AS full_viewport_image, {_has("object-fit:(cover|fill)")} AS object_fit, {_has("background:transparent")} AND {_has("<(input|button)")} AS transparent_controls, {_has("<form")} AND {_has("inset: ?0")} AND {_has("z-index: ?[1-9]")} AS fullscreen_form,
n_images > 0 AND n_forms > 0 AND n_password_inputs > 0 AND {_has("position: ?(fixed|absolute)")} AND {_has("background:transparent")} AS form_over_image FROM n""")
def H12_layout(spark, sf_dir):
    """H12 over every page's own markup, with layout put in, since the tables' pages have none."""
    rows = _load(spark, sf_dir, "pages").selectExpr("page_id", f"{LAYOUT} AS html").withColumn("t", layout.tags(F.col("html")))
    return rows.select("page_id", *[c.alias(k) for k, c in layout.structure(F.col("html"), F.col("t")).items()])


#: A stored list of forms by the page's id and address; both engines read the same rule.
_FORM = """'{"action":"' || CASE page_id % 4 WHEN 0 THEN '#' WHEN 1 THEN ' About:Blank ' WHEN 2 THEN url ELSE '' END || '","method":"' || CASE WHEN page_id % 2 = 0 THEN 'post' ELSE 'get' END || '","inputs":[{"type":"hidden","name":"a"}' || CASE WHEN page_id % 3 = 0 THEN ',{"type":"text"},{"type":"hidden"}' ELSE '' END || ']}'"""
_STORED = f"""CASE page_id % 6 WHEN 0 THEN '[]' WHEN 1 THEN NULL WHEN 2 THEN 'broken' WHEN 3 THEN '[' || {_FORM} || ']' ELSE '[' || {_FORM} || ',{{"action":"/second","inputs":[{{"type":"hidden"}}]}}]' END"""


@query(f"""WITH t AS (SELECT page_id, {_STORED} AS t FROM pages), j AS (SELECT page_id, t, CASE WHEN json_valid(t) THEN t::JSON ELSE '[]'::JSON END AS j FROM t), a AS (SELECT *, json_extract_string(j, '$[*].action') AS acts FROM j)
SELECT page_id, json_array_length(j)::BIGINT AS n_forms, len(json_extract(j, '$[*].inputs[*]'))::BIGINT AS n_inputs, len(list_filter(json_extract_string(j, '$[*].inputs[*].type'), lambda k: k = 'hidden'))::BIGINT AS n_hidden, json_extract_string(j, '$[0].action') AS first_action, json_extract_string(j, '$[0].method') AS first_method,
len(list_filter(acts, lambda x: trim(x) IN ('', '#'))) > 0 AS handler_empty, len(list_filter(acts, lambda x: lower(trim(x)) = 'about:blank')) > 0 AS handler_blank, CASE WHEN t IS NULL OR trim(t) IN ('', '[]') THEN 0 ELSE 1 END::BIGINT AS listed FROM a""")
def H13_stored_forms(spark, sf_dir):
    rows = _load(spark, sf_dir, "pages").selectExpr("page_id", f"{_STORED} AS t")
    forms = F.coalesce(F.from_json("t", layout.FORMS), F.array().cast(layout.FORMS))
    return rows.select("page_id", *[c.alias(k) for k, c in (layout.stored_forms(F.col("t")) | layout.handlers(forms)).items()], layout.listed(F.col("t")).cast("long").alias("listed"))


def _u(key: str, seed: int) -> str:
    return f"(('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 5))::BIGINT / 1048576.0::DOUBLE)"


@query(f"SELECT doc_id, CASE WHEN {_u('doc_id', 7)} * 4.0 < 1.0 THEN 'a' WHEN {_u('doc_id', 7)} * 4.0 < 3.0 THEN 'b' ELSE 'c' END AS name, CASE WHEN {_u('doc_id', 8)} >= 0.15 THEN lang END AS lang, {_u('source', 9)} < 0.3 AS held_out FROM documents WHERE source IS NOT NULL")
def K1_draws(spark, sf_dir):
    """K1, K4, K13."""
    i = F.col("doc_id")
    rows = _load(spark, sf_dir, "documents").where("source IS NOT NULL")
    return rows.select("doc_id", modelling.chosen(i, {"a": 1.0, "b": 2.0, "c": 1.0}, 7).alias("name"), modelling.masked(F.col("lang"), i, 0.15, 8).alias("lang"), modelling.group_holdout(F.col("source"), 0.3, 9).alias("held_out"))


@query("SELECT doc_id, quality, (row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1) % 5 AS fold FROM labels")
def K3_folds(spark, sf_dir):
    return modelling.folds(_load(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id")


@query("SELECT doc_id FROM (SELECT doc_id FROM labels WHERE quality = 1 ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT (SELECT count(*) FROM labels WHERE quality = 0))")
def K15_matched_controls(spark, sf_dir):
    rows = _load(spark, sf_dir, "labels")
    return modelling.matched(rows.where("quality = 1").select("doc_id"), rows.where("quality = 0"), "doc_id")


@query("SELECT doc_id, (lang = 'en')::INT::DOUBLE AS lang_en, (lang = 'fr')::INT::DOUBLE AS lang_fr, list_sum([n_chars::DOUBLE, (lang = 'fr')::INT::DOUBLE, 0]) AS total, (n_chars % 100 >= 50)::BIGINT AS label FROM documents")
def H17_vector(spark, sf_dir):
    """A fixed order with one column that the rows lack."""
    hot = modelling.one_hot(F.col("lang"), ["en", "fr"], "lang")
    v = modelling.vector({"n_chars": F.col("n_chars"), **hot}, ["n_chars", "absent", "lang_fr"])
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return _load(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in hot.items()], total.alias("total"), modelling.labelled_by(F.col("n_chars") % 100 / 100.0).cast("long").alias("label"))


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def S13_newest_files(spark, sf_dir):
    """The limit is the feature: as many of the newest as are kept."""
    return history.newest(_load(spark, sf_dir, "events").select("event_id", "ts"), [F.desc("ts"), F.desc("event_id")], 500).select("event_id")


#: Long and short forms of each page's own markup, by its id.
_LONG = "CASE page_id % 4 WHEN 0 THEN html WHEN 1 THEN repeat(html, 40) WHEN 2 THEN NULL ELSE repeat(html, 3) END"


@query(f"SELECT page_id, length(h[:50000]) AS n_html, md5(h[:50000]) AS html, md5(h[:5000]) AS visible_text, h[:100] AS anchor_text, h[:200] AS href, md5(h[:2000]) AS ocr_text FROM (SELECT page_id, {_LONG} AS h FROM pages)")
def P6_bounded_payload(spark, sf_dir):
    """The limits are the feature: what goes to the models and into a report."""
    rows = _load(spark, sf_dir, "pages").selectExpr("page_id", f"{_LONG} AS h")
    cut = cascade.bounded({n: F.col("h") for n in ("html", "visible_text", "anchor_text", "href", "ocr_text")})
    plain = ("anchor_text", "href")
    return rows.select("page_id", F.length(cut["html"]).cast("long").alias("n_html"), *[(c if n in plain else F.md5(F.encode(c, "UTF-8"))).alias(n) for n, c in cut.items()])


@query(f"WITH {_HISTORY} SELECT date_trunc('hour', ts) AS window_start, verdict, count(*) AS n, round(avg(value), 6) AS mean FROM h GROUP BY 1, 2")
def C10_window_stats(spark, sf_dir):
    return history.window_stats(_history(spark, sf_dir), "ts", "verdict", "value", "1 hour")


@query(f"""WITH RECURSIVE {_HISTORY}, {_FOLD}, f AS (SELECT event_id, user_id, n, true AS lookup, ts AS t FROM r WHERE n = 1 UNION ALL
SELECT event_id, user_id, n, lookup, CASE WHEN lookup THEN ts ELSE t END FROM (SELECT r.event_id, r.user_id, r.n, r.ts, f.t, epoch_us(r.ts) - epoch_us(f.t) > 86400000000 AS lookup FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)) SELECT event_id, lookup FROM f""")
def C8_lookup_due(spark, sf_dir):
    return history.lookup_due(_history(spark, sf_dir), "user_id", "ts", "event_id").select("event_id", "lookup")


_SETS = (("lang", "source", "quality"), ("lang", "source"), ("lang",), ("quality",), ())


@query(f"""SELECT GROUPING(lang, source, quality)::BIGINT AS level, lang, source, quality, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM documents), 4) AS share
FROM (SELECT d.doc_id, lang, source, quality FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)) GROUP BY GROUPING SETS ({", ".join("(" + ", ".join(s) + ")" for s in _SETS)})""")
def A20_summary(spark, sf_dir):
    """Language, source and label together, each with its share; unlabelled documents count as a group of their own."""
    known = _load(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = _load(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(known, "doc_id", "left")
    return profile.summary(rows, ["lang", "source", "quality"], [list(s) for s in _SETS])


def K6_extra_trees(spark, sf_dir):
    """Extra trees over shapes of the documents' texts, fitted on four of five labelled rows and applied to all of them; tests hold the fit against a plain version."""
    t = F.coalesce("text", F.lit(""))
    share = lambda p: F.regexp_count(t, F.lit(p)) / F.greatest(F.length(t), F.lit(1))
    shapes = [F.log1p(F.length(t)), share("[0-9]"), share("[A-Z]"), share(r"\s"), share(r"[^A-Za-z0-9\s]"), share("\n"), share("[#$%&*|<>{}]")]
    rows = _load(spark, sf_dir, "documents").select("doc_id", F.array(*[c.cast("double") for c in shapes]).alias("x")).join(_load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    rows = modelling.folds(rows, "quality", "doc_id").cache()
    forest = extra_trees.fit(rows.where("fold <> 0"), "x", "quality", len(shapes), tried=4)
    return rows.select("doc_id", "quality", "fold", F.round(extra_trees.score(forest, F.col("x")), 6).alias("score"))


WITHOUT_SQL = {f.__name__: f for f in (K6_extra_trees,)}
