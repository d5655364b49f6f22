"""Queries of the detectors over what the tables hold: documents.text, pages.url and pages.html of every row.

The queries of the same ids in the other modules run over made-up cases, which hold what the plain rows lack.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import config
from riskloom.functions import automaton, urls
from riskloom.operators import lexicon, scan, scoring
from riskloom.plans import detectors  # noqa: F401
from riskloom.plans.queries import _CASES, ORACLE_SQL, TEXT_CASES, _load, query

_MADE_UP, _WHOLE = TEXT_CASES.format(documents="documents"), "SELECT doc_id, text AS t FROM documents"
_ADDRESSES = "cases AS (SELECT page_id, url FROM pages)"


def _whole(name: str) -> str:
    """The SQL of a query over made-up cases, over the tables' own rows."""
    return ORACLE_SQL[name].replace(_MADE_UP, _WHOLE).replace(_CASES, _ADDRESSES)


def _quoted(words) -> str:
    return " + ".join("contains(lower(text), '" + w.replace("'", "''") + "')::INT" for w in words)


def _documents(spark, sf_dir):
    return _load(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"))


def _pages(spark, sf_dir):
    return _load(spark, sf_dir, "pages").select("page_id", "url").withColumn("host", urls.host(F.col("url")))


@query(_whole("A3_text_patterns"))
def A3_documents(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", *[(c.cast("long") if k.endswith("hits") else c).alias(k) for k, c in scoring.patterns(F.col("t")).items()])


@query(_whole("A13_lexicon_fear"))
def A13_documents(spark, sf_dir):
    share = lambda k: F.col("doc_id") % k / float(k)
    return _documents(spark, sf_dir).select("doc_id", *[c.alias(k) for k, c in lexicon.fear(F.col("t"), share(10), share(4), share(3)).items()])


@query(_whole("A14_image_text"))
def A14_documents(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", *[c.alias(k) for k, c in lexicon.image_text(F.col("t")).items()])


@query("SELECT doc_id, " + ", ".join(f"round(least(1.0, ({_quoted(words)})::DOUBLE / {max(0.15 * len(words), 1.0)}), 3) AS {name}_score" for name, words in config.LEXICONS.items()) + " FROM documents")
def F21_documents(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", *[c.alias(k) for k, c in lexicon.lexicon_shares(F.col("t")).items()])


_WORDS = "SELECT DISTINCT 'third_' || CAST(item_id % 3 AS VARCHAR) AS list, word FROM (SELECT item_id, lower(unnest(string_split_regex(text, '\\s+'))) AS word FROM benchmark) WHERE length(word) >= 5"


@query(f"""WITH w AS ({_WORDS}), n AS (SELECT list, count(*) AS n FROM w GROUP BY list), f AS (SELECT doc_id, list, count(*) AS k FROM documents JOIN w ON contains(lower(text), word) GROUP BY ALL),
s AS (SELECT doc_id, list, round(least(1.0, coalesce(k, 0)::DOUBLE / greatest(0.15 * n, 1)), 3) AS s FROM (SELECT doc_id, list, n FROM documents, n WHERE text IS NOT NULL) LEFT JOIN f USING (doc_id, list))
SELECT doc_id, max(s) FILTER (list = 'third_0') AS third_0_score, max(s) FILTER (list = 'third_1') AS third_1_score, max(s) FILTER (list = 'third_2') AS third_2_score FROM documents LEFT JOIN s USING (doc_id) GROUP BY doc_id""")
def F21_word_table(spark, sf_dir):
    """F21 with lexicons from a table: the words of each third of the benchmark's items."""
    items = _load(spark, sf_dir, "benchmark").select(F.concat(F.lit("third_"), (F.col("item_id") % 3).cast("string")).alias("list"), F.explode(F.split(F.lower("text"), r"\s+")).alias("word"))
    words = items.where(F.length("word") >= 5).distinct()
    sizes = {r["list"]: r["n"] for r in words.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = lexicon.shares(F.col("t"), {f"third_{k}": sizes.get(f"third_{k}", 0) for k in range(3)}, automaton.of_table(words, "list", "word"))
    return _documents(spark, sf_dir).select("doc_id", *[c.alias(k) for k, c in found.items()])


@query("SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN contains(' ' || lower(text) || ' ', ' {b} ') THEN '{b}' END" for b in config.TEXT_BRANDS) + ") AS brands, length(coalesce(text, ''))::BIGINT AS length FROM documents")
def F20_documents(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.array_join(lexicon.brands_in_text(F.col("t")), ",").alias("brands"), lexicon.text_shape(F.col("t"))["length"].alias("length"))


@query(_whole("A11_url_risk"))
def A11_pages(spark, sf_dir):
    """The SQL knows no base64 parameters, of which the tables' addresses have none."""
    rows = _pages(spark, sf_dir).withColumn("flags", urls.obfuscation_flags(F.col("url"), F.col("host"))).withColumn("s", urls.flag_score(F.col("flags")))
    l2 = scoring.weighted({"url_obfuscation": F.col("s"), "ip_based_url": F.array_contains("flags", "ip_based_url")})
    return rows.select("page_id", "url", "host", F.round("s", 3).alias("obfuscation_score"), F.array_join("flags", ",").alias("flags"), l2.alias("l2_score"), scoring.l2_verdict(l2).alias("verdict"))


@query(_whole("F1_url_structure"))
def F1_pages(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", *[c.alias(k) for k, c in urls.structure(F.col("url"), F.col("host")).items()])


@query(_whole("A10_tld_risk"))
def A10_pages(spark, sf_dir):
    t = urls.tld(F.col("host"))
    return _pages(spark, sf_dir).select("page_id", t.alias("tld"), urls.tld_risk(t).alias("risk"), (urls.tld_risk(t) >= config.TLD_SUSPICIOUS_FROM).alias("suspicious"))


def Y1_scan(spark, sf_dir):
    """The whole scan, with the page brands, nearest domains, sound codes and form rules of A4, A7, A9 and H12."""
    return scan.scan(_load(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=("page_id",)).drop("breakdown")


#: SQL can't express the parser and the measures of likeness; golden cases in tests/test_brands.py hold it.
WITHOUT_SQL = {f.__name__: f for f in (Y1_scan,)}
