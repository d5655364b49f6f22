"""Golden rows worked by hand from the formulas, nulls, files and streams."""

import base64

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from riskloom import catalog
from riskloom.functions import actions, markup, urls
from riskloom.operators import brands, history, lexicon, registration, scan
from riskloom.plans import detectors
from riskloom.sources import tables
from riskloom.streaming import live


@pytest.mark.parametrize(("a", "b", "value"), [("abcdef", "bcadfe", 0.861111), ("a", "a", 1.0), ("a", "b", 0.0), ("", "b", 0.0)])
def test_jaro(a, b, value):
    assert brands.jaro(a, b) == pytest.approx(value, abs=1e-6)


def test_similarity_parts():
    assert brands.jaro_winkler("abxyzw", "abqrst") == pytest.approx(0.644444, abs=1e-6)
    assert [brands.common_run(a, b) for a, b in (("paypa1", "paypal"), ("g00gle", "google"), ("faceb00k", "facebook"), ("", "x"))] == [5, 3, 5, 0]
    assert [brands.similarity(a, f"{b}.com") for a, b in (("paypa1", "paypal"), ("g00gle", "google"), ("faceb00k", "facebook"))] == [0.9033, 0.71, 0.8175]


def test_nulls_and_empty(spark):
    rows = spark.createDataFrame([(1, None), (2, "")], "i int, t string")
    none = F.lit(None).cast("double")
    got = rows.orderBy("i").select(
        lexicon.fear(F.col("t"), none, none, none)["fear_score"].alias("fear"), lexicon.image_text(F.col("t"))["ocr_score"].alias("ocr"), brands.page_mismatch(F.lit("a.test"), brands.mentions(F.col("t"))).alias("page"), brands.nearest(F.col("t")).alias("near"),
        actions.action_kind(F.lit("https://a.test/"), F.col("t"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("kind"), actions.resolved_action(F.lit("https://a.test/"), F.col("t")).alias("to"),
        registration.features(F.col("t"), F.current_timestamp(), F.lit("x"))["registrar_category"].alias("registrar"), markup.page(F.col("t")).alias("p"),
    ).collect()
    for r in got:
        assert (r.fear, r.ocr, r.page, r.kind, r.to, r.near.brand, r.near.score) == (0.0, 0.0, 0.0, "empty", "", None, 0.0)
    assert (got[0].registrar, got[1].registrar, got[0].p.title, got[1].p.title, got[1].p.anchors, got[1].p.n_hidden) == (None, "unknown", None, "", [], 0)


def test_registration_reads_the_first_line_with_a_key(spark):
    raw = "Registrar:\nRegistrar: First\nregistrar name: Second\nCreated: 03-feb-2024\nExpires on: never\n"
    now = F.lit("2024-02-04 13:00:00").cast("timestamp")
    r = spark.range(1).select(*[c.alias(k) for k, c in registration.features(F.lit(raw), now, F.lit("x")).items()]).first()
    assert (r.domain_age_days, r.domain_expiry_days, r.registrar_category, r.has_registrant_org, r.domain_name_match) == (2, None, "unknown", False, None)


def test_references_without_semicolon(spark, tmp_path):
    """Titles cut short end within a reference: read as HTML does by default, left as written by H2_markup, as by its SQL."""
    heads = ["a&amp", "b &am", "c&amp; d&lt;&quot;", "e&copyx &notit; &;", "f&amp;amp", "g & h &"]
    html = [f"<html><head><title>{t}</title></head><body><article><p>{t}</p><script>a&&b&amp</script></article></body></html>" for t in heads]
    p = spark.createDataFrame([(html[0],), (html[3],)], "h string").select(markup.page(F.col("h")).alias("p")).collect()
    assert [x.p.title for x in p] == ["a&", "e©x ¬it; &;"]
    pq.write_table(pa.table({"page_id": pa.array(range(len(html)), pa.int64()), "url": ["https://a.test/"] * len(html), "html": html}), tmp_path / "pages.parquet")
    got = {x.page_id: x for x in detectors.H2_markup(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS FROM '{tmp_path}/pages.parquet'")
    want = con.execute(f"SELECT page_id, title, visible_text FROM ({catalog.ORACLE_SQL['H2_markup']})").fetchall()
    assert len(want) == len(got) and all((got[i].title, got[i].visible_text) == (t, v) for i, t, v in want)
    assert [got[i].title for i in range(len(html))] == ["a&amp", "b &am", 'c& d<"', "e&copyx &notit; &;", "f&amp", "g & h &"]


def test_markup_of_broken_pages(spark):
    html = "<form action=x><input><p>a</form><input type=HIDDEN><a href='javascript:x'>b</a><noscript>no</noscript><a href=y>c<div>d"
    p = spark.range(1).select(markup.page(F.lit(html)).alias("p")).first().p
    assert (len(p.forms), len(p.forms[0].inputs), p.n_hidden, [(a.href, a.text) for a in p.anchors], p.visible_text) == (1, 1, 1, [("y", "cd")], "abcd")


def test_files(spark, tmp_path):
    (tmp_path / "web_brand_two_07.html").write_text("<p>x\ny")
    (tmp_path / "other.html").write_text("z")
    got = {r.name: (r.platform, r.brand, r["index"], r.html) for r in tables.pages(spark, str(tmp_path)).collect()}
    assert got == {"web_brand_two_07": ("web", "brand_two", 7, "<p>x\ny"), "other": (None, None, None, "z")}
    (tmp_path / "ranks.csv").write_text("2,B.test\n1,A.test\nx,c.test\n3,d.test\n")
    assert [tuple(r) for r in tables.rank_list(spark, str(tmp_path / "ranks.csv"), 2).collect()] == [(1, "a.test"), (2, "b.test")]
    rows = spark.createDataFrame([(1, None, "a", "x"), (2, None, "a", None)], "i int, n int, c string, m string")
    assert tables.varying(rows) == ["i", "m"]
    tables.put_ordered(rows, ["m"], str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).columns == ["m", "c", "i", "n"]


def test_stream_agrees_with_batch(spark, tmp_path):
    events = spark.createDataFrame([(k % 3, f"2024-01-0{1 + k % 4} 00:{k % 50:02d}:00") for k in range(120)], "user long, at string").select("user", F.col("at").cast("timestamp").alias("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    live.rate_limited(stream, "user", "ts", 5, "1 hour", "10 days").writeStream.format("memory").queryName("limits").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    batch = history.rate_limited(events, "user", "ts", 5, "1 hour")
    assert sorted(map(tuple, spark.table("limits").collect())) == sorted(map(tuple, batch.collect()))
    live.drain(live.first_seen(stream, ["user", "ts"], "ts", "10 days"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.distinct().count()


def test_flags_and_labels(spark):
    rows = spark.createDataFrame([(v,) for v in ("TRUE", " 0 ", "1", "no", None)], "v string")
    assert [r[0] for r in rows.select(tables.flag(F.col("v"))).collect()] == [1, 0, 1, None, None]
    a, b = spark.createDataFrame([("1", 5)], "y string, n int"), spark.createDataFrame([("2", "x"), ("0", "z"), (None, "w")], "y string, t string")
    assert sorted(map(tuple, tables.labelled([a, b], "y").collect())) == [(0, None, "z"), (1, 5, None)]


def test_hidden_parameters_count_in_the_address_score(spark):
    coded = lambda t: base64.urlsafe_b64encode(t.encode()).decode().rstrip("=")
    late, login, plain = coded("x" * 250 + " login"), coded("http://example.test/login?id=1"), coded("a plain sentence without meaning")
    rows = spark.createDataFrame([(1, f"https://a.test/?n={login}"), (2, f"https://a.test/?a=1&n={late}&m={login}"), (3, f"https://a.test/?n={plain}"), (4, f"http://192.0.2.1/?n={login}&z=http://b.test/#f"), (5, f"https://a.test/?n={login}&n={plain}"), (6, "https://a.test/")], "i int, url string")
    flags = urls.obfuscation_flags(F.col("url"), urls.host(F.col("url")))
    got = {r.i: (list(r.flags), round(r.score, 3)) for r in rows.select("i", flags.alias("flags"), urls.flag_score(flags).alias("score")).collect()}
    assert got == {1: (["base64_param_n"], 0.3), 2: (["base64_param_n", "base64_param_m"], 0.6), 3: ([], 0.0), 4: (["ip_based_url", "base64_param_n", "url_in_url_redirect"], 1.0), 5: ([], 0.0), 6: ([], 0.0)}
    seen = rows.where("i = 2").select(F.explode(actions.hidden_parameters(F.regexp_extract("url", r"\?(.*)", 1))).alias("p")).select("p.*").collect()
    assert [(r.name, r.text) for r in seen] == [("n", "x" * 200), ("m", "http://example.test/login?id=1")]
    scanned = {r.url: (r.l2_score, list(r.breakdown.flags)) for r in scan.scan(rows.where("i IN (1, 6)").withColumn("html", F.lit("<p>plain</p>"))).collect()}
    assert scanned[f"https://a.test/?n={login}"][1] == ["base64_param_n"] and scanned[f"https://a.test/?n={login}"][0] > scanned["https://a.test/"][0]


def test_six_lexicons(spark):
    rows = spark.createDataFrame([(1, "Urgent: the ADMIN asks you to claim your gift; upload id and password, account locked"), (2, None)], "i int, t string")
    got = rows.orderBy("i").select(*[c.alias(k) for k, c in lexicon.lexicon_shares(F.col("t")).items()]).collect()
    # 1 of 34, 1 of 24, 1 of 18, 1 of 12, claim and gift of 12, upload and upload id of 12
    assert got[0].asDict() == {"urgency_score": 0.196, "fear_score": 0.278, "credential_score": 0.37, "authority_score": 0.556, "reward_score": 1.0, "document_score": 1.0}
    assert set(got[1]) == {None}
