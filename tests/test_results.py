"""Codes of sounds, layout, cascade, draws, classifiers and files: golden rows, nulls and properties."""

import json

import pytest
from pyspark.sql import functions as F

from riskloom.functions import layout, phonetic, urls
from riskloom.operators import brands, cascade, dashboard, history, lexicon, modelling, scan, scoring
from riskloom.sources import tables
from riskloom.streaming import live


@pytest.mark.parametrize(("name", "first", "second"), [
    ("main", "0000", "0000"), ("online", "0000", "0000"), ("hulu", "0000", "0000"), ("facebook", "FSPK", "FSPK"), ("amazon", "S000", "TS00"), ("google", "KK00", "KK00"), ("netflix", "TFKS", "TFKS"), ("church", "XX00", "SS00"), ("thing", "0J00", "TJ00"), ("bridge", "PJ00", "PJ00"),
    ("jiji", "JJJJ", "JJJJ"), ("lamb", "0000", "0000"), ("gnome", "KN00", "KN00"), ("aghast", "ST00", "ST00"), ("phish", "FX00", "FX00"), ("taxi", "TKS0", "TKS0"), ("zack", "SK00", "TS00"), ("", "", ""), ("123", "", ""), (None, "", ""),
])
def test_sounds(name, first, second):
    assert phonetic.keys(name) == (first, second)


def test_brand_words_have_ascii_edges(spark):
    rows = spark.createDataFrame([("éapple",), ("apple_x",), ("an apple.",), (None,)], "t string")
    assert [r[0] for r in rows.select(brands.primary(F.col("t"))).collect()] == ["apple", None, "apple", None]


def test_nulls(spark):
    rows = spark.createDataFrame([(1, None), (2, "")], "i int, t string").withColumn("tags", layout.tags(F.col("t")))
    sound = brands.sound_alike(F.col("t"), F.col("t"))
    page = layout.structure(F.col("t"), F.col("tags"))
    got = rows.orderBy("i").select(sound["phonetic_brand"].alias("brand"), sound["phonetic_score"].alias("score"), page["n_images"].alias("images"), page["max_z_index"].alias("z"), page["embedded_bytes"].alias("bytes"), urls.parameters(F.col("t")).alias("p"), lexicon.brands_in_text(F.col("t")).alias("named"), cascade.spoof(F.lit(None).cast("double"), F.col("t"), F.col("t")).alias("spoof"), urls.parsed(F.col("t"))["host"].alias("host")).collect()
    assert [tuple(r) for r in got] == [(None, 0.0, None, None, None, None, [], 0.0, None), (None, 0.0, 0, 0, 0, {}, [], 0.0, "")]
    assert spark.range(1).select(layout.handlers(F.lit(None).cast(layout.FORMS))["handler_empty"], dashboard.risk_flags([])).first()[:] == (None, [])


def test_gate_counts_repeated_entries_once_and_keeps_all_rows(spark):
    rows = spark.createDataFrame([(1, "A.test"), (2, None), (3, "github.io"), (4, "b.test")], "i int, domain string")
    allowed = spark.createDataFrame([("a.test",), ("A.TEST",), ("github.io",), (None,)], "domain string")
    assert sorted((r.i, r.fast_path, r.partial_match) for r in cascade.gate(rows, allowed).collect()) == [(1, True, False), (2, False, False), (3, False, True), (4, False, False)]
    assert cascade.gate(rows, allowed.limit(0)).where("fast_path OR partial_match").count() == 0


def test_model_runs_on_open_rows_alone(spark):
    rows = spark.range(10)
    got = cascade.only_open(rows, F.col("id") % 3 == 0, lambda df: df.withColumn("s", F.assert_true(F.col("id") % 3 == 0).isNull())).collect()
    assert sorted((r.id, r.s) for r in got) == [(i, True if i % 3 == 0 else None) for i in range(10)]


def test_draws_hold_for_any_partitioning(spark):
    rows = spark.range(4000)
    pick = lambda df: {r.id: r.n for r in df.select("id", modelling.chosen(F.col("id"), {"a": 3.0, "b": 1.0}, 1).alias("n")).collect()}
    one = pick(rows)
    assert one == pick(rows.repartition(7)) and abs(sum(v == "a" for v in one.values()) / 4000 - 0.75) < 0.03
    with pytest.raises(ValueError, match="weights"):
        modelling.chosen(F.col("id"), {}, 1)
    assert modelling.matched(rows, rows.limit(37), "id").count() == 37 and modelling.matched(rows.limit(5), rows, "id").count() == 5
    assert modelling.matched(rows, rows.limit(0), "id").count() == 0


def test_classifiers(spark):
    rows = spark.range(600).select(F.when(F.col("id") % 9 > 0, modelling.uniform(F.col("id"), 1)).alias("x"), modelling.uniform(F.col("id"), 2).alias("noise"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("kind"), "id")
    rows = rows.withColumn("label", (F.coalesce("x", F.lit(0.5)) > 0.6).cast("double")).cache()
    train, test = rows.where("id % 4 > 0"), rows.where("id % 4 = 0").withColumn("kind", F.lit("unseen"))
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier

    kinds = {"forest": RandomForestClassifier(numTrees=10, seed=1), "logistic": LogisticRegression(maxIter=20)}
    name, model, areas = modelling.best(train, test, ["x", "noise"], ["kind"], kinds)
    assert areas[name] == max(areas.values()) > 0.95 and list(areas.values()) == sorted(areas.values(), reverse=True)
    found = modelling.searched(train, ["x", "noise"], ["kind"], RandomForestClassifier(numTrees=5, seed=1), {"maxDepth": [1, 3]}, n=2)
    top = modelling.importances(found.bestModel, test)
    assert len(top) == 4 and [v for _, v in top] == sorted((v for _, v in top), reverse=True) and sum(v for _, v in top) == pytest.approx(1)
    assert set(modelling.classifiers()) == {"random_forest", "boosted_trees", "logistic_regression", "linear_svm"}


def test_files(spark, tmp_path):
    (tmp_path / "top.txt").write_text("B.test\n\n a.test \nc.test\n")
    assert [tuple(r) for r in tables.domain_lines(spark, str(tmp_path / "top.txt"), 2).orderBy("rank").collect()] == [(1, "b.test", True), (2, "a.test", True), (3, "c.test", False)]
    entries = [{"brand": "x", "domain": "x.test", "embedding": [1, 0.5]}, {"brand": "y", "embedding": []}]
    for shape in (entries, {"entries": entries}):
        (tmp_path / "v.json").write_text(json.dumps(shape, indent=1))
        assert [tuple(r) for r in tables.brand_vectors(spark, str(tmp_path / "v.json")).collect()] == [("x", "x.test", [1.0, 0.5])]
    (tmp_path / "v.json").write_text('{"entries": []}')
    assert tables.brand_vectors(spark, str(tmp_path / "v.json")).count() == 0


def test_short_null_and_unmarked_input_scores_nothing(spark):
    none = F.lit(None).cast("string")
    form = F.struct(none.alias("action"), none.alias("method"), F.lit(0).alias("n_password"), F.lit(0).alias("n_hidden"))
    nothing = {k: F.lit(None).cast("double") for k in ("fear_score", "form_score", "ocr_score", "visual_score")}
    r = spark.range(1).select(
        scoring.patterns(none)["pattern_score"].alias("none"), scoring.patterns(F.lit("arrest"))["pattern_score"].alias("short"), lexicon.share_of_lexicon(none, ("a",)).alias("share"), scoring.form_score(form, F.lit("https://a.test"), F.lit("https://a.test/")).alias("form"),
        scoring.forms_score(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))).alias("clean"), scoring.forms_score(F.array(F.lit(0.0), F.lit(0.5), F.lit(0.1))).alias("told"), scoring.fused(nothing, F.lit(0.2))["final_score"].alias("final"),
    ).first()
    assert tuple(r) == (0.0, 0.0, None, 0.1, 0.0, 0.55, 0.17)


def test_page_rules_of_forms(spark):
    score = lambda html: spark.range(1).select(scoring.page_form_score(F.array(F.lit(0.3)), F.lit(html).cast("string"), F.lit("https://a.test"))).first()[0]
    assert [score(h) for h in (None, "", "<input type='password' autocomplete=off>", "<input autocomplete='off'>", "<iframe src='//b.test'></iframe>", "<IFRAME SRC=https://a.test/x>", "<iframe></iframe>", "<input type=password autocomplete='off'><iframe src='http://b.test'>")] == [0.3, 0.3, 0.45, 0.3, 0.55, 0.3, 0.3, 0.7]


def test_scan_falls_back_and_keeps_every_row(spark):
    rows = spark.createDataFrame([(1, "https://a.b.c.d.example.com/", None, "x", 5), (1, "https://a.b.c.d.example.com/", None, "x", 5), (2, None, None, "y", 6), (3, "", "", None, None)], "id int, url string, html string, verdict string, domain int")
    got = scan.scan(rows, keep=("id",)).collect()
    assert sorted((r.id, r.verdict, r.level_caught, r.confidence) for r in got)[:2] == [(1, "SUSPICIOUS", "L2_FALLBACK", 0.5)] * 2 and sorted(r.id for r in got) == [1, 1, 2, 3]
    assert scan.scan(rows.limit(0), keep=("id",)).count() == 0
    assert {r.level_caught for r in scan.scan(rows.withColumn("cached_verdict", F.lit("SAFE"))).collect()} == {"L1_CACHE"}


def test_revalidation_on_a_stream_agrees_with_the_table(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").alias("n"), (F.col("id") % 7).alias("k"), (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(hours=F.col("id").cast("int") * 2, secs=F.lit(0.25))).alias("at"), F.element_at(F.array(*map(F.lit, ("SAFE", "MALICIOUS", "SUSPICIOUS"))), (F.col("id") % 3 + 1).cast("int")).alias("verdict"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("h"), (F.col("id") % 2).cast("string"))).alias("html_hash"))
    for part in range(4):  # in order of time, a file a trigger
        rows.where((F.col("n") >= part * 100) & (F.col("n") < part * 100 + 100)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.drain(live.revalidation(stream, "k", "at", "n", "1 day"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = dict(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == {r.n: r.action for r in history.revalidation(rows, "k", "at", "n").collect()} and len(set(got.values())) >= 4
