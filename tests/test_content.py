"""The content queries read every row's own text, address and markup."""

from riskloom import config
from riskloom.plans import content

def test_texts_are_read(spark, tmp_path):
    texts = {1: "plain", 2: "x" * 5000 + " your password was compromised, verify your account", 3: None, 9: "plain words of paypal here"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sf = str(tmp_path)
    assert {r.doc_id: r.credential_hits for r in content.A14_documents(spark, sf).collect()}[2] > 0
    brands = {r.doc_id: (r.brands, r.length) for r in content.F20_documents(spark, sf).collect()}
    assert (brands[9], brands[2]) == (("paypal", 26), ("", len(texts[2])))
    for r in content.F21_documents(spark, sf).collect():
        for name, words in config.LEXICONS.items():
            t = texts[r.doc_id]
            want = None if t is None else round(min(1.0, sum(w in t.lower() for w in words) / max(0.15 * len(words), 1)), 3)
            assert r[f"{name}_score"] == want


def test_pages_are_read(spark, tmp_path):
    rows = [(9, "https://a.test/x", "<title>One</title><p>hello"), (10, "http://192.0.2.7/login", "<title>Two</title><form action='http://other.test/'><input type=password></form>verify your account now")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    sf = str(tmp_path)
    scores = {r.page_id: (r.url, r.score) for r in content.Y1_scan(spark, sf).collect()}
    assert scores[9][0] == rows[0][1] and scores[10][1] > scores[9][1]
    assert {r.page_id: r.flags for r in content.A11_pages(spark, sf).collect()} == {9: "", 10: "ip_based_url"}
