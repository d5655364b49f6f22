import pytest
from oracle import differs

from riskloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_its_sql(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert not differs(df, catalog.ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", list(catalog.WITHOUT_SQL))
def test_query_without_sql_has_a_row_for_each_page_or_label(spark, name):
    table = "labels" if name.startswith("K6") else "pages"
    assert catalog.WITHOUT_SQL[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
