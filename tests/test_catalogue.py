"""Each query against its SQL in DuckDB, and the segmentation views on small texts."""

import duckdb
import pytest

from quillmark.operators import views
from quillmark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(df):
    cols = sorted(df.columns)
    rows = df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False)
    return cols, sorted(str(tuple(round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    assert canonical(catalogue.QUERIES[name](spark, SF).toPandas()) == canonical(duck.sql(catalogue.ORACLE[name]).df())


def test_units_of_small_texts(spark):
    docs = spark.createDataFrame([(1, "One two. Three!\nFour"), (2, ""), (3, None), (4, " \n ")], "doc_id long, text string").selectExpr("*", "'en' AS lang")
    got = [(r.doc_id, r.pos, r.text, r.n_words) for r in views.units(docs).orderBy("doc_id", "pos").collect()]
    assert got == [(1, 1, "One two.", 2), (1, 2, "Three!", 1), (1, 3, "Four", 1)]


def test_numbers_have_one_form(spark):
    docs = spark.createDataFrame([(1, "3,860 3860 7.0 007 0.50, x12 1,2 0 .5")], "doc_id long, text string")
    assert sorted(r.value for r in views.numbers(docs, "doc_id").collect()) == ["0", "0.5", "3860", "3860", "7", "7"]
