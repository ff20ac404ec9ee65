"""Queries against their SQL on titles of odd digits and letters."""

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("titles"))
    texts = ["De 4115724970063573. Then more", 'Chä token = "5b2e2f55756f9b2783619675644c3383112c68f3" von. x', "Of 978-0-131-10362-7 and. y", "Plain words. z", "4451718024887799 27. a", ""]
    rows = [(n, t, "en", f"src{n}", len(t)) for n, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality long, toxic long").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("name", ["isbn_candidates", "query_words"])
def test_equals_sql(spark, folder, name):
    db = duckdb.connect()
    for table in ("documents", "labels"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = entry.queries()[name](spark, folder)
    expected = db.sql(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(expected)
