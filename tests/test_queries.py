"""Every registered query against its DuckDB SQL, and properties of those without."""

import os

import duckdb
import pandas as pd
import pytest

from foliant.plans.oracle import SQL
from foliant.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    def plain(v):
        v = v.tolist() if hasattr(v, "tolist") else v
        if isinstance(v, list):
            return tuple(map(plain, v))
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(repr(tuple(map(plain, r))) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_are_there_and_the_same_again(spark, name):
    """Values of these operators are held against fixed cases and brute force in the other tests."""
    first = rows(QUERIES[name](spark, SF).toPandas())
    assert first == rows(QUERIES[name](spark, SF).toPandas()) and first


def test_page_round_trip(spark):
    from foliant.operators import positions

    counts = spark.createDataFrame([("b", i, n) for i, n in enumerate([10, 5, 8])], "book_id string, spine_index int, pages int")
    asked = spark.createDataFrame([("b", p) for p in range(-5, 101)], "book_id string, global_page long")
    got = {r.global_page: (r.spine_index, r.local_page) for r in positions.local_position(counts, asked).collect()}
    assert got[0] == got[-5] == (0, 0) and got[100] == (2, 7)
    back = positions.global_page(counts, spark.createDataFrame([("b", *got[p]) for p in range(1, 24)], "book_id string, spine_index int, local_page long"))
    assert sorted(r.global_page for r in back.collect()) == list(range(1, 24))


def test_nearest_finds_itself_and_ties_by_key(spark):
    from foliant.operators import vectors

    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<float>")
    got = vectors.nearest(v, v.selectExpr("vec_id query_id", "embedding"), 2).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got if r.query_id == 2) == [(2, 1, 1), (2, 2, 2)]
    with pytest.raises(ValueError):
        vectors.check(5, v)


def test_store_replaces_only_the_books_it_gets(spark, tmp_path):
    from foliant.sources.stores import Store

    s = Store(spark, str(tmp_path / "t"))
    s.save(spark.createDataFrame([("a", 1), ("b", 2)], "book_id string, x int"))
    s.save(spark.createDataFrame([("b", 3)], "book_id string, x int"))
    assert sorted((r.book_id, r.x) for r in s.load().collect()) == [("a", 1), ("b", 3)]
    assert s.exists("a") and not s.exists("c")


def test_stream_equals_batch(spark, tmp_path):
    from foliant.streaming.incremental import chunk_stream

    source = str(tmp_path / "in")
    spark.createDataFrame([("b", 1, "one\ntwo"), ("b", 2, "x")], "book_id string, chapter_id long, text string").write.parquet(source)
    stream = spark.readStream.schema("book_id string, chapter_id long, text string").parquet(source)
    chunk_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["book_id", "chapter_id", "term", "tf", "df", "tfidf", "rank"]
    assert set(e.oracle_sql()) <= set(e.queries())
