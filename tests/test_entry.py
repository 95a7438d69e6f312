"""The driver's contract on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_flagship_matches_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    got = entry.entry(spark)
    want = con.execute(entry.oracle_sql()["upcoming_split"]).fetchall()
    assert sorted(map(tuple, got.select("o_orderkey", "part", "sort_day", "start", "end").collect())) == sorted(want)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_values_beyond_the_small_tables(spark, tmp_path):
    """Keys of larger tables, and a title with entities that the SQL leaves as they are."""
    import duckdb

    spark.createDataFrame([(k,) for k in (0, 34, 461, 462, 6000, 60000)], "s_suppkey long").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(1, "<title>a &quot;b&quot; &amp; c</title>"), (2, "<title> x </title>")], "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    for name in ("supplier", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("areas_and_postal_codes", "page_titles"):
        got = entry.queries()[name](spark, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == sorted(con.execute(entry.oracle_sql()[name]).fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_costly_rows_of_small_files_go_to_all_tasks(spark):
    """A file of few bytes is read by one task: rows that take long are dealt out first; a date text is read once."""
    plan = lambda name: entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    for name in ("best_variant_match", "reconciled_records", "subcategories", "listed_date_ranges"):
        assert "REPARTITION_BY_NUM" in plan(name), name
    assert "keys=[said" in plan("listed_date_ranges")
