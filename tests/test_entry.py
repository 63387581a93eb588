"""The driver's contract, and every query with SQL against DuckDB."""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no driver tables here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else str(v) if v is not None and not isinstance(v, (bool, str)) else v


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["column_id", "value", "row_count"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    df = entry.queries()[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = sql.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_other_queries_run(spark, name):
    assert entry.queries()[name](spark, str(FOLDER)).count() > 0


def test_whole_order_has_every_row(spark):
    """Each row has its place, and those without a quality come last."""
    rows = entry.queries()["sort_nulls_last_positions"](spark, str(FOLDER)).orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(spark.read.parquet(f"{FOLDER}/documents.parquet").count()))
    order = [2 if r["quality"] is None else 1 - r["quality"] for r in rows]
    assert order == sorted(order) and set(order) == {0, 1, 2}


def test_available_values_of_every_column(spark):
    """Texts, numbers and dates alike have values in the context."""
    rows = entry.queries()["context_available_values"](spark, str(FOLDER)).groupBy("column_id").count().collect()
    found = {r["column_id"]: r["count"] for r in rows}
    assert set(found) == {"ts", "event_type", "value", "user_id"} and found["event_type"] == 1 and min(found["ts"], found["value"]) > 1
