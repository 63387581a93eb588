"""Row ids, row changes and text forms, on rows with nulls, ties, NaN and empty values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillsift.catalog import Catalog
from quillsift.operators.predicates import FilterSpec
from quillsift.plans import index as plans
from quillsift.sources.dataset import Dataset

EDGE = "id long, s string, n double, b boolean, d timestamp_ntz, tags array<string>, xs array<double>"
ROWS = [
    (1, None, None, None, None, None, None),
    (2, "", float("nan"), True, dt.datetime(2024, 1, 1), [], []),
    (3, "null", 0.0, False, dt.datetime(2024, 1, 1, 23, 59, 59, 999000), ["a,b"], [1.0, 1.5]),
    (4, "Mixed Case", 5.0, None, dt.datetime(2024, 1, 2), ["a", "b"], [None, 2.0]),
    (5, "mixed case", -1.5, True, dt.datetime(2024, 1, 1, 23, 59, 59, 998000), ["a", None, "b"], None),
]
CATALOG = Catalog.of(
    dict(id="s", type="string"), dict(id="n", type="number"), dict(id="b", type="boolean"), dict(id="d", type="date"), dict(id="tags", type="array"), dict(id="xs", type="array"),
)


@pytest.fixture(scope="module")
def edge(spark):
    return Dataset(spark.createDataFrame(ROWS, EDGE), CATALOG, ("id",), dt.datetime(2024, 1, 15, 12))


def ids(data, column, operator, *args):
    return [r["id"] for r in data.execute(FilterSpec(column, operator, args)).orderBy("id").collect()]


@pytest.mark.parametrize(
    "column, operator, args, expected",
    [
        ("tags", "contains", ("a,b",), [3, 4]),
        ("tags", "contains", ("a,,b",), [5]),
        ("tags", "notContains", ("a",), [1, 2]),
        ("tags", "isEmpty", (), [1]),
        ("tags", "isNotEmpty", (), [2, 3, 4, 5]),
        ("xs", "contains", ("1,1.5",), [3]),
        ("xs", "contains", (",2",), [4]),
        ("n", "gt", (-2,), [3, 4, 5]),
        ("n", "eq", (0,), [3]),
        ("n", "neq", (0,), [1, 2, 4, 5]),
        ("n", "between", (-2, 5), [3, 4, 5]),
        ("s", "isEmpty", (), [1, 2]),
        ("s", "contains", ("null",), [3]),
        ("s", "eqIgnoreCase", ("MIXED CASE",), [4, 5]),
        ("s", "nin", ("", "null"), [1, 4, 5]),
        ("d", "eq", ("2024-01-01",), [2, 3, 5]),
        ("d", "neq", ("2024-01-01",), [4]),
        ("d", "lte", (dt.datetime(2024, 1, 1),), [2]),
        ("b", "isFalse", (), [3]),
    ],
)
def test_edge_rows(edge, column, operator, args, expected):
    assert ids(edge, column, operator, *args) == expected


def test_index_and_filter_agree_on_texts(edge):
    """Every text that the value index has of an array finds rows, as many as the index counts or more."""
    rows = plans.value_index(edge.df, ["tags", "xs"]).where("value <> ''").collect()
    assert {(r["column_id"], r["value"]) for r in rows} == {("tags", "a,b"), ("tags", "a,,b"), ("xs", "1,1.5"), ("xs", ",2")}
    for r in rows:
        assert len(ids(edge, r["column_id"], "contains", r["value"])) >= r["row_count"]


def test_milliseconds_are_told_apart(edge):
    rows = plans.value_index(edge.df, ["d"]).collect()
    assert {r["value"] for r in rows} == {"2024-01-01 00:00:00.000", "2024-01-01 23:59:59.999", "2024-01-02 00:00:00.000", "2024-01-01 23:59:59.998"}


def test_index_stats(spark, edge):
    index = plans.value_index(edge.df, ["s", "b", "tags"])
    values = {"", "null", "mixed case", "true", "false", "a,b", "a,,b"}
    assert tuple(plans.index_stats(edge.df, index).first()) == (5, 3, len(values))
    assert tuple(plans.index_stats(edge.df.where("false"), index.where("false")).first()) == (0, 0, 0)


@pytest.mark.parametrize("setting", ["spark.sql.exchange.reuse", "spark.sql.adaptive.enabled", "spark.sql.adaptive.coalescePartitions.enabled"])
def test_row_ids_are_dense(spark, setting):
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        rows = spark.range(600_000).select(F.xxhash64("id").alias("k"), F.pmod("id", F.lit(7)).alias("tie")).repartition(12)
        data = Dataset(rows, Catalog.of(dict(id="k", type="number")))
        out = data.with_row_id("tie", "k")
        n, distinct, least, most = out.agg(F.count("*"), F.count_distinct("_row_id"), F.min("_row_id"), F.max("_row_id")).first()
        assert (n, distinct, least, most) == (600_000, 600_000, 0, 599_999)
        numbered = out.groupBy("tie").agg(F.min("_row_id").alias("a"), F.max("_row_id").alias("b")).orderBy("tie").collect()
        assert all(x["b"] < y["a"] for x, y in zip(numbered, numbered[1:]))
    finally:
        spark.conf.set(setting, before)


def test_row_ids_follow_the_order(edge):
    out = edge.with_row_id(*edge.order("n", True)).orderBy("_row_id").collect()
    assert [r["_row_id"] for r in out] == list(range(5)) and out[-1]["id"] == 1
    assert [r["id"] for r in edge.with_row_id("id").where("_row_id = 2").collect()] == [3]
    empty = Dataset(edge.df.where("false"), CATALOG, ("id",))
    assert empty.with_row_id("id").count() == 0


def test_remove_at(edge):
    left = edge.remove_at(1, "id")
    assert sorted(r["id"] for r in left.df.collect()) == [1, 3, 4, 5] and left.df.columns == edge.df.columns
    assert sorted(r["id"] for r in left.remove_at(1, "id").df.collect()) == [1, 4, 5]  # positions shift
    assert edge.remove_at(99, "id").df.count() == 5


def test_update_with_null_and_repeated_keys(spark):
    catalog = Catalog.of(dict(id="v", type="string"))
    data = Dataset(spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k int, v string"), catalog, ("k",))
    new = spark.createDataFrame([(None, "B"), (3, "C"), (3, "D"), (4, "E")], "k int, v string")
    first, again = ({(r["k"], r["v"]) for r in data.update(new.repartition(n)).df.collect()} for n in (1, 3))
    assert first == again and len(first) == 4
    assert {(1, "a"), (None, "B"), (4, "E")} < first and {v for k, v in first if k == 3} < {"C", "D"}
