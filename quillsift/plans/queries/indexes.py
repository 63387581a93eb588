"""Value indexes, counts, facets and row sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.operators.predicates import FilterSpec
from quillsift.plans import index as plans
from quillsift.plans.queries.base import EVENTS, dataset, query
from quillsift.plans.rowsets import RowSet
from quillsift.sources.dataset import Dataset
from quillsift.sources.tables import table
from quillsift.streaming.incremental import merge_index


def _number(c: str) -> str:
    """The text form of a number in SQL."""
    return f"CASE WHEN {c} = floor({c}) THEN {c}::BIGINT::VARCHAR ELSE {c}::VARCHAR END"


def _time(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%g')"


#: Columns of orders with their text forms in SQL.
_INDEXED = {
    "o_orderstatus": "o_orderstatus",
    "o_orderpriority": "o_orderpriority",
    "o_custkey": "o_custkey::VARCHAR",
    "o_totalprice": _number("o_totalprice"),
    "o_orderdate": _time("o_orderdate"),
}
_EVENT_TEXTS = {"ts": _time("ts"), "event_type": "event_type", "value": _number("value"), "user_id": "user_id::VARCHAR"}
INDEX_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_id, {t} AS value, count(*) AS row_count FROM orders WHERE {c} IS NOT NULL GROUP BY 2" for c, t in _INDEXED.items()
)


@query("""
SELECT 'l_linestatus' AS column_id, l_linestatus AS value, count(*) AS row_count
FROM lineitem WHERE l_returnflag = 'R' AND l_quantity BETWEEN 10 AND 20 GROUP BY 2
""")
def flagship_facets(spark: SparkSession, folder: str) -> DataFrame:
    """Returned lines of 10 to 20 pieces: counts by line status in that context."""
    kept = dataset(spark, folder, "lineitem").context([FilterSpec("l_returnflag", "eq", ("R",)), FilterSpec("l_quantity", "between", (10, 20))])
    return plans.value_index(kept.df, ["l_linestatus"])


@query(INDEX_SQL)
def value_index(spark: SparkSession, folder: str) -> DataFrame:
    return plans.value_index(table(spark, folder, "orders"), list(_INDEXED))


@query(INDEX_SQL)
def value_index_merge(spark: SparkSession, folder: str) -> DataFrame:
    """The indexes of even and odd orders, added."""
    orders = table(spark, folder, "orders")
    even, odd = (plans.value_index(orders.where(f"o_orderkey % 2 = {k}"), list(_INDEXED)) for k in (0, 1))
    return merge_index(even, odd)


@query(f"SELECT column_id, count(*) AS cardinality FROM ({INDEX_SQL}) GROUP BY 1")
def cardinality(spark: SparkSession, folder: str) -> DataFrame:
    return plans.cardinality(value_index(spark, folder))


@query(f"""
SELECT *, row_number() OVER (PARTITION BY column_id ORDER BY row_count DESC, value) AS rank FROM ({INDEX_SQL}) QUALIFY rank <= 10
""")
def top_values(spark: SparkSession, folder: str) -> DataFrame:
    return plans.top_values(value_index(spark, folder), 10)


@query(f"""
SELECT (SELECT count(*) FROM orders) AS total_rows, count(DISTINCT column_id) AS columns_indexed, count(DISTINCT lower(value)) AS unique_values
FROM ({INDEX_SQL})
""")
def index_stats(spark: SparkSession, folder: str) -> DataFrame:
    return plans.index_stats(table(spark, folder, "orders"), value_index(spark, folder))


@query(" UNION ALL ".join(f"SELECT DISTINCT '{c}' AS column_id, {t} AS value FROM events WHERE event_type = 'click' AND {c} IS NOT NULL" for c, t in _EVENT_TEXTS.items()))
def context_available_values(spark: SparkSession, folder: str) -> DataFrame:
    return plans.available_values(dataset(spark, folder, "events").context([FilterSpec("event_type", "eq", ("click",))]).df, EVENTS)


@query("SELECT count(*) AS count FROM orders WHERE o_orderstatus IN ('F', 'P')")
def filter_count(spark: SparkSession, folder: str) -> DataFrame:
    return dataset(spark, folder, "orders").count(FilterSpec("o_orderstatus", "in", ("F", "P")))


def _predicates(data: Dataset) -> dict[str, Column]:
    specs = {
        "urgent": ("o_orderpriority", "eq", ("1-URGENT",)),
        "open_or_partial": ("o_orderstatus", "in", ("O", "P")),
        "dear": ("o_totalprice", "gte", (300000,)),
        "year_1995": ("o_orderdate", "between", ("1995-01-01", "1995-12-31 23:59:59")),
    }
    return {name: data.bind(FilterSpec(*spec)) for name, spec in specs.items()}


_COUNTS_SQL = """
SELECT count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent,
    count(*) FILTER (o_orderstatus IN ('O', 'P')) AS open_or_partial,
    count(*) FILTER (o_totalprice >= 300000) AS dear,
    count(*) FILTER (o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31 23:59:59') AS year_1995
FROM orders"""


@query(_COUNTS_SQL)
def merged_counts(spark: SparkSession, folder: str) -> DataFrame:
    data = dataset(spark, folder, "orders")
    return plans.merged_counts(data.df, _predicates(data))


@query(_COUNTS_SQL + " WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def stacked_context_counts(spark: SparkSession, folder: str) -> DataFrame:
    data = dataset(spark, folder, "orders").context([FilterSpec("o_orderstatus", "eq", ("F",)), FilterSpec("o_totalprice", "gt", (100000,))])
    return plans.merged_counts(data.df, _predicates(data))


_FINISHED, _DEAR = "o_orderstatus = 'F'", "o_totalprice > 150000"
_SETS = {
    "a": _FINISHED,
    "b": _DEAR,
    "and": f"{_FINISHED} AND {_DEAR}",
    "or": f"{_FINISHED} OR {_DEAR}",
    "and_not": f"{_FINISHED} AND NOT {_DEAR}",
    "xor": f"({_FINISHED}) <> ({_DEAR})",
}


def _row_sets(spark: SparkSession, folder: str) -> tuple[RowSet, RowSet]:
    data = dataset(spark, folder, "orders")
    specs = FilterSpec("o_orderstatus", "eq", ("F",)), FilterSpec("o_totalprice", "gt", (150000,))
    return tuple(RowSet.of(data.df, data.bind(spec), "o_orderkey") for spec in specs)


@query(" UNION ALL ".join(f"SELECT '{name}' AS set, count(*) AS cardinality FROM orders WHERE {condition}" for name, condition in _SETS.items()))
def row_set_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many orders are in each of two sets, in both, either, the first only, or one of them."""
    a, b = _row_sets(spark, folder)
    each = {"a": a, "b": b, "and": a.and_(b), "or": a.or_(b), "and_not": a.and_not(b), "xor": a.xor(b)}
    return reduce(DataFrame.unionByName, (s.cardinality().select(F.lit(name).alias("set"), "cardinality") for name, s in each.items()))


@query(f"SELECT o_orderkey AS _row_id FROM orders WHERE {_SETS['xor']}")
def row_set_ids(spark: SparkSession, folder: str) -> DataFrame:
    a, b = _row_sets(spark, folder)
    return a.xor(b).ids()
