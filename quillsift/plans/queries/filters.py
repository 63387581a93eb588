"""Every operator as a filter, over the driver's tables and over rows that they lack."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.catalog import Catalog
from quillsift.operators.predicates import FilterSpec
from quillsift.plans import index as plans
from quillsift.plans.queries.base import DATASETS, LABELLED_SQL, NOW, Query, dataset, query
from quillsift.sources.dataset import Dataset

# name: (table, column, operator, arguments, the condition in SQL)
_D = dt.datetime
FILTERS: dict[str, tuple[str, str, str, tuple, str]] = {
    "eq_str": ("lineitem", "l_returnflag", "eq", ("R",), "l_returnflag = 'R'"),
    "eq_num": ("lineitem", "l_quantity", "eq", (17,), "l_quantity = 17"),
    "eq_date_day": ("orders", "o_orderdate", "eq", (_D(1996, 1, 2, 15),), "o_orderdate >= TIMESTAMP '1996-01-02' AND o_orderdate < TIMESTAMP '1996-01-03'"),
    "neq_str": ("orders", "o_orderstatus", "neq", ("O",), "o_orderstatus <> 'O'"),
    "neq_null": ("labelled", "quality", "neq", (1,), "quality IS DISTINCT FROM 1"),
    "neq_date": ("orders", "o_orderdate", "neq", (_D(1996, 1, 2),), "o_orderdate < TIMESTAMP '1996-01-02' OR o_orderdate >= TIMESTAMP '1996-01-03'"),
    "eq_ignore_case": ("part", "p_type", "eqIgnoreCase", ("ECONOMY",), "lower(p_type) = 'economy'"),
    "neq_ignore_case": ("orders", "o_orderpriority", "neqIgnoreCase", ("1-urgent",), "lower(o_orderpriority) IS DISTINCT FROM '1-urgent'"),
    "lt": ("lineitem", "l_quantity", "lt", (5,), "l_quantity < 5"),
    "lte": ("lineitem", "l_quantity", "lte", (5,), "l_quantity <= 5"),
    "gt": ("orders", "o_totalprice", "gt", (250000,), "o_totalprice > 250000 AND NOT isnan(o_totalprice)"),
    "gte": ("part", "p_size", "gte", (45,), "p_size >= 45"),
    "between_num": ("lineitem", "l_quantity", "between", (10, 20), "l_quantity BETWEEN 10 AND 20"),
    "before": ("orders", "o_orderdate", "before", ("1995-06-01",), "o_orderdate < TIMESTAMP '1995-06-01'"),
    "after": ("events", "ts", "after", (_D(2024, 1, 20, 6),), "ts > TIMESTAMP '2024-01-20 06:00:00'"),
    "lte_date": ("events", "ts", "lte", (_D(2024, 1, 5),), "ts <= TIMESTAMP '2024-01-05'"),
    "gte_date": ("events", "ts", "gte", (_D(2024, 1, 25),), "ts >= TIMESTAMP '2024-01-25'"),
    "between_date": ("orders", "o_orderdate", "between", ("1996-01-01", "1996-12-31"), "o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'"),
    "in_str": ("orders", "o_orderstatus", "in", ("F", "P"), "o_orderstatus IN ('F', 'P')"),
    "nin_str": ("orders", "o_orderpriority", "nin", ("1-URGENT", "2-HIGH"), "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')"),
    "in_num": ("part", "p_size", "in", (1, 7, 49), "p_size IN (1, 7, 49)"),
    "nin_null": ("labelled", "quality", "nin", (0, 5), "quality IS NULL OR quality NOT IN (0, 5)"),
    "contains": ("part", "p_name", "contains", ("re",), "contains(p_name, 're')"),
    "contains_text": ("conversations", "text", "contains", ("the",), "contains(text, 'the')"),
    "not_contains": ("part", "p_name", "notContains", ("a",), "p_name IS NULL OR NOT contains(p_name, 'a')"),
    "starts_with": ("part", "p_brand", "startsWith", ("Brand#1",), "starts_with(p_brand, 'Brand#1')"),
    "ends_with": ("part", "p_brand", "endsWith", ("3",), "ends_with(p_brand, '3')"),
    "is_empty": ("labelled", "quality", "isEmpty", (), "quality IS NULL"),
    "is_not_empty": ("labelled", "quality", "isNotEmpty", (), "quality IS NOT NULL"),
    "is_empty_text": ("conversations", "text", "isEmpty", (), "text IS NULL OR text = ''"),
    "is_true": ("labelled", "is_toxic", "isTrue", (), "is_toxic IS TRUE"),
    "is_false": ("labelled", "is_toxic", "isFalse", (), "is_toxic IS FALSE"),
}


def _filter(name: str) -> Query:
    of, column, operator, args, _ = FILTERS[name]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        data = dataset(spark, folder, of)
        return data.execute(FilterSpec(column, operator, args)).select(*dict.fromkeys((*data.key, column)))

    return run


def _filter_sql(name: str) -> str:
    of, column, _, _, condition = FILTERS[name]
    stored, _, key = DATASETS[of]
    return f"SELECT {', '.join(dict.fromkeys((*key, column)))} FROM {stored or LABELLED_SQL} WHERE {condition}"


for _name in FILTERS:
    query(_filter_sql(_name), _name)(_filter(_name))


# Rows that the driver's tables lack: nulls, empty and null-like texts, NaN, the ends of a day, arrays with nulls and commas.
_EDGE_ROWS = (
    (1, None, None, None, None),
    (2, "", float("nan"), dt.datetime(2024, 1, 1), ()),
    (3, "null", 0.0, dt.datetime(2024, 1, 1, 23, 59, 59, 999000), ("a,b",)),
    (4, "Mixed Case", 5.0, dt.datetime(2024, 1, 2), ("a", "b")),
    (5, "mixed case", -1.5, dt.datetime(2024, 1, 1, 23, 59, 59, 998000), ("a", None, "b")),
)
EDGE = Catalog.of(dict(id="s", type="string"), dict(id="n", type="number"), dict(id="d", type="date"), dict(id="tags", type="array"))


def _edge(spark: SparkSession) -> Dataset:
    rows = [(i, s, n, d, None if tags is None else list(tags)) for i, s, n, d, tags in _EDGE_ROWS]
    return Dataset(spark.createDataFrame(rows, "id long, s string, n double, d timestamp_ntz, tags array<string>"), EDGE, ("id",), NOW)


def _edge_sql() -> str:
    def cell(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, tuple):
            return f"[{', '.join(map(cell, x))}]::VARCHAR[]"
        if isinstance(x, dt.datetime):
            return f"TIMESTAMP '{x.isoformat(sep=' ')}'"
        return f"'{x}'::DOUBLE" if isinstance(x, float) else f"'{x}'" if isinstance(x, str) else str(x)

    return "(VALUES " + ", ".join(f"({', '.join(map(cell, r))})" for r in _EDGE_ROWS) + ") AS edge(id, s, n, d, tags)"


#: The text of an array: its elements, empty for nulls, with commas between.
_TAGS = "array_to_string([coalesce(t, '') for t in tags], ',')"
EDGE_FILTERS: dict[str, tuple[str, str, tuple, str]] = {
    "edge_array_contains": ("tags", "contains", ("a,b",), f"contains({_TAGS}, 'a,b')"),
    "edge_array_contains_null": ("tags", "contains", ("a,,b",), f"contains({_TAGS}, 'a,,b')"),
    "edge_array_not_contains": ("tags", "notContains", ("b",), f"tags IS NULL OR NOT contains({_TAGS}, 'b')"),
    "edge_array_is_empty": ("tags", "isEmpty", (), "tags IS NULL"),
    "edge_nan_gt": ("n", "gt", (-2,), "n > -2 AND NOT isnan(n)"),
    "edge_nan_neq": ("n", "neq", (0,), "n IS DISTINCT FROM 0"),
    "edge_nan_between": ("n", "between", (-2, 5), "n BETWEEN -2 AND 5"),
    "edge_text_is_empty": ("s", "isEmpty", (), "s IS NULL OR s = ''"),
    "edge_text_neq": ("s", "neq", ("null",), "s IS DISTINCT FROM 'null'"),
    "edge_text_neq_ignore_case": ("s", "neqIgnoreCase", ("MIXED case",), "lower(s) IS DISTINCT FROM 'mixed case'"),
    "edge_date_day": ("d", "eq", ("2024-01-01",), "d >= TIMESTAMP '2024-01-01' AND d < TIMESTAMP '2024-01-02'"),
    "edge_date_not_day": ("d", "neq", ("2024-01-01",), "d < TIMESTAMP '2024-01-01' OR d >= TIMESTAMP '2024-01-02'"),
}


def _edge_filter(name: str) -> Query:
    column, operator, args, _ = EDGE_FILTERS[name]
    return lambda spark, folder: _edge(spark).execute(FilterSpec(column, operator, args)).select("id")


for _name, (*_, _condition) in EDGE_FILTERS.items():
    query(f"SELECT id FROM {_edge_sql()} WHERE {_condition}", _name)(_edge_filter(_name))


def _edge_index_sql() -> str:
    texts = {"s": "s", "d": "strftime(d, '%Y-%m-%d %H:%M:%S.%g')", "tags": _TAGS}
    each = (f"SELECT '{c}' AS column_id, {t} AS value, count(*) AS row_count FROM {_edge_sql()} WHERE {c} IS NOT NULL GROUP BY 2" for c, t in texts.items())
    return " UNION ALL ".join(each)


@query(_edge_index_sql())
def edge_index(spark: SparkSession, folder: str) -> DataFrame:
    return plans.value_index(_edge(spark).df, ["s", "d", "tags"])


@query("SELECT p_partkey, replace(p_name, ' ', ',') AS words FROM part WHERE contains(replace(p_name, ' ', ','), 'e,b')")
def contains_array(spark: SparkSession, folder: str) -> DataFrame:
    words = dataset(spark, folder, "part").df.select("p_partkey", F.split("p_name", " ").alias("words"))
    found = Dataset(words, Catalog.of(dict(id="words", type="array")), ("p_partkey",)).execute(FilterSpec("words", "contains", ("e,b",)))
    return found.select("p_partkey", F.array_join("words", ",").alias("words"))


@query("SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-15 23:59:59.999'")
def date_phrase_last_week(spark: SparkSession, folder: str) -> DataFrame:
    return dataset(spark, folder, "events").execute(FilterSpec("ts", "between", ("last week",))).select("event_id", "ts")
