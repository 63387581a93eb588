"""Every operator: the Spark column against a plain evaluator of rows, over values that include nulls, NaN and empty texts."""

import datetime as dt
import math
import random

import pytest

from quillsift import Catalog, FilterSpec
from quillsift.catalog import DataType
from quillsift.operators.predicates import Binder
from quillsift.operators.registry import OPERATORS, operators_for

CATALOG = Catalog.of(
    dict(id="s", type="string"), dict(id="n", type="number"), dict(id="b", type="boolean"), dict(id="d", type="date"), dict(id="e", type="enum", values=["Open", "Closed"]), dict(id="tags", type="array")
)
D = dt.datetime
ROWS = [
    (1, None, None, None, None, None, None),
    (2, "", 0.0, True, D(2024, 1, 15), "", []),
    (3, "null", float("nan"), False, D(2024, 1, 15, 23, 59, 59, 999000), "Open", ["a,b"]),
    (4, "Mixed Case", 5.0, True, D(2024, 1, 16), "Closed", ["a", "b"]),
    (5, "mixed case", -1.5, None, D(2023, 12, 31), "open", None),
    (6, "case", 1e9, False, D(2024, 1, 10, 12), "Open", ["null"]),
]
ARGS = {
    DataType.STRING: [("Mixed Case",), ("case",), ("",), ("null",), ("Mixed Case", "case"), ("absent",)],
    DataType.ENUM: [("Open",), ("Open", "Closed"), ("",)],
    DataType.NUMBER: [(5,), (0,), (-1.5,), (0, 5), (5.0, 1e9), ("5",), ("x",), (float("nan"),)],
    DataType.BOOLEAN: [(True,), (False,)],
    DataType.DATE: [(D(2024, 1, 15),), (D(2024, 1, 15, 12),), (D(2024, 1, 1), D(2024, 1, 15, 12)), ("last week",), ("2024-01-16",)],
    DataType.ARRAY: [("a,b",), ("b",), ("",)],
}
NOW = D(2024, 1, 15, 12)


def expected(column, op, args, v):
    null = v is None
    text = column.type in (DataType.STRING, DataType.ENUM)
    if op == "isEmpty":
        return null or text and v == ""
    if op == "isNotEmpty":
        return not (null or text and v == "")
    if op in ("isTrue", "isFalse"):
        return v is (op == "isTrue")
    if column.type == DataType.DATE:
        if null:
            return False
        span = (D(2024, 1, 8), D(2024, 1, 15, 23, 59, 59, 999000)) if args[0] == "last week" else None
        a = [D.fromisoformat(x) if isinstance(x, str) and x[0] == "2" else x for x in args]
        first = span[0] if span else a[0]
        if op == "between":
            lo, hi = span or (a if len(a) > 1 else (None, None))
            return lo is not None and lo <= v <= hi
        return {"eq": v.date() == first.date(), "neq": v.date() != first.date(), "lt": v < first, "before": v < first, "lte": v <= first, "gt": v > first, "after": v > first, "gte": v >= first}[op]
    negated = op in ("neq", "nin", "notContains", "neqIgnoreCase")
    if null:
        return negated
    if column.type == DataType.NUMBER:
        known = [float(x) for x in args if x != "x"]
        if op in ("in", "nin"):
            return (v in known or math.isnan(v) and any(map(math.isnan, known))) != negated
        if not known or math.isnan(known[0]) or len(known) < (2 if op == "between" else 1):
            return negated
        if op == "between" and len(known) != 2:
            return False
        k = known[0]
        return {"eq": v == k, "neq": v != k, "lt": v < k, "lte": v <= k, "gt": v > k, "gte": v >= k, "between": k <= v <= known[-1]}[op]
    held = ",".join(v) if column.type == DataType.ARRAY else v
    k = args[0]
    if op in ("in", "nin"):
        return (held in args) != negated
    return {
        "eq": held == k, "neq": held != k, "eqIgnoreCase": str(held).lower() == str(k).lower(), "neqIgnoreCase": str(held).lower() != str(k).lower(), "contains": str(k) in str(held), "notContains": str(k) not in str(held),
        "startsWith": str(held).startswith(str(k)), "endsWith": str(held).endswith(str(k)),
    }[op]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(ROWS, "id long, s string, n double, b boolean, d timestamp_ntz, e string, tags array<string>").cache()


@pytest.mark.parametrize("column", CATALOG.columns, ids=lambda c: c.id)
def test_operators_against_rows(edge, column):
    bind = Binder(CATALOG, edge.schema, NOW)
    place = edge.columns.index(column.id)
    cases = [(o.id, args) for o in operators_for(column.type) for args in (ARGS[column.type] if o.takes_argument else [()])]
    marked = edge.select("id", *(bind(FilterSpec(column.id, op, args)).alias(f"c{i}") for i, (op, args) in enumerate(cases))).collect()
    for r in marked:
        for i, (op, args) in enumerate(cases):
            assert bool(r[f"c{i}"]) == bool(expected(column, op, args, ROWS[r["id"] - 1][place])), (op, args, ROWS[r["id"] - 1][place])


def test_negations_complement(edge):
    bind = Binder(CATALOG, edge.schema, NOW)
    for a, b, column, args in (("in", "nin", "s", ("case", "x")), ("contains", "notContains", "s", ("as",)), ("eq", "neq", "n", (5,)), ("eqIgnoreCase", "neqIgnoreCase", "s", ("CASE",)), ("isEmpty", "isNotEmpty", "s", ())):
        yes, no = bind(FilterSpec(column, a, args)), bind(FilterSpec(column, b, args))
        assert edge.where(yes).count() + edge.where(no).count() == len(ROWS)
        assert edge.where(yes & no).count() == 0


def test_binding_errors(edge):
    bind = Binder(CATALOG, edge.schema, NOW)
    with pytest.raises(KeyError):
        bind(FilterSpec("nothing", "eq", (1,)))
    with pytest.raises(ValueError, match="requires a value"):
        bind(FilterSpec("s", "eq"))
    with pytest.raises(ValueError, match="is no date"):
        bind(FilterSpec("d", "eq", ("no such day",)))
    assert edge.where(bind(FilterSpec("s", "unknown", ("x",)))).count() == len(ROWS)


def test_pushdown(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame(ROWS, "id long, s string, n double, b boolean, d timestamp_ntz, e string, tags array<string>").write.parquet(path)
    df = spark.read.parquet(path)
    bind = Binder(CATALOG, df.schema, NOW)
    for spec, wanted in ((FilterSpec("s", "eq", ("case",)), "EqualTo(s,case)"), (FilterSpec("n", "between", (1, 2)), "GreaterThanOrEqual(n,1.0)"), (FilterSpec("s", "neq", ("x",)), "Not(EqualNullSafe(s,x))"), (FilterSpec("d", "eq", (D(2024, 1, 15),)), "GreaterThanOrEqual(d,2024-01-15T00:00)")):
        plan = df.where(bind(spec)).select("id")._jdf.queryExecution().executedPlan().toString()
        assert wanted in plan, plan
        assert "tags" not in plan.split("ReadSchema")[1].splitlines()[0]


def test_random_numbers(spark):
    r = random.Random(1)
    values = [r.choice([None, float("nan"), float("inf"), r.randrange(-5, 5), r.uniform(-5, 5)]) for _ in range(300)]
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "id long, n double")
    catalog = Catalog.of(dict(id="n", type="number"))
    bind = Binder(catalog, df.schema)
    for op in ("eq", "neq", "lt", "lte", "gt", "gte", "in", "nin"):
        k = r.randrange(-5, 5)
        got = {x["id"] for x in df.where(bind(FilterSpec("n", op, (k,)))).collect()}
        assert got == {i for i, v in enumerate(values) if expected(catalog.columns[0], op, (k,), None if v is None else float(v))}, op


def test_every_operator_is_covered():
    assert len(OPERATORS) == 21
