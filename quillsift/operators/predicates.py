"""Filters as Spark columns: the one evaluator for execution, contexts and previews.

Null cells match neq, nin, notContains, neqIgnoreCase (except for dates) and isEmpty, and nothing else. NaN matches no comparison.
A literal that the column's type can't hold matches nothing (everything, for the negated operators). Every predicate
is made of native expressions with literals on one side, so that Catalyst pushes it to the scan.
"""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillsift.catalog import Catalog, Column, DataType
from quillsift.functions.dates import ParsedDate, as_instant, parse_date
from quillsift.functions.values import to_index_string
from quillsift.operators.registry import OPERATORS


@dataclass(frozen=True)
class FilterSpec:
    """(column, operator, arguments). Date arguments may be dates, datetimes, ISO text, phrases or ParsedDate."""

    column: str
    operator: str
    args: tuple = ()

    @classmethod
    def of(cls, column: str, operator: str, value: Any = None) -> FilterSpec:
        args = () if value is None else tuple(value) if isinstance(value, (list, tuple)) else (value,)
        return cls(column, operator, args)

    @property
    def key(self) -> str:
        return f"{self.column}:{self.operator}:{self.args!r}"


_MISSING = object()
_NEGATED = {"neq", "nin", "notContains", "neqIgnoreCase"}


def _literal(value: Any, kind: DataType) -> Any:
    """The value as the column's type has it, or _MISSING."""
    if kind == DataType.NUMBER:
        if isinstance(value, bool) or value is None:
            return _MISSING
        try:
            number = float(value)
        except (TypeError, ValueError):
            return _MISSING
        return value if isinstance(value, int) else int(number) if number.is_integer() and abs(number) < 2**53 else number
    if kind == DataType.BOOLEAN:
        if isinstance(value, str):
            return {"true": True, "false": False}.get(value.lower(), _MISSING)
        return value if isinstance(value, bool) else _MISSING
    return value if isinstance(value, str) else _MISSING if value is None else str(value)


class Binder:
    """Builds predicates for a catalog over one schema."""

    def __init__(self, catalog: Catalog, schema: T.StructType, now: dt.datetime | None = None, locale: str = "en"):
        self.catalog, self.now, self.locale = catalog, now, locale
        self.types = {f.name: f.dataType for f in schema.fields}

    def __call__(self, spec: FilterSpec) -> SparkColumn:
        column = self.catalog.get(spec.column)
        if column is None:
            raise KeyError(f"no column {spec.column!r}")
        if spec.operator not in OPERATORS:
            return F.lit(True)
        operator = OPERATORS[spec.operator]
        if operator.takes_argument and not spec.args:
            raise ValueError(f"operator {spec.operator!r} requires a value")
        c = F.col(f"`{column.id}`")
        fixed = self._without_argument(spec.operator, c, column)
        if fixed is not None:
            return fixed
        if column.type == DataType.DATE:
            return self._date(spec, c, column)
        return self._plain(spec, c, column)

    def all_of(self, specs) -> SparkColumn:
        """The conjunction; true for no filters."""
        return reduce(lambda a, b: a & b, map(self, specs), F.lit(True))

    def _without_argument(self, operator: str, c: SparkColumn, column: Column) -> SparkColumn | None:
        text = isinstance(self.types[column.id], T.StringType)
        if operator == "isEmpty":
            return c.isNull() | (c == "") if text else c.isNull()
        if operator == "isNotEmpty":
            return c.isNotNull() & (c != "") if text else c.isNotNull()
        if operator in ("isTrue", "isFalse"):
            return c.eqNullSafe(operator == "isTrue") if column.type == DataType.BOOLEAN else F.lit(False)
        return None

    def _plain(self, spec: FilterSpec, c: SparkColumn, column: Column) -> SparkColumn:
        op = spec.operator
        if column.type == DataType.ARRAY:
            text = c = to_index_string(c, self.types[column.id])  # the text that the value index has
            literals = [str(a) for a in spec.args]
        else:
            text, literals = c, [_literal(a, column.type) for a in spec.args]
        if op in ("in", "nin"):
            known = [v for v in literals if v is not _MISSING]
            if op == "in":
                return c.isin(known) if known else F.lit(False)
            return c.isNull() | ~c.isin(known) if known else F.lit(True)
        v = literals[0]
        if v is _MISSING:
            return F.lit(op in _NEGATED)
        if isinstance(v, float) and math.isnan(v):
            return F.lit(op in _NEGATED)
        if op == "eq":
            return c == v
        if op == "neq":
            return ~c.eqNullSafe(v)
        if op in ("eqIgnoreCase", "neqIgnoreCase"):
            low = F.lower(text.cast("string"))
            same = F.lower(F.lit(str(v)))
            return low == same if op == "eqIgnoreCase" else ~low.eqNullSafe(same)
        if op in ("contains", "notContains", "startsWith", "endsWith"):
            text = text.cast("string")
            v = F.lit(str(v))
            return {
                "contains": lambda: text.contains(v),
                "notContains": lambda: text.isNull() | ~text.contains(v),
                "startsWith": lambda: text.startswith(v),
                "endsWith": lambda: text.endswith(v),
            }[op]()
        if op in ("lt", "lte", "gt", "gte", "before", "after"):
            below = op in ("lt", "lte", "before")
            compared = {"lt": c < v, "lte": c <= v, "gt": c > v, "gte": c >= v, "before": c < v, "after": c > v}[op]
            return compared if below or not self._floating(column) else compared & ~F.isnan(c)
        if len(literals) != 2 or literals[1] is _MISSING:
            return F.lit(False)
        return c.between(v, literals[1]) & (~F.isnan(c) if self._floating(column) and math.isinf(float(literals[1])) else F.lit(True))

    def _floating(self, column: Column) -> bool:
        return isinstance(self.types[column.id], (T.DoubleType, T.FloatType))

    def date_argument(self, value: Any) -> ParsedDate:
        if isinstance(value, ParsedDate):
            return value
        if isinstance(value, (dt.date, dt.datetime)):
            return ParsedDate(as_instant(value), None, str(value))
        parsed = parse_date(str(value), self.now, self.locale)
        if parsed is None:
            raise ValueError(f"{value!r} is no date")
        return parsed

    def _date(self, spec: FilterSpec, c: SparkColumn, column: Column) -> SparkColumn:
        kind = self.types[column.id]
        if isinstance(kind, T.StringType):
            c = F.try_to_timestamp(c).cast("timestamp_ntz")

        def at(instant: dt.datetime) -> SparkColumn:
            text = F.lit(instant.isoformat(sep=" "))
            return text.cast("timestamp") if isinstance(kind, T.TimestampType) else text.cast("timestamp_ntz")

        dates = [self.date_argument(a) for a in spec.args]
        first = dates[0]
        day = first.start.replace(hour=0, minute=0, second=0, microsecond=0)
        low, high = at(day), at(day + dt.timedelta(days=1))
        op = spec.operator
        if op == "between":
            if len(dates) > 1:
                start, end = sorted(d.start for d in dates[:2])
            elif first.end is not None:
                start, end = first.start, first.end
            else:
                return F.lit(False)
            return (c >= at(start)) & (c <= at(end))
        simple = {
            "eq": lambda: (c >= low) & (c < high),
            "neq": lambda: c.isNotNull() & ((c < low) | (c >= high)),
            "lt": lambda: c < at(first.start),
            "before": lambda: c < at(first.start),
            "lte": lambda: c <= at(first.start),
            "gt": lambda: c > at(first.start),
            "after": lambda: c > at(first.start),
            "gte": lambda: c >= at(first.start),
        }.get(op)
        return simple() if simple else F.lit(op in _NEGATED)
