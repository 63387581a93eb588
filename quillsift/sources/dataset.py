"""Rows under a catalog: contexts, execution, order and changes. Every change is a new Dataset; data is never collected."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.catalog import Catalog, DataType
from quillsift.operators.predicates import Binder, FilterSpec
from quillsift.sources.storage import cut


@dataclass(frozen=True)
class Dataset:
    """`key` names the columns that tell rows apart; changes by row need it."""

    df: DataFrame
    catalog: Catalog
    key: tuple[str, ...] = ()
    now: dt.datetime | None = None
    locale: str = "en"

    def __post_init__(self):
        self.catalog.check(self.df.schema)

    @property
    def bind(self) -> Binder:
        return Binder(self.catalog, self.df.schema, self.now, self.locale)

    def _as_column(self, condition: FilterSpec | Column) -> Column:
        return self.bind(condition) if isinstance(condition, FilterSpec) else condition

    def context(self, filters: Iterable[FilterSpec]) -> Dataset:
        """The rows that all filters match."""
        filters = list(filters)
        return replace(self, df=self.df.where(self.bind.all_of(filters))) if filters else self

    def execute(self, condition: FilterSpec | Column) -> DataFrame:
        return self.df.where(self._as_column(condition))

    def count(self, condition: FilterSpec | Column) -> DataFrame:
        return self.df.agg(F.count_if(self._as_column(condition)).alias("count"))

    def order(self, column: str, descending: bool = False) -> tuple[Column, ...]:
        """Nulls last either way; true before false ascending; texts by bytes; ties by key."""
        kind = self.catalog.get(column)
        c = F.col(f"`{column}`")
        if kind is not None and kind.type == DataType.BOOLEAN:
            c = ~c
        return c.desc_nulls_last() if descending else c.asc_nulls_last(), *(F.col(f"`{k}`") for k in self.key)

    def sort(self, column: str, descending: bool = False) -> DataFrame:
        """The rows in the order of `order`."""
        return self.df.orderBy(*self.order(column, descending))

    def top(self, column: str, n: int, descending: bool = True) -> DataFrame:
        return self.sort(column, descending).limit(n)

    # changes

    def add(self, rows: DataFrame) -> Dataset:
        return replace(self, df=self.df.unionByName(rows, allowMissingColumns=True))

    def update(self, rows: DataFrame) -> Dataset:
        """Rows with a known key replace the old ones, the others are added. A null in a key equals a null. Of rows that share a key one
        counts: the one whose hash is greatest, so that the choice is the same each time."""
        self._needs_key()
        whole = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
        keys = [F.col(f"`{k}`") for k in self.key]
        one = rows.groupBy(*keys).agg(F.max_by(whole, F.xxhash64(whole)).alias("__row")).select("__row.*")
        new = one.select(*(k.alias(f"__key{i}") for i, k in enumerate(keys)))
        same = reduce(and_, (k.eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)))
        return replace(self, df=self.df.join(new, same, "left_anti").unionByName(one, allowMissingColumns=True))

    def remove(self, condition: FilterSpec | Column) -> Dataset:
        """Without the rows that match; where the condition is unknown, rows stay."""
        if not isinstance(condition, (FilterSpec, Column)):
            raise TypeError("a filter or a Spark column is needed; Python functions would take every row out of Spark")
        return replace(self, df=self.df.where(~F.coalesce(self._as_column(condition), F.lit(False))))

    def remove_key(self, *key) -> Dataset:
        self._needs_key()
        return self.remove(Dataset._equals(self.key, key))

    @staticmethod
    def _equals(names, values) -> Column:
        out = F.lit(True)
        for n, v in zip(names, values, strict=True):
            out &= F.col(f"`{n}`").eqNullSafe(v)
        return out

    def _needs_key(self) -> None:
        if not self.key:
            raise ValueError("this dataset has no key")

    def with_row_id(self, *order: str | Column) -> DataFrame:
        """_row_id from 0 in a stated order; rows that agree in it come in any order.

        Rows are dealt to ranges, sorted within each, and written once (a reliable checkpoint) with their range and place. Ids are
        that place plus the sizes of the ranges before, so that no task sees all rows and one ranging gives both.
        """
        order = tuple(F.col(f"`{c}`") if isinstance(c, str) else c for c in order)
        ranged = cut(self.df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()))
        part, within = F.shiftright("__place", 33), F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
        sizes = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("__size"))
        earlier = F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
        before = sizes.select("__part", F.coalesce(earlier, F.lit(0)).alias("__before"))
        placed = ranged.withColumn("__part", part).join(F.broadcast(before), "__part")  # as many rows as ranges
        return placed.select(*(f"`{c}`" for c in self.df.columns), (within + F.col("__before")).alias("_row_id"))

    def remove_at(self, position: int, *order: str | Column) -> Dataset:
        """Without the row at a position of a stated order (from 0); a position that no row has changes nothing."""
        return replace(self, df=self.with_row_id(*order).where(F.col("_row_id") != position).drop("_row_id"))
