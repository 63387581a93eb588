"""Declared columns: the meaning that a filter engine needs beside a DataFrame's schema."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from enum import StrEnum

from pyspark.sql import types as T


class DataType(StrEnum):
    STRING = "string"
    NUMBER = "number"
    BOOLEAN = "boolean"
    DATE = "date"
    ENUM = "enum"
    ARRAY = "array"


@dataclass(frozen=True)
class EnumValue:
    value: str
    label: str | None = None
    key: str | None = None


@dataclass(frozen=True)
class Column:
    """One column that can be filtered. `key` and the label keys are looked up at an i18n provider."""

    id: str
    type: DataType
    name: str = ""
    aliases: tuple[str, ...] = ()
    values: tuple[EnumValue, ...] = ()
    key: str | None = None
    true_label: str | None = None
    false_label: str | None = None
    true_key: str | None = None
    false_key: str | None = None

    @property
    def title(self) -> str:
        return self.name or self.id


_SPARK_TYPES = {
    DataType.STRING: (T.StringType,),
    DataType.ENUM: (T.StringType,),
    DataType.NUMBER: (T.NumericType,),
    DataType.BOOLEAN: (T.BooleanType,),
    DataType.DATE: (T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType),
    DataType.ARRAY: (T.ArrayType,),
}


@dataclass(frozen=True)
class Catalog:
    """Columns by id, in declared order."""

    columns: tuple[Column, ...]
    default_columns: tuple[str, ...] = ()
    _by_id: dict[str, Column] = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self):
        self._by_id.update((c.id, c) for c in self.columns)
        if len(self._by_id) != len(self.columns):
            raise ValueError("column ids repeat")

    @classmethod
    def of(cls, *columns: Column | dict) -> Catalog:
        """From columns, or from dicts with their fields."""
        built = []
        for c in columns:
            if isinstance(c, dict):
                c = dict(c)
                values = tuple(v if isinstance(v, EnumValue) else EnumValue(**v) if isinstance(v, dict) else EnumValue(v) for v in c.pop("values", ()))
                c = Column(type=DataType(c.pop("type")), aliases=tuple(c.pop("aliases", ())), values=values, **c)
            built.append(c)
        return cls(tuple(built))

    @classmethod
    def infer(cls, schema: T.StructType) -> Catalog:
        """Every column whose Spark type has a filter type."""

        def kind(t: T.DataType) -> DataType | None:
            order = (DataType.BOOLEAN, DataType.NUMBER, DataType.STRING, DataType.DATE, DataType.ARRAY)
            return next((k for k in order if isinstance(t, _SPARK_TYPES[k])), None)

        return cls(tuple(Column(f.name, k) for f in schema.fields if (k := kind(f.dataType))))

    def get(self, column_id: str) -> Column | None:
        return self._by_id.get(column_id)

    def ids(self) -> list[str]:
        return [c.id for c in self.columns]

    def type_histogram(self) -> dict[str, int]:
        return dict(Counter(str(c.type) for c in self.columns))

    def check(self, schema: T.StructType) -> None:
        """Raises if a declared column is missing from the data or has a type it can't be."""
        held = {f.name: f.dataType for f in schema.fields}
        for c in self.columns:
            if c.id not in held:
                raise ValueError(f"no column {c.id!r} in the data")
            if not isinstance(held[c.id], _SPARK_TYPES[c.type]):
                raise TypeError(f"column {c.id!r} is {held[c.id].simpleString()}, which is no {c.type}")
