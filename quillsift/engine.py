"""The engine: a catalog, a dataset and what is asked of them."""

from __future__ import annotations

import datetime as dt
from collections import OrderedDict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession

from quillsift.catalog import Catalog, DataType
from quillsift.catalog import Column as DeclaredColumn
from quillsift.operators.predicates import FilterSpec
from quillsift.operators.registry import Operator, operators_for
from quillsift.plans import index as plans
from quillsift.plans.parse import Parsed, as_filter_args, assign, find_matches
from quillsift.plans.strategies import STRATEGIES, Strategy
from quillsift.plans.suggest import SCHEMA, Response, Suggester, to_rows
from quillsift.plans.telemetry import Collector
from quillsift.sources.dataset import Dataset
from quillsift.sources.progress import job_group as in_job_group


@dataclass(frozen=True)
class EngineConfig:
    """now: the reference time of date phrases (the clock if None). persist: keeps value indexes in executor memory and disk.
    strategies: how suggestions are made, in order."""

    max_suggestions: int = 10
    locale: str = "en"
    provider: object | None = None
    now: dt.datetime | None = None
    persist: bool = True
    contexts: int = 20
    telemetry: bool = False
    strategies: tuple[Strategy, ...] = STRATEGIES


class Engine:
    def __init__(self, spark: SparkSession, config: EngineConfig | None = None):
        self.spark, self.config = spark, config or EngineConfig()
        self.catalog: Catalog | None = None
        self.dataset: Dataset | None = None
        self.collector = Collector(enabled=self.config.telemetry)
        self._indexes: OrderedDict[tuple, DataFrame] = OrderedDict()

    # set up

    def configure(self, **changes) -> None:
        self.config = replace(self.config, **changes)
        self.clear_cache()
        if self.dataset:
            self.dataset = replace(self.dataset, now=self.config.now, locale=self.config.locale)

    def set_schema(self, catalog: Catalog | Iterable[dict]) -> None:
        self.catalog = catalog if isinstance(catalog, Catalog) else Catalog.of(*catalog)
        self.clear_cache()
        if self.dataset:
            self.dataset = replace(self.dataset, catalog=self.catalog)

    def get_schema(self) -> Catalog | None:
        return self.catalog

    def get_column(self, column_id: str) -> DeclaredColumn | None:
        return self.catalog.get(column_id) if self.catalog else None

    def get_operators_for_column(self, column_id: str) -> list[Operator]:
        c = self.get_column(column_id)
        return operators_for(c.type) if c else []

    def index_data(self, df: DataFrame, key: Iterable[str] = ()) -> None:
        """Binds rows; the value index is made when it is first needed."""
        if self.catalog is None:
            self.catalog = Catalog.infer(df.schema)
        self._bind(Dataset(df, self.catalog, tuple(key), self.config.now, self.config.locale))

    def index_data_async(self, df: DataFrame, key: Iterable[str] = (), job_group: str = "quillsift-index", on_progress: Callable[[float], None] | None = None) -> None:
        """index_data, with the index of texts made at once in a job group, which spark.sparkContext.cancelJobGroup stops. `on_progress` hears of
        the share of tasks that are done."""
        self.index_data(df, key)
        with in_job_group(self.spark, job_group, on_progress):
            if (index := self._text_index()) is not None:
                index.count()

    def _bind(self, dataset: Dataset) -> None:
        self.dataset = dataset
        self.clear_cache()

    def _data(self) -> Dataset:
        if self.dataset is None:
            raise RuntimeError("no data is bound")
        return self.dataset

    # changes

    def add_row(self, rows: DataFrame) -> None:
        self._bind(self._data().add(rows))

    def update_rows(self, rows: DataFrame) -> None:
        self._bind(self._data().update(rows))

    def remove_row(self, *key) -> None:
        self._bind(self._data().remove_key(*key))

    def remove_rows(self, condition: FilterSpec | Column) -> None:
        self._bind(self._data().remove(condition))

    def get_data(self) -> DataFrame:
        return self._data().df

    def clear_index(self) -> None:
        self.dataset = None
        self.clear_cache()

    # the value index

    def value_index(self, context: Iterable[FilterSpec] = (), columns: Iterable[str] | None = None) -> DataFrame:
        """column_id, value, row_count in a context, of all columns or of some. The indexes of the last contexts are kept."""
        context = list(context)
        columns = self.catalog.ids() if columns is None else list(columns)
        key = tuple(sorted(f.key for f in context)), tuple(columns)
        if key in self._indexes:
            self._indexes.move_to_end(key)
            return self._indexes[key]
        made = plans.value_index(self._data().context(context).df, columns)
        if self.config.persist:
            made = made.persist()
        self._indexes[key] = made
        while len(self._indexes) > self.config.contexts:
            self._indexes.popitem(last=False)[1].unpersist()
        return made

    def _text_index(self, context: Iterable[FilterSpec] = ()) -> DataFrame | None:
        """The values that texts are matched with: numbers and dates are read from the text itself, however many the data has."""
        columns = [c.id for c in self.catalog.columns if c.type in (DataType.STRING, DataType.ENUM)]
        return self.value_index(context, columns) if columns else None

    def get_index_stats(self) -> DataFrame:
        data = self._data().df
        return plans.index_stats(data, plans.value_index(data, self.catalog.ids()))

    def available_values(self, context: Iterable[FilterSpec] = ()) -> DataFrame:
        return plans.available_values(self._data().context(context).df, self.catalog)

    def clear_cache(self) -> None:
        for df in self._indexes.values():
            df.unpersist()
        self._indexes.clear()

    # text

    def _found(self, text: str):
        return find_matches(text, self.catalog, self._text_index() if self.dataset else None, self.config.now, self.config.locale, self.config.provider)

    def parse(self, text: str) -> Parsed:
        return assign(self._found(text), self.catalog)

    def validate(self, text: str) -> tuple[bool, list[str], Parsed]:
        parsed = self.parse(text)
        return not parsed.errors, parsed.errors, parsed

    def compile(self, text: str) -> FilterSpec | None:
        spec = self.parse(text).spec
        return spec and FilterSpec(spec.column, spec.operator, as_filter_args(spec.args) if spec.operator == "between" else spec.args)

    def compile_filter(self, column_id: str, operator: str, value=None) -> FilterSpec | None:
        return FilterSpec.of(column_id, operator, value) if self.get_column(column_id) else None

    def suggest(self, text: str, cursor: int | None = None, context: Iterable[FilterSpec] = ()) -> Response:
        context = list(context)
        event = self.collector.start_event("suggest", query=text, filters=len(context))
        try:
            data = self._data().context(context)
            maker = Suggester(self.catalog, self.config.provider, self.config.now, self.config.locale, self.config.strategies)
            with event.phase("total"):
                out = maker.suggest(text, self._text_index(context), data.df, data.bind, self.config.max_suggestions, bool(context), cursor)
        except Exception as e:
            event.error(e)
            raise
        event.add(suggestions=len(out.suggestions)).success()
        return out

    def suggest_frame(self, text: str, context: Iterable[FilterSpec] = ()) -> DataFrame:
        return self.spark.createDataFrame(to_rows(self.suggest(text, None, context)), SCHEMA)

    # filters

    def execute(self, condition: FilterSpec | Column, context: Iterable[FilterSpec] = ()) -> DataFrame:
        return self._data().context(context).execute(condition)

    def count(self, condition: FilterSpec | Column, context: Iterable[FilterSpec] = ()) -> int:
        return self._data().context(context).count(condition).first()["count"]

    def get_telemetry(self) -> Collector | None:
        return self.collector if self.config.telemetry else None

    def destroy(self) -> None:
        self.clear_index()
        self.catalog = None
        self.collector.clear()
