"""The driver's tables as datasets, and the register of named queries."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillsift.catalog import Catalog
from quillsift.sources.dataset import Dataset
from quillsift.sources.tables import labelled_documents, table

Query = Callable[[SparkSession, str], DataFrame]
#: The reference time of every date phrase.
NOW = dt.datetime(2024, 1, 15, 12)

ORDERS = Catalog.of(
    dict(id="o_orderkey", type="number", name="Order"),
    dict(id="o_orderstatus", type="enum", name="Status", values=["F", "O", "P"]),
    dict(id="o_totalprice", type="number", name="Price", aliases=["total"]),
    dict(id="o_orderdate", type="date", name="Date", aliases=["ordered"]),
    dict(id="o_orderpriority", type="enum", name="Priority", aliases=["prio"]),
)
LINES = Catalog.of(
    dict(id="l_returnflag", type="enum", name="Flag"),
    dict(id="l_linestatus", type="enum", name="Status"),
    dict(id="l_quantity", type="number", name="Quantity"),
    dict(id="l_extendedprice", type="number", name="Price"),
    dict(id="l_shipdate", type="date", name="Shipped"),
)
PARTS = Catalog.of(
    dict(id="p_name", type="string", name="Name"),
    dict(id="p_brand", type="string", name="Brand"),
    dict(id="p_type", type="enum", name="Type"),
    dict(id="p_size", type="number", name="Size"),
)
LABELLED = Catalog.of(
    dict(id="lang", type="enum", name="Language"),
    dict(id="source", type="string"),
    dict(id="quality", type="number"),
    dict(id="is_toxic", type="boolean", name="Toxic"),
)
EVENTS = Catalog.of(
    dict(id="ts", type="date", name="Time"),
    dict(id="event_type", type="enum", name="Type"),
    dict(id="value", type="number"),
    dict(id="user_id", type="number"),
)
TALKS = Catalog.of(dict(id="role", type="enum"), dict(id="text", type="string"), dict(id="turn", type="number"))

#: By name: the table, its catalog and key.
DATASETS: dict[str, tuple[str, Catalog, tuple[str, ...]]] = {
    "orders": ("orders", ORDERS, ("o_orderkey",)),
    "lineitem": ("lineitem", LINES, ("l_orderkey", "l_linenumber")),
    "part": ("part", PARTS, ("p_partkey",)),
    "events": ("events", EVENTS, ("event_id",)),
    "conversations": ("conversations", TALKS, ("conv_id", "turn")),
    "labelled": ("", LABELLED, ("doc_id",)),
}
#: What SQL reads for a dataset, where that is no table.
LABELLED_SQL = """(
    SELECT d.doc_id, lang, source, quality, toxic = 1 AS is_toxic
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""


def dataset(spark: SparkSession, folder: str, name: str) -> Dataset:
    stored, catalog, key = DATASETS[name]
    df = table(spark, folder, stored) if stored else labelled_documents(spark, folder)
    return Dataset(df, catalog, key, NOW)


def inferred(spark: SparkSession, folder: str, name: str, key: str) -> Dataset:
    """A table with the catalog that its types give."""
    df = table(spark, folder, name)
    return Dataset(df, Catalog.infer(df.schema), (key,))


#: Named queries with the SQL that gives the same rows.
REGISTERED: dict[str, tuple[Query, str]] = {}


def query(sql: str, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name."""

    def register(run: Query) -> Query:
        REGISTERED[name or run.__name__] = run, sql
        return run

    return register
