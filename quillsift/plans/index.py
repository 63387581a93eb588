"""Value frequencies, counts and availability, each as one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillsift.catalog import Catalog, DataType
from quillsift.functions.values import to_index_string


def _unpivoted(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_id, value) for every non-null cell."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    pairs = F.array(*(F.struct(F.lit(c).alias("column_id"), to_index_string(F.col(f"`{c}`"), kinds[c]).alias("value")) for c in columns))
    return df.select(F.explode(pairs).alias("p")).select("p.column_id", "p.value").where("value IS NOT NULL")


def _counted(df: DataFrame, column: str, kind: T.DataType) -> DataFrame:
    """One column's index: values are counted as they are and written as text once each; texts that several values share are added up."""
    counts = df.groupBy(F.col(f"`{column}`").alias("v")).agg(F.count("*").alias("row_count")).where("v IS NOT NULL")
    texts = counts.select(F.lit(column).alias("column_id"), to_index_string(F.col("v"), kind).alias("value"), "row_count")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.ArrayType)):
        return texts.groupBy("column_id", "value").agg(F.sum("row_count").alias("row_count"))
    return texts


def value_index(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_id, value, row_count. Each column is read and counted by itself, with one shuffle of partial counts, so that a columnar source is read
    once in all; a stream is read as (column, value) pairs, as it can have one aggregation only."""
    if df.isStreaming:
        return _unpivoted(df, columns).groupBy("column_id", "value").agg(F.count("*").alias("row_count"))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return reduce(DataFrame.unionByName, (_counted(df, c, kinds[c]) for c in columns))


def cardinality(index: DataFrame) -> DataFrame:
    return index.groupBy("column_id").agg(F.count("*").alias("cardinality"))


def approximate_cardinality(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of approximate distinct counts, without a shuffle of values."""
    return df.agg(*(F.approx_count_distinct(F.col(f"`{c}`")).alias(c) for c in columns))


def top_values(index: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent values of each column, ties by value."""
    order = Window.partitionBy("column_id").orderBy(F.desc("row_count"), "value")
    return index.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def index_stats(df: DataFrame, index: DataFrame) -> DataFrame:
    """One row: total_rows, columns_indexed, unique_values (distinct lower-cased values over all columns)."""
    rows = df.agg(F.count("*").alias("total_rows"))
    # both read the exchange of the index
    columns = index.groupBy("column_id").agg(F.count("*")).agg(F.count("*").alias("columns_indexed"))
    values = index.groupBy(F.lower("value").alias("text")).agg(F.count("*")).agg(F.count("*").alias("unique_values"))
    parts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (rows, columns, values))  # a row each
    return parts.agg(*(F.max(c).alias(c) for c in ("total_rows", "columns_indexed", "unique_values")))


def available_values(df: DataFrame, catalog: Catalog) -> DataFrame:
    """Distinct values in a context for columns of text, numbers and dates."""
    kinds = (DataType.STRING, DataType.ENUM, DataType.NUMBER, DataType.DATE)
    return value_index(df, [c.id for c in catalog.columns if c.type in kinds]).select("column_id", "value")


def merged_counts(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """One row with the count of every predicate, in one pass."""
    return df.agg(*(F.count_if(p).alias(name) for name, p in predicates.items()))


def facets(df: DataFrame, column: str, context: list[Column] = ()) -> DataFrame:
    """Value counts of a column within a context."""
    kept = reduce(lambda d, p: d.where(p), context, df)
    return value_index(kept, [column])
