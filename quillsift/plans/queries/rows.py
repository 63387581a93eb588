"""Order, positions and changes of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.catalog import Catalog
from quillsift.operators.predicates import FilterSpec
from quillsift.plans.queries.base import LABELLED, LABELLED_SQL, NOW, dataset, inferred, query
from quillsift.sources.dataset import Dataset
from quillsift.sources.tables import table


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS _row_id FROM orders")
def row_ids(spark: SparkSession, folder: str) -> DataFrame:
    return dataset(spark, folder, "orders").with_row_id("o_orderkey").select("o_orderkey", "_row_id")


@query(f"SELECT doc_id, quality FROM {LABELLED_SQL} ORDER BY quality DESC NULLS LAST, doc_id")
def sort_nulls_last(spark: SparkSession, folder: str) -> DataFrame:
    return dataset(spark, folder, "labelled").sort("quality", True).select("doc_id", "quality")


@query(f"SELECT doc_id, quality, row_number() OVER (ORDER BY quality DESC NULLS LAST, doc_id) - 1 AS position FROM {LABELLED_SQL}")
def sort_nulls_last_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Every row's place, from 0, in the order of sort_nulls_last."""
    whole = dataset(spark, folder, "labelled")
    catalog = Catalog(tuple(c for c in LABELLED.columns if c.id == "quality"))
    data = Dataset(whole.df.select("doc_id", "quality"), catalog, whole.key, NOW)
    return data.with_row_id(*data.order("quality", True)).withColumnRenamed("_row_id", "position")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
def top_k(spark: SparkSession, folder: str) -> DataFrame:
    return dataset(spark, folder, "orders").top("o_totalprice", 25).select("o_orderkey", "o_totalprice")


@query("SELECT o_custkey, o_orderstatus, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1, 2")
def first_wins_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """The first order of each customer and status."""
    first = F.min_by(F.struct("o_orderkey", "o_totalprice"), "o_orderkey").alias("first")
    return table(spark, folder, "orders").groupBy("o_custkey", "o_orderstatus").agg(first).select("o_custkey", "o_orderstatus", "first.*")


@query("SELECT * FROM supplier UNION ALL SELECT s_suppkey + 1000000, upper(s_name), s_nationkey, s_acctbal FROM supplier")
def add_rows(spark: SparkSession, folder: str) -> DataFrame:
    data = inferred(spark, folder, "supplier", "s_suppkey")
    return data.add(data.df.withColumns({"s_suppkey": F.col("s_suppkey") + 1000000, "s_name": F.upper("s_name")})).df


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS n_name, n_regionkey FROM nation")
def update_rows(spark: SparkSession, folder: str) -> DataFrame:
    data = inferred(spark, folder, "nation", "n_nationkey")
    return data.update(data.df.where("n_regionkey = 1").withColumn("n_name", F.lower("n_name"))).df


@query("SELECT * FROM nation WHERE n_regionkey NOT IN (1, 3)")
def remove_rows(spark: SparkSession, folder: str) -> DataFrame:
    return inferred(spark, folder, "nation", "n_nationkey").remove(FilterSpec("n_regionkey", "in", (1, 3))).df


@query("SELECT * FROM nation WHERE n_nationkey <> 7")
def remove_row(spark: SparkSession, folder: str) -> DataFrame:
    return inferred(spark, folder, "nation", "n_nationkey").remove_key(7).df


@query("SELECT * FROM nation QUALIFY row_number() OVER (ORDER BY n_name) <> 5")
def remove_row_at(spark: SparkSession, folder: str) -> DataFrame:
    """Without the row at position 4, from 0, by name."""
    return inferred(spark, folder, "nation", "n_nationkey").remove_at(4, "n_name").df
