"""Tables in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their labels where there are any; toxic as a boolean."""
    labels = table(spark, folder, "labels").select("doc_id", "quality", (F.col("toxic") == 1).alias("is_toxic"))
    return table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id", "left")


def sample_tasks(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """Seeded task rows for demos and benchmarks: the same for any number of partitions."""

    def pick(*values: str, salt: int):
        return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(len(values))) + 1).cast("int"))

    def upto(k: int, salt: int):
        return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(k))

    blocked = upto(100, 2) < 15
    return spark.range(1, n + 1).select(
        "id",
        F.when(blocked, "Blocked").otherwise(pick("Open", "In Progress", "Closed", salt=1)).alias("status"),
        F.concat_ws(" ", pick("Ada", "Alan", "Edsger", "Grace", "Barbara", "Donald", salt=3), pick("Byron", "Turing", "Hopper", "Liskov", "Knuth", salt=4)).alias("assignee"),
        (upto(5, 5) + 1).cast("int").alias("priority"),
        pick("Engineering", "Design", "Product", salt=6).alias("department"),
        F.date_add(F.lit("2024-01-01").cast("date"), upto(365, 7).cast("int")).alias("dueDate"),
        F.date_format(F.timestamp_seconds(F.lit(1672531200) + upto(31536000, 8)), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created"),
        blocked.alias("isBlocked"),
        F.concat_ws(". ", pick("Needs review", "Waiting for data", "Ready", salt=9), pick("Follow up", "Ship it", "Check logs", salt=10)).alias("comments"),
    )


def _marked(events: DataFrame, service: str, environment: str) -> DataFrame:
    return events.withColumns({"_service": F.lit(service), "_environment": F.lit(environment)})


def write_events(events: DataFrame, path: str, service: str, environment: str) -> None:
    """Appends events, marked with their service and environment, as Parquet by environment."""
    _marked(events, service, environment).write.mode("append").partitionBy("_environment").parquet(path)


def stream_events(events: DataFrame, path: str, checkpoint: str, service: str, environment: str, once: bool = False) -> StreamingQuery:
    """Writes a stream of events like write_events, also by batch (_batch): a batch that is run again after a failure replaces what it wrote
    before, so that each event is there once. `once`: ends when what there is has been written."""

    def write(batch: DataFrame, number: int) -> None:
        marked = _marked(batch, service, environment).withColumn("_batch", F.lit(number))
        marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_environment", "_batch").parquet(path)

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
