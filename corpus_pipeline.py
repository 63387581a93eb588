"""The corpus pipeline: language, lines, near-duplicates, repeated passages, packing.

Each stage is one of the operators of quillsift.llm with the parameters of its query, takes (spark, docs, sf_dir) and works on all that the stage
before kept. All but the last return the columns of documents; where a stage changes a text, n_chars follows it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm import language, line_dedup, packing, simhash, substring_dedup
from quillsift.llm.common import read_table, shared_folder
from quillsift.llm.queries import MIN_SITES, WINDOW, id_remainder, tokenizer_path


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars, where there is one, as their texts have it now."""
    return docs.select(*(F.coalesce(F.length("text").cast("long"), F.col("n_chars")).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go."""
    return language.keep_known(docs, language.learn(docs, id_remainder("doc_id", 4) != 2))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sites share stay in their first document only."""
    return _counted(line_dedup.dedup_lines(docs, MIN_SITES))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_first(docs, 4, 4)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of a window or more stay where they come first."""
    return _counted(substring_dedup.remove_repeats(docs, WINDOW))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), 4096, 1)


STAGES = [
    ("language_id", known_languages),
    ("line_dedup", without_boilerplate),
    ("simhash_near_dedup", without_near_duplicates),
    ("substring_dedup", without_repeats),
    ("best_fit_packing", packed),
]

#: SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over documents; each result is written as Parquet in the shared folder and read again. A stage's table is removed once
    the next one is written; the last one is read by the result, and stays."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
