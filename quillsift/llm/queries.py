"""Queries of the training-data operators, with their production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: A line on so many sites or more is boilerplate.
MIN_SITES = 5
#: Words of a passage that is not kept twice.
WINDOW = 20


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillsift.llm.licenses import scan_documents

    found = scan_documents(read_table(spark, sf_dir, "documents"))
    return found.withColumn("spans", F.to_json("spans"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillsift.llm.line_dedup import mark_lines

    marked = mark_lines(read_table(spark, sf_dir, "documents"), MIN_SITES)
    return marked.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillsift.llm.bpe import round_trip_digests

    return round_trip_digests(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillsift.llm.simhash import near_duplicates

    found = near_duplicates(read_table(spark, sf_dir, "documents"), 4, 4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillsift.llm.quality import score_documents

    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = score_documents(docs, labels, id_remainder("doc_id", 5) != 0, 0.3)
    held_out = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillsift.llm.packing import pack_documents

    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 4096, 1)


def id_remainder(column: str, n: int) -> Column:
    """crc32 of an id as text, modulo n; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillsift.llm.language import learn, predict_documents

    docs = read_table(spark, sf_dir, "documents")
    model = learn(docs, id_remainder("doc_id", 4) != 2)
    held_out = F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False))
    return predict_documents(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op5_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillsift.llm.exact_dedup import exact_groups

    return exact_groups(read_table(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillsift.llm.ann import nearest

    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillsift.llm.substring_dedup import digests

    return digests(read_table(spark, sf_dir, "documents"), WINDOW)


def queries() -> dict[str, Query]:
    return {"op1_licenses": op1_licenses, "op2_lines": op2_lines, "op3_bpe": op3_bpe, "op4_language": op4_language, "op5_exact": op5_exact, "op6_simhash": op6_simhash, "op7_quality": op7_quality, "op8_pack": op8_pack, "op9_neighbours": op9_neighbours, "op10_substrings": op10_substrings}


def oracle_sql() -> dict[str, str]:
    from quillsift.llm import exact_dedup, line_dedup

    return {"op2_lines": line_dedup.oracle(MIN_SITES), "op5_exact": exact_dedup.ORACLE}
