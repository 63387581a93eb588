"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.sources.storage import cut, shared_folder

#: Bytes of text that a worker handles at once; longer documents are handled alone.
BLOCK_BYTES = 4 << 20
#: Bytes of an Arrow batch between Spark and its Python workers; one row can be larger.
BATCH_BYTES = 4 << 20


__all__ = ["blocks", "cut", "kept", "parts_at_spaces", "quiet_threads", "read_table", "row_key", "shared_folder", "small_batches", "start_task", "utf8"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches hold at most BATCH_BYTES, as a batch is held several times on its way to Python."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    now = re.fullmatch(r"(-?\d+)([kmgt]?)b?", conf.get(key).lower())
    size = int(now[1]) << 10 * " kmgt".index(now[2] or " ") if now else 0
    if not 0 < size <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of at most `limit` bytes together, or of one longer text."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield begin, i
            begin, held = i, 0
        held += len(text)
    if begin < len(texts):
        yield begin, len(texts)


_SPACES = re.compile(rb"[\x20\x09-\x0d]+")


def parts_at_spaces(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """Parts of a text of about `size` bytes that end after ASCII white space, so that each word is in one of them."""
    at = 0
    while at < len(text):
        gap = _SPACES.search(text, at + size) if len(text) - at > size else None
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end


_KEPT: dict[tuple[str, object], object] = {}


def start_task(kind: str) -> None:
    """Called in a worker when a task of a kind begins: what tasks of other kinds kept goes, and memory that isn't used is given back."""
    gone = [key for key in _KEPT if key[0] != kind]
    for key in gone:
        del _KEPT[key]
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where there is no such function
        ctypes.CDLL(None).malloc_trim(0)


def kept(kind: str, key: object, make: Callable[[], object]) -> object:
    """This worker's object of a kind, kept from task to task until a task of another kind begins."""
    if (kind, key) not in _KEPT:
        _KEPT[kind, key] = make()
    return _KEPT[kind, key]


def row_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """128 bits that tell rows apart by id and text; never null. Rows that agree in both are one."""
    text = F.col(f"`{text_col}`")
    parts = (F.col(f"`{id_col}`"), text.isNull(), text)
    return F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)


def quiet_threads() -> None:
    """Spark's cores are the parallelism; libraries in its workers use one thread each."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("OMP_NUM_THREADS", "1")
