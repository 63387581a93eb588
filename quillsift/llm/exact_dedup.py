"""Exact deduplication by content-defined chunk recipes.

White space is normalised, each text is cut where a rolling hash of its own bytes says so, and a text's recipe is the ordered list of its
chunks' identifiers. An identifier is a hash of 128 bits that is verified: every chunk's bytes travel once to the place of their hash, and
the least and greatest contents there must be equal, which is a partial aggregation, so that a very common chunk costs a row for each task.
Texts are equal when their recipes are; only recipes, some bytes a document, are grouped and joined.

Should different contents ever share a hash, the chunks of that hash are told apart by their bytes and numbered, and the recipes that
hold one get these numbers, so that equal recipes mean equal texts always.

Groups are counted with partial aggregation; the join of rows to their group has one row a group on the other side, so that Spark can
split a hot group.

Cases: a null text counts as empty; empty texts are equal to each other, but not to texts of white space alone, whose
normal form is one space; rows with the same id and text are counted each, and kept together when they are the
group's smallest id; a null id comes after every other; long texts are hashed in parts, and a chunk is MOST bytes at most; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillsift.llm.common import blocks, cut, small_batches, start_task, utf8

#: Bytes of a chunk: least, on average beyond the least, most.
LEAST, AVERAGE, MOST = 512, 2048, 16384
#: The rolling hash reads this many bytes, over parts of a text of so many.
WINDOW, PART = 16, 1 << 20
_SPACES = bytes(32 if b == 32 or 9 <= b <= 13 else b for b in range(256))
_GEAR = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)


def normalise(text: bytes) -> bytes:
    """Each run of ASCII white space as one space."""
    text = text.translate(_SPACES)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


def _marks(raw: np.ndarray, lead: int) -> np.ndarray:
    """The places after which a chunk may end, from the byte after `lead` bytes that are read only."""
    h = _GEAR[raw]
    for shift in (1, 2, 4, 8):
        later = h[shift:] + (h[:-shift] << np.uint32(shift))
        h[shift:] = later
    return np.flatnonzero((h[lead:] >> np.uint32(8)) & np.uint32(AVERAGE - 1) == 0) + 1


def cuts(texts: list[bytes]) -> Iterator[list[int]]:
    """The places at which each text's chunks end. They depend on the text's own bytes only: no chunk ends before
    LEAST bytes, and the rolling hash reads fewer."""
    if not texts:
        return
    raw = np.frombuffer(b"".join(texts), np.uint8)
    found = np.concatenate([_marks(raw[max(0, at - WINDOW + 1) : at + PART], min(at, WINDOW - 1)) + at for at in range(0, max(1, len(raw)), PART)])
    begin = 0
    for text in texts:
        end, at, out = begin + len(text), begin, []
        for place in found[np.searchsorted(found, begin + LEAST) : np.searchsorted(found, end)].tolist():
            while place - at > MOST:
                at += MOST
                out.append(at - begin)
            if place - at >= LEAST:
                at = place
                out.append(at - begin)
        while end - at > MOST:
            at += MOST
            out.append(at - begin)
        if end > at or not out:
            out.append(end - begin)
        yield out
        begin = end


CHUNKS = "h1 long, h2 long, content binary"
RECIPES = "doc_id long, sha binary, recipe binary"


def identifier(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def _cut_documents(each, names: list[str], kinds: list[pa.DataType]):
    """A function for mapInArrow over (doc_id, text): `each` makes rows of a block's ids, normal texts and chunk ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_task("exact")
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), utf8(batch.column(1))
            for first, last in blocks(texts):
                normal = [normalise(t) for t in texts[first:last]]
                rows = each(ids[first:last], normal, cuts(normal))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return small_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def _halves(name: bytes) -> tuple[int, int]:
    return int.from_bytes(name[:8], "big", signed=True), int.from_bytes(name[8:], "big", signed=True)


def chunks_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct chunks of each batch (CHUNKS)."""

    def each(ids, normal, ends) -> list[tuple]:
        held = {text[a:b] for text, places in zip(normal, ends, strict=True) for a, b in zip([0, *places], places)}
        return [(*_halves(identifier(c)), c) for c in held]

    return _texts(docs, id_col, text_col).mapInArrow(_cut_documents(each, ["h1", "h2", "content"], [pa.int64(), pa.int64(), pa.binary()]), CHUNKS)


def recipes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: its id, the SHA-256 of its normal form, and its identifiers in order (RECIPES)."""

    def each(ids, normal, ends) -> list[tuple]:
        return [(d, hashlib.sha256(text).digest(), b"".join(identifier(text[a:b]) for a, b in zip([0, *places], places))) for d, text, places in zip(ids, normal, ends, strict=True)]

    return _texts(docs, id_col, text_col).mapInArrow(_cut_documents(each, ["doc_id", "sha", "recipe"], [pa.int64(), pa.binary(), pa.binary()]), RECIPES)


def colliding(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The hashes (h1, h2) that chunks of different contents share; none, unless a hash fails."""
    verified = chunks_of(docs, id_col, text_col).groupBy("h1", "h2").agg(F.min("content").alias("least"), F.max("content").alias("most"))
    return cut(verified.where("least <> most").select("h1", "h2"))


def _numbered(docs: DataFrame, bad: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The recipes of all rows, where an identifier of a hash in `bad` is followed by its content's number."""
    contents = chunks_of(docs, id_col, text_col).join(bad, ["h1", "h2"], "left_semi").distinct()
    numbers = cut(contents.withColumn("number", F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("content"))))

    def each(ids, normal, ends) -> list[tuple]:
        return [
            (d, hashlib.sha256(text).digest(), pos, *_halves(identifier(text[a:b])), text[a:b])
            for d, text, places in zip(ids, normal, ends, strict=True)
            for pos, (a, b) in enumerate(zip([0, *places], places))
        ]

    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    names = ["doc_id", "sha", "pos", "h1", "h2", "content"]
    places = _texts(docs, id_col, text_col).mapInArrow(_cut_documents(each, names, kinds), "doc_id long, sha binary, pos int, h1 long, h2 long, content binary")
    named = places.join(numbers, ["h1", "h2", "content"], "left").select("doc_id", "sha", "pos", F.struct("h1", "h2", F.coalesce("number", F.lit(0)).alias("number")).alias("name"))
    listed = F.transform(F.array_sort(F.array_distinct(F.collect_list(F.struct("pos", "name")))), lambda x: x["name"])
    recipes = named.groupBy("doc_id", "sha").agg(F.count_if(F.col("pos") == 0).cast("int").alias("rows"), F.to_json(listed).cast("binary").alias("recipe"))
    return recipes.select("doc_id", "sha", "recipe", F.explode(F.sequence(F.lit(1), "rows")).alias("copy")).drop("copy")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    bad = colliding(docs, id_col, text_col)
    recipes = recipes_of(docs, id_col, text_col) if bad.isEmpty() else _numbered(docs, bad, id_col, text_col)
    recipes = cut(recipes)
    # checkpointed apart from the join, whose hot groups Spark can split then
    groups = cut(recipes.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    return recipes.join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""
