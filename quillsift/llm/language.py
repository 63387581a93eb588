"""Language identification by nearest centroids of TF-IDF vectors.

A text's byte 2- and 3-grams (lower-cased a-z; marks, digits and white space as one kind of separator) are hashed to a vector of damped counts,
weighted by inverse document frequency and normalised. Each language has several centroids, from clustering its documents by cosine,
and a text gets the language of its nearest centroid. Each centroid has a radius, from the distances of the documents that it was
made of; a text outside the radius of its nearest centroid is rejected. The reach is wider for short texts, which can't come as near.

The model is fitted on at most `max_fit_rows` labelled texts (those with the least hashes, at most `per_language` for
each language; copies count once), on the driver; predictions read every text whole. The model's size depends on the number of languages
only. Distinct hashes are counted by their size in bits, a row for each language and bit, which says below which power of two a language has
enough of them: about twice as many texts as are wanted are ranked, however many there are.

Cases: a null text, or one without a letter, is `und`, rejected, with score 0; long texts are counted in parts; repeated rows get equal
predictions; a null label or id is not learnt from; more languages than `max_fit_rows` raise; without labels everything is `und`; ties
between centroids go to the first language by name; an empty table gives an empty table; keep_known carries other columns, whatever
their names, through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.llm.common import small_batches, start_task, utf8

DIMENSIONS = 8192
PER_LANGUAGE = 400
MAX_FIT_ROWS = 4000
CLUSTERS = 4
#: A centroid's radius: this quantile of its documents' cosine distances, and as much of the way from there to 1.
QUANTILE, SLACK = 0.995, 0.4
#: A text of m different n-grams can come as near as about sqrt(m / (m + SHORT)) of what a long one can.
SHORT = 300
UNKNOWN = "und"
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
#: Documents whose vectors are held at once, and bytes of their texts.
_ROWS, _BYTES = 64, 1 << 18


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode()))


def counts(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed n-grams, a row for each text."""
    if len(texts) == 1 and len(texts[0]) > _BYTES:
        padded = b" " + texts[0].translate(_LETTERS) + b" "
        return sum(_counts([padded[at : at + _BYTES + 2]], min(_BYTES, len(padded) - at)) for at in range(0, len(padded), _BYTES))
    return _counts([b" " + t.translate(_LETTERS) + b" " for t in texts])


def _counts(padded: list[bytes], most: int | None = None) -> np.ndarray:
    """Counts of the n-grams that begin in the first `most` bytes of each."""
    raw = np.frombuffer(b"".join(padded), np.uint8).astype(np.uint32)
    row = np.repeat(np.arange(len(padded)), list(map(len, padded)))
    pair = raw[:-1] << 8 | raw[1:]
    triple = pair[:-1] << 8 | raw[2:]
    out = np.zeros((len(padded), DIMENSIONS), np.int64)
    for grams, width, salt in ((pair, 2, 0x9E3779B1), (triple, 3, 0x85EBCA77)):
        inside = (row[: len(grams)] == row[width - 1 :]) & (grams != (0x2020 if width == 2 else 0x202020))
        inside[len(raw) if most is None else most :] = False
        place = (grams[inside] * np.uint32(salt)) >> np.uint32(32 - 13)
        out += np.bincount(row[: len(grams)][inside] * DIMENSIONS + place, minlength=out.size).reshape(out.shape)
    return out


def groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if i > begin and (i - begin == _ROWS or held + len(t) > _BYTES):
            yield begin, i
            begin, held = i, 0
        held += len(t)
    if texts:
        yield begin, len(texts)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class LanguageModel:
    def __init__(self, languages: list[str], idf: np.ndarray, centroids: np.ndarray, of: np.ndarray, radius: np.ndarray):
        self.languages, self.idf, self.centroids, self.of, self.radius = languages, idf, centroids, of, radius

    def vectors(self, c: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(c, dtype=np.float32) * self.idf)

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is accepted, for each text."""
        names, scores, accepted = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        if not self.languages:
            return names, scores, accepted
        lettered = [i for i, t in enumerate(texts) if has_letter(t)]
        some = [texts[i] for i in lettered]
        for a, b in groups(some):
            table = counts(some[a:b])
            near = self.vectors(table) @ self.centroids.T
            best = near.argmax(axis=1)
            grams = (table > 0).sum(axis=1)
            least = (1 - self.radius[best]) * np.sqrt(grams / (grams + SHORT))
            for i, k, s, floor in zip(lettered[a:b], best.tolist(), near[np.arange(b - a), best].tolist(), least.tolist(), strict=True):
                names[i], scores[i], accepted[i] = self.languages[self.of[k]], min(1.0, max(0.0, s)), s >= floor
        return names, scores, accepted


def _clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids of at most k clusters by cosine; the first seeds are far from each other."""
    seeds = [_unit(x.mean(axis=0, keepdims=True))[0]]
    near = x @ seeds[0]
    while len(seeds) < min(k, len(x)):
        seeds.append(x[int(near.argmin())])
        near = np.maximum(near, x @ seeds[-1])
    centroids = np.array(seeds)
    for _ in range(10):
        nearest = (x @ centroids.T).argmax(axis=1)
        centroids = _unit(np.array([x[nearest == j].mean(axis=0) for j in range(len(centroids)) if (nearest == j).any()]))
    return centroids


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, max_fit_rows: int = MAX_FIT_ROWS) -> LanguageModel:
    """From rows (text, lang)."""
    spark = labelled.sparkSession
    # copies share a hash, and distinct hashes are counted
    least = F.shiftrightunsigned(F.xxhash64("text"), 1)  # 63 bits
    sizes = labelled.select("lang", least.alias("h")).distinct().groupBy("lang", F.length(F.bin("h")).alias("bits")).agg(F.count("*").alias("n"))
    found = sizes.limit(64 * max_fit_rows + 1).collect()  # 63 rows a language at most
    known = sorted({r["lang"] for r in found})
    if not known:
        return LanguageModel([], *(np.zeros(0),) * 4)
    if len(known) > max_fit_rows:
        raise ValueError(f"more than {max_fit_rows} languages")
    each = min(per_language, max_fit_rows // len(known))
    below = {}
    for lang in known:
        n = 0
        for bits, some in sorted((r["bits"], r["n"]) for r in found if r["lang"] == lang):
            n += some
            below[lang] = (1 << bits) - 1
            if n >= each:
                break
    limits = spark.createDataFrame(sorted(below.items()), "lang string, most long")  # a row for each language
    near = labelled.join(F.broadcast(limits), "lang").where(least <= F.col("most")).select("text", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(least, "text")  # of about twice as many rows as are wanted, for each language
    sample = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_task("language")
        for batch in batches:
            texts = utf8(batch.column(0))
            for a, b in groups(texts):
                table = counts(texts[a:b])
                rows = [np.flatnonzero(r) for r in table]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[a:b], batch.column(2)[a:b], pa.array([k.astype(np.uint16).tobytes() for k in rows], pa.binary()), pa.array([r[k].astype(np.int32).tobytes() for r, k in zip(table, rows, strict=True)], pa.binary())], ["lang", "n", "k", "c"]
                )

    rows = sorted(sample.select("text", "lang", "n").mapInArrow(run, "lang string, n int, k binary, c binary").collect(), key=lambda r: (r["lang"], r["n"]))  # at most max_fit_rows
    table = np.zeros((len(rows), DIMENSIONS), np.int32)
    for i, r in enumerate(rows):
        table[i, np.frombuffer(r["k"], np.uint16)] = np.frombuffer(r["c"], np.int32)
    languages = known
    idf = (np.log((1 + len(rows)) / (1 + (table > 0).sum(axis=0))) + 1).astype(np.float32)
    model = LanguageModel(languages, idf, *(np.zeros(0),) * 3)
    x = model.vectors(table)
    which = np.array([languages.index(r["lang"]) for r in rows])
    centroids, of, radius = [], [], []
    for i in range(len(languages)):
        own = x[which == i]
        found = _clusters(own, CLUSTERS)
        near = own @ found.T
        nearest = near.argmax(axis=1)
        for k, c in enumerate(found):
            away = 1 - near[nearest == k, k]
            reach = float(np.quantile(away, QUANTILE)) if len(away) else 0.0
            centroids.append(c)
            of.append(i)
            radius.append(reach + SLACK * (1 - reach))
    model.centroids, model.of, model.radius = np.array(centroids, np.float32), np.array(of), np.array(radius)
    return model


def learn(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """`train` says which rows may be learnt from."""
    text, lang = F.col(f"`{text_col}`"), F.col(f"`{lang_col}`")
    return fit(docs.where(train & lang.isNotNull() & text.rlike(r"\p{L}")).select(text.alias("text"), lang.cast("string").alias("lang")))


def predict_documents(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, accepted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_task("language")
        for batch in batches:
            names, scores, accepted = model.predict(utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(scores), pa.array(accepted)], ["doc_id", "lang_pred", "score", "accepted"])

    return small_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def keep_known(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs without the rejected rows."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_task("language")
        for batch in batches:
            yield batch.filter(pa.array(model.predict(utf8(batch.column(place)))[2], pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)
