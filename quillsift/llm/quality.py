"""Quality scores by random Fourier features, ridge regression and isotonic calibration.

Each text becomes a few statistics (lengths, shares of character classes, repetition of words and lines, compressibility), in one pass
over the documents that is checkpointed. Random Fourier features of the standardised statistics approximate a Gaussian kernel. The labelled
rows are dealt to FOLDS folds by their ids; each fold sums its part of the normal equations, and the driver adds these FOLDS matrices and
solves for the weights. A monotone map from raw scores to label rates, by pooling adjacent violators, calibrates them. It is fitted on
raw scores that each row gets from weights without its own fold, so that it sees no row's own label twice.

A score is 0.999 times the calibrated rate and 0.001 times the logistic of the raw score, which keeps the order within flat stretches of the map.

The fit uses about `max_fit_rows` labelled rows at most, those with the least hashes of their ids and statistics; rows that agree in id,
statistics and label count once. Statistics and scores cover every row.

Cases: a null or empty text has statistics of zero and gets a score like any other; long texts are read whole, in parts; labels that are null
are not learnt from; without labels every score is 0.5, with one label only it is that label; a null id is never learnt from and
is scored; of several labels for an id each counts; repeated rows and ties get equal scores; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import cut, parts_at_spaces, small_batches, start_task, utf8

MAX_FIT_ROWS = 200_000
FOLDS = 16
FEATURES = 400
RIDGE = 1e-3
#: Width of the kernel in standard deviations of a statistic, times the square root of their number.
WIDTH = 1.0
_CLASSES = 9
_CLASS = np.full(256, 8, np.int64)  # 8: other marks and controls
for _k, _members in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\n", b".,", b"!?", b"|-_=~", bytes(range(128, 256)))):
    _CLASS[list(_members)] = _k
STATISTICS = 11 + _CLASSES


def statistics(text: bytes) -> list[float]:
    n = len(text)
    if not n:
        return [0.0] * STATISTICS
    shares = np.zeros(_CLASSES)
    n_words = 0
    count: dict[bytes, int] = {}
    for part in parts_at_spaces(text):
        shares += np.bincount(_CLASS[np.frombuffer(part, np.uint8)], minlength=_CLASSES)
        words = part.split()
        n_words += len(words)
        for w in words:
            count[w] = count.get(w, 0) + 1
    shares /= n
    lines = [x for x in text.split(b"\n") if x]
    sizes = np.fromiter(map(len, count), float, len(count))
    times = np.fromiter(count.values(), float, len(count))
    total = max(1, n_words)
    mean = float(sizes @ times) / total
    return [
        np.log1p(n), np.log1p(n_words), mean, float(np.sqrt(max(0.0, (sizes**2) @ times / total - mean**2))), len(count) / total ** 0.8, max(times, default=0.0) / total,
        np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), sum(x[-1:] in b".!?" for x in lines) / max(1, len(lines)),
        len(zlib.compress(text, 1)) / n, *shares.tolist(),
    ]


def statistics_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, x (the statistics)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_task("quality")
        for batch in batches:
            x = [statistics(t) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return small_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


class FourierMap:
    """cos(w x + b) with fixed random w, for statistics standardised by mean and scale, and a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, width: float = WIDTH):
        random = np.random.default_rng(7)
        self.mean, self.scale = mean, np.where(scale > 1e-9 * np.maximum(1.0, np.abs(mean)), scale, 1.0)  # a constant's deviation is rounding
        self.w = random.normal(size=(len(mean), features)) / (width * np.sqrt(len(mean)))
        self.b = random.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])


def pool_adjacent_violators(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (x, rate) of the best monotone rate of y by x."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    values, weights, places = [], [], []
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        values.append(b)
        weights.append(1)
        places.append(a)
        while len(values) > 1 and values[-2] >= values[-1]:
            w = weights[-2] + weights[-1]
            values[-2:] = [(values[-2] * weights[-2] + values[-1] * weights[-1]) / w]
            places[-2:] = [(places[-2] * weights[-2] + places[-1] * weights[-1]) / w]
            weights[-2:] = [w]
    return np.asarray(places), np.asarray(values)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), STATISTICS)


class QualityModel:
    def __init__(self, fourier: FourierMap | None, weights: np.ndarray | None, knots: tuple[np.ndarray, np.ndarray]):
        self.fourier, self.weights, self.knots = fourier, weights, knots

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.zeros(len(x)) if self.fourier is None else self.fourier(x) @ self.weights

    def __call__(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        score = np.interp(raw, *self.knots)
        # within a flat stretch of the calibration, the raw score keeps the order
        return np.clip(0.999 * score + 0.001 / (1 + np.exp(-np.clip(raw, -30, 30))), 0.0, 1.0)


def fold_of(id_col: str) -> Column:
    return F.pmod(F.xxhash64(id_col, F.lit("fold")), F.lit(FOLDS)).cast("int")


def fit(labelled: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> QualityModel:
    """From rows (doc_id, x, y)."""
    n = labelled.count()
    if n > max_fit_rows:
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id", "x"), F.lit(1 << 30)) < max_fit_rows / n * (1 << 30))
    sample = cut(labelled.distinct().withColumn("fold", fold_of("doc_id")).repartition(FOLDS, "fold").sortWithinPartitions("fold", "doc_id", "y", "x"))
    each = [F.col("x")[i] for i in range(STATISTICS)]
    row = sample.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(each)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(each))).first()
    if not row["n"] or row["y"] in (0.0, 1.0):
        rate = 0.5 if not row["n"] else row["y"]
        return QualityModel(None, None, (np.zeros(1), np.full(1, rate)))
    fourier = FourierMap(np.array([row[f"m{i}"] for i in range(STATISTICS)]), np.array([row[f"s{i}"] for i in range(STATISTICS)]))
    size = FEATURES + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each fold, as its rows come together."""
        now, m, a, b = None, 0, np.zeros((size, size)), np.zeros(size)

        def row_of() -> pa.RecordBatch:
            columns = [pa.array([now], pa.int32()), pa.array([m], pa.int64()), pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["fold", "m", "a", "b"])

        for batch in batches:
            folds = batch.column(2).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(folds)) + 1).tolist(), len(folds)]
            for i, j in zip(edges, edges[1:]):
                if i == j:
                    continue
                if folds[i] != now:
                    if now is not None:
                        yield row_of()
                    now, m, a, b = int(folds[i]), 0, np.zeros((size, size)), np.zeros(size)
                part = batch.slice(i, j - i)
                z = fourier(_matrix(part.column(0)))
                a += z.T @ z
                b += z.T @ part.column(1).to_numpy().astype(float)
                m += j - i
        if now is not None:
            yield row_of()

    # coalesced, so that a session that deals rows to more partitions makes no more tasks of them
    parts = sample.select("x", "y", "fold").coalesce(FOLDS).mapInArrow(sums, "fold int, m long, a binary, b binary").collect()  # FOLDS rows at most
    own = {p["fold"]: (p["m"], np.frombuffer(p["a"]).reshape(size, size), np.frombuffer(p["b"])) for p in parts}
    whole = [sum(x) for x in zip(*own.values())]

    def solved(m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.linalg.solve(a + RIDGE * m / size * np.eye(size), b)

    model = QualityModel(fourier, solved(*whole), (np.zeros(1), np.zeros(1)))
    # for each fold the weights that the others give; a lone fold has its own
    others = np.array([solved(*(w - x for w, x in zip(whole, own[f]))) if f in own and len(own) > 1 else model.weights for f in range(FOLDS)]).T

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = fourier(_matrix(batch.column(0))) @ others
            yield pa.RecordBatch.from_arrays([pa.array(z[np.arange(len(z)), batch.column(2).to_numpy()]), batch.column(1)], ["raw", "y"])

    scored = sample.select("x", F.col("y").cast("double").alias("y"), "fold").mapInArrow(raw, "raw double, y double").toArrow()  # max_fit_rows rows at most
    model.knots = pool_adjacent_violators(scored.column("raw").to_numpy(), scored.column("y").to_numpy())
    return model


def score_documents(docs: DataFrame, labels: DataFrame, train: Column, threshold: float, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """doc_id, score, predicted. `train` is a condition on doc_id that says which labels may be learnt from."""
    known = cut(statistics_of(docs, id_col, text_col))
    y = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y")).where(train & F.col("y").isNotNull())
    model = fit(known.join(y, "doc_id"), max_fit_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_task("quality")
        for batch in batches:
            score = model(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return known.mapInArrow(run, "doc_id long, score double, predicted int")
