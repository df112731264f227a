"""Quality classifier: random Fourier features, ridge regression by summed normal equations, isotonic calibration.

Each document becomes statistics of its whole text (lengths, kinds of characters, repetition). Standardised, they pass through
`dimensions` random Fourier features, whose inner products approximate a Gaussian kernel; its width is the median distance of
`width_sample` labelled documents, chosen by hash. Every partition sums its part of the normal equations of the labelled documents, the driver adds the
sums (their size doesn't depend on the data) and solves for ridge scores. Every fourth labelled document, by hash, is held out of the fit;
isotonic regression on held-out scores turns scores into probabilities of good quality. All labels are used.

Defined results: null and empty texts have the statistics of an empty text and are scored; rows without doc_id are ignored, as are
labels without a document or with a quality other than 0 and 1; a document labelled several times counts as often; equal scores get
equal probabilities. Without labels of both kinds every probability is null and every document kept. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm._text import NON_WORD, SPACES, U64, Words, raw, slices
from codequarry.session import ship, write_shared

DIMENSIONS, RIDGE, BINS, KEEP_FROM, SEED, WIDTH_SAMPLE = 192, 1e-3, 1024, 0.5, 11, 500
STATISTICS = ("log_bytes", "log_words", "word_length", "long_words", "distinct_words", "distinct_bigrams", "log_lines", "line_repeats", "words_a_line", "upper", "digit", "space", "stop", "comma", "symbol", "other_mark", "beyond_ascii", "top_word")

_CLASS = np.zeros(256, np.int64)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[SPACES] = 3
_CLASS[ord(".")] = 4
_CLASS[ord(",")] = 5
_CLASS[[ord(c) for c in "#$%&*@^~|<>={}[]\\_"]] = 6
_CLASS[[ord(c) for c in "!?;:'\"()-/+`"]] = 7
_CLASS[128:] = 8


def _distinct(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different values each row has, and how often its most frequent one comes."""
    key = np.sort((row.astype(U64) << U64(48)) | (value >> U64(16)))
    if not len(key):
        return np.zeros(rows), np.zeros(rows)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    owner = (key[first] >> U64(48)).astype(np.int64)
    top = np.zeros(rows)
    np.maximum.at(top, owner, np.diff(np.append(first, len(key))))
    return np.bincount(owner, minlength=rows).astype(float), top


_LINES = np.zeros(256, bool)
_LINES[10] = True


def statistics(column: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text."""
    words = Words(column, NON_WORD, lower=True)
    lines = Words(column, _LINES)
    data, offsets = raw(column)
    rows, size = words.rows, np.diff(offsets)
    kinds = np.bincount(np.repeat(np.arange(rows), size) * 9 + _CLASS[data], minlength=rows * 9).reshape(rows, 9)
    n, some = np.maximum(size, 1), np.maximum(words.count, 1)
    length = np.bincount(words.doc, words.end - words.start, rows)
    distinct, top = _distinct(words.doc, words.hash, rows)
    grams, ok = words.grams(2)
    bigrams, _ = _distinct(words.doc[ok], grams[ok], rows)
    different, _ = _distinct(lines.doc, lines.hash, rows)
    return np.column_stack([
        np.log1p(size), np.log1p(words.count), length / some, np.bincount(words.doc, words.end - words.start > 20, rows) / some, distinct / np.sqrt(some), bigrams / np.maximum(words.count - 1, 1),
        np.log1p(lines.count), 1 - different / np.maximum(lines.count, 1), np.log1p(words.count / np.maximum(lines.count, 1)), *(kinds[:, k] / n for k in range(1, 9)), top / some,
    ])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            x = statistics(part.column("text")).astype(np.float32)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(STATISTICS)).cast(pa.list_(pa.float32()))], ["doc_id", "x"])


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS)).astype(np.float64)


class Features:
    """Standardising and random Fourier features, from the moments of the labelled documents."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, width: float, dimensions: int):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.w = rng.normal(size=(len(mean), dimensions)) / width
        self.b = rng.uniform(0, 2 * np.pi, dimensions)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.ones(len(x)), np.sqrt(2 / self.w.shape[1]) * np.cos(z @ self.w + self.b)])


def sums(features: Features) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A partition's part of the normal equations, as one row."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                z, y = features(matrix(part.column("x"))), part.column("quality").to_numpy().astype(float)
                total = total + np.vstack([z.T @ z, y @ z])
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["sums"])

    return add


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = 0
    for batch in batches:
        for one in batch.column("sums"):
            total = total + np.frombuffer(one.as_buffer())
    if not isinstance(total, int):
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["sums"])


def isotonic(n: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing rates nearest to good / n, by bin; empty bins take their neighbour's."""
    blocks: list[list[float]] = []
    for i in np.flatnonzero(n):
        blocks.append([good[i], n[i], 1, i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g, m, k, _ = blocks.pop()
            blocks[-1][0] += g
            blocks[-1][1] += m
            blocks[-1][2] += k
    rates = np.full(len(n), np.nan)
    for g, m, _, first in blocks:
        rates[int(first)] = g / m
    last = blocks[0][0] / blocks[0][1] if blocks else np.nan
    for i in range(len(rates)):
        last = last if np.isnan(rates[i]) else rates[i]
        rates[i] = last
    return rates


def bins(score: np.ndarray) -> np.ndarray:
    """Scores in [-0.5, 1.5] by BINS steps."""
    return np.clip(((score + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)


def classify(documents: DataFrame, labels: DataFrame, dimensions: int = DIMENSIONS, ridge: float = RIDGE, keep_from: float = KEEP_FROM, width_sample: int = WIDTH_SAMPLE) -> DataFrame:
    """(doc_id, score, probability, keep) of every document."""
    spark = documents.sparkSession
    ship(spark)
    measured = write_shared(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null").mapInArrow(_measure, "doc_id long, x array<float>"), "statistics")
    given = labels.filter("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = write_shared(measured.join(given, "doc_id").withColumn("held_out", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(4)) == 0), "labelled")
    fitted = known.filter("not held_out")
    kinds = fitted.agg(F.count_distinct("quality")).first()[0]
    if kinds < 2:
        return measured.select("doc_id", F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("probability"), F.lit(True).alias("keep"))
    moments = fitted.agg(*(f(F.col("x")[i].cast("double")).alias(f"{name}{i}") for i in range(len(STATISTICS)) for name, f in (("m", F.mean), ("s", F.stddev_pop)))).first()
    mean, deviation = (np.array([moments[f"{k}{i}"] for i in range(len(STATISTICS))]) for k in "ms")
    some = np.array([r["x"] for r in fitted.orderBy(F.xxhash64("doc_id", F.lit("width")), "doc_id").limit(width_sample).select("x").collect()])
    z = np.clip((some - mean) / np.where(deviation > 1e-9, deviation, 1.0), -8, 8)
    distance = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))[np.triu_indices(len(z), 1)] if len(z) > 1 else np.ones(1)
    features = Features(mean, deviation, float(np.median(distance)) or 1.0, dimensions)
    parts = fitted.select("x", "quality").mapInArrow(sums(features), "sums binary").repartition(8).mapInArrow(add_up, "sums binary").collect()
    total = sum(np.frombuffer(r["sums"]) for r in parts).reshape(dimensions + 2, dimensions + 1)
    beta = np.linalg.solve(total[:-1] + ridge * total[0, 0] * np.diag([0.0] + [1.0] * dimensions) / dimensions, total[-1])

    def score(batches: Iterator[pa.RecordBatch], rates: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                value = features(matrix(part.column("x"))) @ beta
                if rates is None:
                    yield pa.RecordBatch.from_arrays([pa.array(bins(value)), part.column("quality")], ["bin", "quality"])
                else:
                    chance = rates[bins(value)]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(value), pa.array(chance), pa.array(chance >= keep_from)], ["doc_id", "score", "probability", "keep"])

    held = known.filter("held_out").select("x", "quality").mapInArrow(score, "bin long, quality int").groupBy("bin").agg(F.count("*").alias("n"), F.sum("quality").alias("good")).collect()
    n, good = np.zeros(BINS), np.zeros(BINS)
    for r in held:
        n[r["bin"]], good[r["bin"]] = r["n"], r["good"]
    rates = isotonic(n, good) if len(held) else np.clip((np.arange(BINS) + 0.5) / BINS * 2 - 0.5, 0, 1)
    return measured.mapInArrow(lambda batches: score(batches, rates), "doc_id long, score double, probability double, keep boolean")
