"""A quality classifier: ridge regression on random Fourier features of document statistics.

One pass over the texts turns each into ``len(STATISTICS)`` numbers. Cosines of random projections
of the standardised statistics approximate a Gaussian kernel; every partition of labelled rows sums its normal
equations, the sums meet row by row of the matrix, and the ridge solution is found on the driver from a
matrix of fixed size. Isotonic regression on labelled rows that the fit has not seen turns raw scores into
probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakedupes.llm.batches import (
    byte_set,
    distinct_sets,
    lists,
    lower_ascii,
    range_hashes,
    shingles,
    slices,
    text_buffer,
    words,
)
from lakedupes.llm.columns import free_names
from lakedupes.staging import stage

STATISTICS = (
    "log_bytes", "log_words", "word_length", "word_spread", "upper", "digits", "stops", "symbols", "bars",
    "beyond_ascii", "lines", "repeated_next", "distinct_words", "repeated_shingles", "sentence_ends",
    "short_words", "long_words", "symbol_words",
)
FEATURES = 256
RIDGE = 1e-3
# Labelled rows for the fit, at most; beyond, a share of them by a hash of doc_id.
SAMPLE_ROWS = 200_000
FIT_PARTITIONS = 64
SCORE_BINS = 2_000

_SPACES = byte_set(0x20, (0x09, 0x0D))
_UPPER, _DIGITS = byte_set((65, 90)), byte_set((48, 57))
_STOPS, _BARS = byte_set(*b".,;:?'"), byte_set(*b"|>-")
_SYMBOLS = byte_set(*b"!\"#$%&*+/<=>@[\\]^_`{|}~")
_LINES, _BEYOND = byte_set(10), byte_set((128, 255))


def _shares(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """The share of each text's bytes that belong to ``kind``."""
    total = np.concatenate(([0], np.cumsum(kind[data])))
    return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(1, np.diff(offsets))


def statistics_of(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` per text; a text without words, or null, has zeros but for its bytes."""
    data, offsets = text_buffer(texts)
    m = len(texts)
    lower = lower_ascii(data)
    starts, ends, owner = words(data, offsets, _SPACES)
    n = np.bincount(owner, minlength=m)
    per_word = np.maximum(1, n)
    mean = lambda x: np.bincount(owner, x, minlength=m) / per_word
    length = (ends - starts).astype(float)
    hashes = range_hashes(lower, starts, ends)
    again = np.zeros(len(starts))
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    kinds = np.bincount(distinct_sets(hashes, owner)[1], minlength=m)
    triples, of = shingles(hashes, owner, m, 3)
    all_triples = np.maximum(1, np.bincount(of, minlength=m))
    new_triples = np.bincount(distinct_sets(triples, of)[1], minlength=m)
    average = mean(length)
    letters = np.concatenate(([0], np.cumsum(~(_SYMBOLS | _STOPS)[data])))
    columns = [
        np.log1p(np.diff(offsets)), np.log1p(n), average,
        np.sqrt(np.maximum(0, mean(length * length) - average * average)),
        _shares(data, offsets, _UPPER), _shares(data, offsets, _DIGITS), _shares(data, offsets, _STOPS),
        _shares(data, offsets, _SYMBOLS), _shares(data, offsets, _BARS), _shares(data, offsets, _BEYOND),
        np.sqrt(_shares(data, offsets, _LINES)), mean(again),
        np.where(n > 0, np.log(np.maximum(1, kinds) / per_word), 0), 1 - np.where(n > 0, new_triples / all_triples, 1),
        mean((data[ends - 1] == 46).astype(float)), mean((length <= 3).astype(float)), mean((length >= 12).astype(float)),
        mean((letters[ends] == letters[starts]).astype(float)),
    ]
    return np.column_stack(columns)


def text_digest(text: Column) -> Column:
    """The MD5 of a text, 16 bytes; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, x): the statistics of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            x = statistics_of(part.column("text"))
            each = lists(x.ravel(), np.repeat(np.arange(len(x)), x.shape[1]), len(x), pa.float64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), each], ["doc_id", "digest", "x"])

    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest"), F.col("text").cast("string").alias("text")
    )
    return narrow.mapInArrow(run, "doc_id long, digest binary, x array<double>")


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null without an id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of


@dataclass
class Model:
    """What scoring needs; a few hundred kilobytes, whatever the corpus."""

    centre: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    low: np.ndarray  # least and greatest labelled value of each statistic, standardised
    high: np.ndarray
    share: float = 0.5  # of label 1 among the labelled rows
    knots: np.ndarray | None = None
    levels: np.ndarray | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, self.low, self.high)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.column_stack([waves, np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def support(self, x: np.ndarray) -> np.ndarray:
        """1 inside the labelled range, falling to 0 outside as the kernel does: there no labelled text is near."""
        z = (x - self.centre) / self.scale
        beyond = np.maximum(0, np.maximum(self.low - z, z - self.high))
        return np.exp(-(np.minimum(beyond, 1e3) ** 2).sum(axis=1) / (2 * x.shape[1]))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The calibrated chance of label 1, drawn towards the share of that label where no labelled text is near."""
        near = self.support(x)
        found = np.clip(np.interp(self.raw(x), self.knots, self.levels), 0, 1)
        return near * found + (1 - near) * self.share


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``values``: neighbours that go down are pooled."""
    level: list[float] = []
    weight: list[float] = []
    length: list[int] = []
    for v, w in zip(values, weights, strict=True):
        level.append(v), weight.append(w), length.append(1)
        while len(level) > 1 and level[-2] >= level[-1]:
            total = weight[-2] + weight[-1]
            level[-2] = (level[-2] * weight[-2] + level[-1] * weight[-1]) / total
            weight[-2] = total
            length[-2] += length[-1]
            del level[-1], weight[-1], length[-1]
    return np.repeat(level, length)


def _matrix(batch: pa.RecordBatch | pd.DataFrame) -> np.ndarray:
    return np.stack(batch["x"].to_numpy()) if len(batch) else np.zeros((0, len(STATISTICS)))


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES, ridge: float = RIDGE) -> Model | None:
    """The model from rows (doc_id, x, y); None where there is no labelled row.

    A quarter of the rows, by a hash of doc_id, is left for the calibration.
    """
    counted = labelled.agg(F.count(F.lit(1)).alias("n")).first().n
    if not counted:
        return None
    pick = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000))
    if counted > sample_rows:
        labelled = labelled.where(pick < int(1_000_000 * sample_rows / counted))
    rows, _ = stage(labelled.withColumn("later", F.pmod(F.xxhash64("doc_id", F.lit("later")), F.lit(4)) == 0).repartition(FIT_PARTITIONS))
    columns = [F.col("x")[i] for i in range(len(STATISTICS))]
    d = len(STATISTICS)
    moments = rows.agg(
        *[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns], *[F.min(c) for c in columns], *[F.max(c) for c in columns],
        F.avg("y"),
    ).first()
    centre, spread, least, most = np.array(moments[:4 * d], float).reshape(4, d)
    spread = np.maximum(spread, 1e-6)
    random = np.random.default_rng(11)
    model = Model(
        centre, spread,
        random.normal(size=(d, features)) / np.sqrt(d), random.uniform(0, 2 * np.pi, features), np.zeros(features + 1),
        (least - centre) / spread, (most - centre) / spread, float(moments[4 * d]),
    )

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((features + 1, features + 2))
        for part in parts:
            if len(part):
                z = model.features(_matrix(part))
                total += z.T @ np.column_stack([z, part["y"].to_numpy(float)])
        yield pd.DataFrame({"i": np.arange(len(total)), "row": list(total)})

    def joined(parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": parts["i"].iloc[:1], "row": [np.sum(np.stack(parts["row"].to_numpy()), axis=0)]})

    used = rows.where("NOT later") if rows.where("NOT later").limit(1).count() else rows
    equations = used.mapInPandas(sums, "i long, row array<double>").groupBy("i").applyInPandas(joined, "i long, row array<double>")
    total = np.stack(equations.orderBy("i").toPandas()["row"].to_numpy())
    gram, target = total[:, :-1], total[:, -1]
    size = gram[-1, -1]
    penalty = np.append(np.ones(features), 1e-9)  # the intercept is free
    model.weights = np.linalg.solve(gram + ridge * size * np.diag(penalty) / len(gram), target)

    def binned(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                raw = np.clip(model.raw(_matrix(part)), -0.5, 1.5)
                yield pd.DataFrame({"bin": np.floor((raw + 0.5) / 2 * SCORE_BINS).astype(int), "raw": raw, "y": part["y"].to_numpy(float)})

    held = rows.where("later") if rows.where("later").limit(1).count() else rows
    bins = held.mapInPandas(binned, "bin long, raw double, y double").groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("raw").alias("raw"), F.avg("y").alias("y")
    ).orderBy("bin").toPandas()
    levels = isotonic(bins["y"].to_numpy(), bins["n"].to_numpy(float))
    model.knots, model.levels = bins["raw"].to_numpy(), levels
    return model


def _scored(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(doc_id, digest, score) per row of ``docs``."""
    measured, _ = stage(statistics(docs))
    marks = labels.where("quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        (F.avg("quality") >= 0.5).cast("int").alias("y")
    )
    known = measured.where(remainder(F.col("doc_id"), 3) != 1).join(marks, "doc_id")
    model = fit(known, sample_rows)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                found = model.score(_matrix(part)) if model else np.full(len(part), 0.5)
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "digest": part["digest"], "score": found})

    return measured.mapInPandas(run, "doc_id long, digest binary, score double")


def scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score (chance of label 1), predicted.

    Labels are learned only where crc32 of doc_id modulo 3 is not 1. A document with several labels has their mean, rounded.
    Empty and null texts are scored like others. Without any label every score is 0.5.
    Repeated rows are scored alike; rows without doc_id are scored and not held out.
    """
    return _scored(docs, labels, sample_rows).select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier accepts.

    The score of a row is that of its text, so decisions are carried by the digest of the text and not by doc_id.
    """
    (name,) = free_names(docs.columns, "_gone")
    gone = _scored(docs, labels, SAMPLE_ROWS).where("score < 0.5").select(F.col("digest").alias(name)).distinct()
    return docs.join(gone, text_digest(docs["text"]) == gone[name], "left_anti")
