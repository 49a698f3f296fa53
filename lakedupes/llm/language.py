"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to three bytes long, counted on a bounded sample of labelled
texts. A byte costs its code length in the longest known context; where the context has not seen it,
the context's escape (method C) is paid and the next shorter context asked, down to eight bits for any byte. The
statistics are frozen, so the cost of a byte is a function of itself and the three before: the trees become
sorted tables of the byte strings seen, and a text's exact code length in each language is a sum of table entries.

Texts are lower-cased; all 256 bytes are told apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakedupes.llm.batches import slices, text_buffer
from lakedupes.llm.quality import remainder

ORDER = 3
UNIFORM = 8.0
UNKNOWN = "und"
# Bytes of labelled text that the statistics are counted on: per language, and in all languages together. Distinct
# texts are taken by least hash, and at least one of each language.
SAMPLE_BYTES = 4_000_000
TOTAL_BYTES = 64_000_000


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the three before it as one number, and the offsets of the texts; three spaces stand before a text."""
    data, offsets = text_buffer(texts)
    m = len(offsets) - 1
    padded = np.full(len(data) + ORDER * m, 32, np.uint32)
    place = np.arange(len(data)) + np.repeat(np.arange(1, m + 1) * ORDER, np.diff(offsets))
    padded[place] = data
    gram = padded.copy()
    for k in range(1, ORDER + 1):
        gram[k:] |= padded[:-k] << np.uint32(8 * k)
    return gram[place], offsets


def _last(gram: np.ndarray, n: int) -> np.ndarray:
    """The last ``n`` bytes of each number."""
    return gram & np.uint32(256**n - 1)


def _find(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each value in a sorted table, and whether it is there."""
    at = np.minimum(np.searchsorted(table, values), max(len(table) - 1, 0))
    return at, table[at] == values


@dataclass
class Level:
    """Contexts of one length: what follows them and what leaving them costs, one column per language."""

    known: np.ndarray  # context and byte as one number, sorted
    cost: np.ndarray
    contexts: np.ndarray  # sorted
    escape: np.ndarray


@dataclass
class Trees:
    """Code lengths in bits, by length of context."""

    languages: list[str]
    levels: list[Level]

    def costs(self, gram: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Of each number of ``order`` + 1 bytes, the cost of its last byte."""
        if order < 0:
            return np.full((len(gram), len(self.languages)), UNIFORM, np.float32)
        level = self.levels[order]
        at, there = _find(level.known, gram)
        out = level.cost[at]
        new = np.flatnonzero(~there)
        if len(new):
            at, there = _find(level.contexts, gram[new] >> np.uint32(8))
            shorter, back = np.unique(_last(gram[new], order), return_inverse=True)
            out[new] = np.where(there[:, None], level.escape[at], 0) + self.costs(shorter, order - 1)[back]
        return out

    def bits(self, texts: pa.Array) -> np.ndarray:
        """The code length of every text in every language."""
        gram, offsets = _grams(texts)
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        if not len(gram):
            return out
        distinct, back = np.unique(gram, return_inverse=True)
        cost = self.costs(distinct)[back]
        full = np.flatnonzero(np.diff(offsets))
        out[full] = np.add.reduceat(cost, offsets[:-1][full], axis=0, dtype=np.float64)
        return out


def grow(counted: pd.DataFrame) -> Trees:
    """The trees from rows (lang, gram, n)."""
    languages = sorted(counted["lang"].unique())
    column = counted["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
    gram, n, size = counted["gram"].to_numpy().astype(np.uint32), counted["n"].to_numpy(float), len(languages)
    levels: list[Level] = []
    for order in range(ORDER + 1):
        known, row = np.unique(_last(gram, order + 1), return_inverse=True)
        counts = np.zeros((len(known), size))
        np.add.at(counts, (row, column), n)
        contexts, of = np.unique(known >> np.uint32(8), return_inverse=True)
        total, kinds = np.zeros((len(contexts), size)), np.zeros((len(contexts), size))
        np.add.at(total, of, counts)
        np.add.at(kinds, of, counts > 0)
        whole = np.maximum(1, total + kinds)
        escape = np.where(total > 0, -np.log2(np.maximum(kinds, 1) / whole), 0.0)
        # Whatever was seen after a context was seen after the shorter one too.
        below = levels[-1].cost[_find(levels[-1].known, _last(known, order))[0]] if levels else UNIFORM
        cost = np.where(counts > 0, -np.log2(np.maximum(counts, 1) / whole[of]), escape[of] + below)
        levels.append(Level(known, cost.astype(np.float32), contexts, escape.astype(np.float32)))
    return Trees(languages, levels)


def sampled(labelled: DataFrame, sample_bytes: int = SAMPLE_BYTES, total_bytes: int = TOTAL_BYTES) -> DataFrame:
    """(lang, text): distinct texts of each language, those of least hash up to about its bytes, and at least one.

    Copies of a text are drawn together and count once. One map of a number per language is all that the driver sees.
    """
    rows = labelled.where(F.octet_length("text") > 0)
    spot = F.xxhash64("text", F.lit("ppm")).cast("double") / 2.0**64 + 0.5
    found = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"), F.min(spot).alias("least")).collect()
    if not found:
        return rows.select("lang", "text")
    each = min(sample_bytes, total_bytes / len(found))
    cut = F.create_map(*[F.lit(v) for r in found for v in (r.lang, float(max(each / r.bytes, r.least)))])
    return rows.where(spot <= cut[F.col("lang")]).select("lang", "text").distinct()


def train(labelled: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> Trees | None:
    """Trees from rows (lang, text); None without any. What reaches the driver is bounded by the sample."""

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            gram, offsets = _grams(part.column("text"))
            langs, of = np.unique(np.array(part.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            both, n = np.unique(np.repeat(of, np.diff(offsets)).astype(np.int64) << 32 | gram, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs[both >> 32].tolist(), pa.string()), pa.array(both & (2**32 - 1)), pa.array(n)], ["lang", "gram", "n"]
            )

    counted = sampled(labelled, sample_bytes).mapInArrow(count_grams, "lang string, gram long, n long")
    table = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return grow(table) if len(table) else None


def identify(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score.

    Learns from rows with a lang whose crc32 of doc_id modulo 4 is not 2. ``score`` is the share of the predicted
    language when each language weighs two to the power of minus its code length. A text that is null or
    has no letter, or any text when nothing was learned, is ``und`` with score 0. Equal code lengths go to the first
    language by name. Repeated rows are treated alike; rows without doc_id are neither held out nor learned from.
    """
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
    )
    trees = train(narrow.where((remainder(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull()), sample_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            bits = trees.bits(part.column("text"))
            best = bits.argmin(axis=1)
            score = 1 / np.exp2(-(bits - bits.min(axis=1, keepdims=True))).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("lettered"), pa.array([trees.languages[i] for i in best], pa.string()), pa.array(score)],
                ["doc_id", "lettered", "lang_pred", "score"],
            )

    texts = narrow.select("doc_id", F.col("text").rlike(r"\p{L}").alias("lettered"), "text")
    if trees:
        found = texts.mapInArrow(run, "doc_id long, lettered boolean, lang_pred string, score double")
    else:
        found = texts.select("doc_id", F.lit(False).alias("lettered"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return found.select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        F.when(F.col("lettered"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("lettered"), F.col("score")).otherwise(0.0).alias("score"),
    )
