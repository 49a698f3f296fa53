"""Spelling variants: words one edit apart, and the commoner word that each may be a slip of.

Words are compared through bit-sliced position indexes: for every (position, letter) a bitset over the words of a
block. Four bitsets run along a query word, 64 words at a time: words that agree so far, words with one letter replaced,
one missing, and one more; the last two look at positions shifted by one. What is left at the end, with the length that
the error asks for, is the set of near words.

A block holds words that can be near each other. Two words one edit apart, the shorter of m letters, agree in their
first m // 2 letters or in the others, so every word stands in the blocks of these halves; halves are packed into
blocks of about ``LETTERS`` letters, and a half with more is cut into tiles. Each near pair is reported by one block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakedupes.operators.groups import join_groups
from lakedupes.staging import stage

# Letters of the words of one block; a longer word is a block of its own.
LETTERS = 1 << 15
# Lengths from here on share their blocks.
LONG = 64
# Bytes of one bitset matrix (queries x words of 64 bits).
_MATRIX_BYTES = 1 << 18


def spoiled(doc_id: Column, run: Column, every: int = 97) -> Column:
    """``run`` without one letter where ``every`` divides the crc32 h of ``doc_id:run``: the letter h modulo its length."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % every == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame, least_letters: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n) of the words of all texts, counted after one letter of some is lost (``spoiled``)."""
    lower = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(lower, F.lit("[a-zÀ-ÿ]+"), F.lit(0))).alias("run"))
    return (
        runs.select(spoiled(F.col("doc_id"), F.col("run")).alias("word"))
        .where(F.char_length("word") >= least_letters)
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)
    )


class Index:
    """Bitsets over a block of words, one per (position, letter) that occurs and one per length."""

    def __init__(self, words: list[bytes]):
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.first = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(words), np.uint8)
        self.width = -(-len(words) // 64)
        word = np.repeat(np.arange(len(words)), self.lengths)
        place = np.arange(len(self.letters)) - self.first[word]
        self.codes, row = np.unique(place << 8 | self.letters, return_inverse=True)
        self.rows = self._bits(row, word, len(self.codes) + 1)  # the last one is empty
        self.sizes, row = np.unique(self.lengths, return_inverse=True)
        self.of_length = self._bits(row, np.arange(len(words)), len(self.sizes) + 1)

    def _bits(self, row: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
        flat = np.zeros((n, self.width), np.uint64)
        np.bitwise_or.at(flat, (row, word >> 6), np.uint64(1) << (word & 63).astype(np.uint64))
        return flat

    def _at(self, place: int, letters: np.ndarray) -> np.ndarray:
        """For each letter the words that have it at ``place``."""
        code = place << 8 | letters.astype(np.int64)
        row = np.searchsorted(self.codes, code)
        row[(row == len(self.codes)) | (self.codes[np.minimum(row, len(self.codes) - 1)] != code)] = len(self.codes)
        return self.rows[row]

    def _long(self, length: int) -> np.ndarray:
        at = int(np.searchsorted(self.sizes, length))
        return self.of_length[at if at < len(self.sizes) and self.sizes[at] == length else -1]

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """(word, other): all ordered pairs of the block with exactly one edit between them."""
        left, right = [], []
        per_batch = max(1, _MATRIX_BYTES // (8 * self.width))
        for length in self.sizes.tolist():
            every = np.flatnonzero(self.lengths == length)
            for at in range(0, len(every), per_batch):
                words = every[at:at + per_batch]
                bits = self._near_of(words, length)
                found = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")
                query, other = np.nonzero(found)
                left.append(words[query])
                right.append(other)
        return np.concatenate(left), np.concatenate(right)

    def _near_of(self, words: np.ndarray, length: int) -> np.ndarray:
        """The bitsets of the words near each of ``words``, all of one length."""
        letters = self.letters[self.first[words][:, None] + np.arange(length)]
        exact = np.full((len(words), self.width), ~np.uint64(0))
        replaced, missing, more = np.zeros((3, len(words), self.width), np.uint64)
        for place in range(length):
            here = self._at(place, letters[:, place])
            more = (more | exact) & self._at(place + 1, letters[:, place])
            missing &= self._at(place - 1, letters[:, place]) if place else np.uint64(0)
            missing |= exact
            replaced = (replaced & here) | (exact & ~here)
            exact &= here
        return (
            replaced & self._long(length) | missing & self._long(length - 1) | (more | exact) & self._long(length + 1)
        )


def _halves(vocab: DataFrame) -> DataFrame:
    """(word, n, m, side, half): the halves by which a word of L letters meets its near words, for m = L and m = L - 1."""
    size = F.char_length("word")
    each = vocab.select("word", "n", F.explode(F.array(size, size - 1)).alias("m"))
    front = F.struct(F.lit("front").alias("side"), F.expr("substring(word, 1, m div 2)").alias("half"))
    back = F.struct(F.lit("back").alias("side"), F.expr("substring(word, char_length(word) - (m - m div 2) + 1, m)").alias("half"))
    return each.select("word", "n", "m", F.explode(F.array(front, back)).alias("h")).select("word", "n", "m", "h.side", "h.half")


def blocks(vocab: DataFrame) -> DataFrame:
    """(word, n, m, side, half, chunk, block, one, two): every word in the blocks where it may meet a near one.

    A half with more than ``LETTERS`` letters has blocks of its own, one per pair of chunks (one <= two).
    """
    keys = ["side", "m", "half"]
    rows, _ = stage(_halves(vocab))
    counts, _ = stage(
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.char_length("word")).alias("letters"))
        .where("rows > 1").withColumn("class", F.least("m", F.lit(LONG)))
    )
    # At most 2 * LONG rows: how many blocks the halves of a side and length are packed into.
    packs = counts.where(f"letters <= {LETTERS}").groupBy("side", "class").agg(
        F.ceil(F.sum("letters") / LETTERS).alias("packs")
    )
    facts = counts.join(F.broadcast(packs), ["side", "class"], "left").select(
        *keys, "rows", F.ceil(F.col("letters") / LETTERS).alias("chunks"),
        F.when(
            F.col("letters") <= LETTERS,
            F.concat_ws(":", "side", "class", F.pmod(F.xxhash64(*keys), F.col("packs"))),
        ).otherwise(F.concat_ws(":", "side", "m", F.lit("half"), "half")).alias("block"),
    )
    met = join_groups(rows, facts, keys, weight="rows", spread=["word"])
    cut = met.withColumn("chunk", F.pmod(F.xxhash64("word"), F.col("chunks")))
    return cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select(
        "word", "n", "m", "side", "half", "chunk", "block", F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two")
    )


def _near_in_block(rows: pa.Table) -> pa.Table:
    """(word, n, other, other_n): the ordered near pairs that this block reports.

    That is the pairs that share the half for which they are here, in a back half only where their front
    halves differ, and of one chunk only where the block is that chunk's own.
    """
    texts = rows.column("word").to_pylist()
    index = Index([t.encode("latin-1") for t in texts])
    left, right = index.near()
    m, chunk = rows.column("m").to_numpy(), rows.column("chunk").to_numpy()
    half = np.unique(rows.column("half").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)[1]
    right_m = m[left]
    told = (right_m == m[right]) & (half[left] == half[right]) & (np.minimum(index.lengths[left], index.lengths[right]) == right_m)
    if rows.column("side")[0].as_py() == "back":
        front = {t: k for k, t in enumerate({t[:k // 2] for t, k in zip(texts, m.tolist(), strict=True)})}
        fronts = np.array([front[t[:k // 2]] for t, k in zip(texts, m.tolist(), strict=True)])
        told &= fronts[left] != fronts[right]
    if rows.column("one")[0].as_py() != rows.column("two")[0].as_py():
        told &= chunk[left] != chunk[right]
    left, right = pa.array(left[told]), pa.array(right[told])
    word, n = rows.column("word"), rows.column("n")
    return pa.table({"word": word.take(left), "n": n.take(left), "other": word.take(right), "other_n": n.take(right)})


def near_words(vocab: DataFrame) -> DataFrame:
    """(word, n, other, other_n): every ordered pair of words of ``vocab`` (word, n) exactly one edit apart.

    An edit is one inserted, deleted or replaced letter. Words are distinct, without null, of letters below U+0100.
    """
    return blocks(vocab).groupBy("block", "one", "two").applyInArrow(
        _near_in_block, "word string, n long, other string, other_n long"
    )


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word on the way from ``word`` along ``forms`` (word, form); ways do not circle.

    Every round joins each way with the way of its end, so that ways double; the last round finds nothing to add.
    """
    ways, n = stage(forms.select("word", F.col("form").alias("root")))
    while n:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ways, _ = stage(ways.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        n = ways.where("moved").limit(1).count()
        ways = ways.select("word", "root")
    return ways


def variants(docs: DataFrame, ratio: int = 2) -> DataFrame:
    """Per word of ``docs`` (doc_id, text): word, n, n_near, form, form_n, root.

    ``form`` is the near word of largest n, the smallest by code points of several, where that n is at least ``ratio``
    times the word's; else null. ``root`` is where following forms ends, the word itself without one. Null and empty texts
    have no words, repeated rows count again, a null doc_id counts as an empty one. Other columns are ignored.
    """
    vocab, _ = stage(vocabulary(docs))
    best = near_words(vocab).groupBy("word").agg(
        F.first("n").alias("n"), F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best")
    )
    taken = -F.col("best.minus") >= F.col("n") * ratio
    near, _ = stage(best.select(
        "word", "n_near", F.when(taken, F.col("best.other")).alias("form"), F.when(taken, -F.col("best.minus")).alias("form_n")
    ))
    roots = _roots(near.where("form IS NOT NULL"))
    return vocab.join(near, "word", "left").join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )
