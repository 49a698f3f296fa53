"""Which documents repeat passages of a benchmark: a prefix-filtered set join, in SQL functions only.

Windows of an item (ten words, or the whole of a shorter item) are sets of positioned shingles of
three words. One pass over the texts keeps only positions whose shingle occurs in the benchmark.
Shingles are then ordered by their rarity in the documents; a window must contain its rarest one, so
that one is its prefix token and the only one that generates candidates. Length and position bounds
drop candidates that would stick out of the text; the others are verified by finding every
shingle of the window at its place.

Texts are known by their MD5, so copies are matched once. The benchmark is a stated query set: it
is broadcast in blocks of at most ``block_shingles`` shingles, one pass over the texts for each.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakedupes.llm.columns import free_names, quoted
from lakedupes.staging import stage
from lakedupes.unions import union

WINDOW = 10
SHINGLE = 3
# About 40 bytes each: what one pass broadcasts stays below 100 MB.
BLOCK_SHINGLES = 1_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What separates words, before A-Z are lower-cased.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _words(text: Column) -> Column:
    """The words with their case; no empty strings."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _BETWEEN), "")


def _key(shingle: Column) -> Column:
    """A join key that is equal wherever the lower-cased shingles are equal."""
    return F.xxhash64(F.lower(shingle))


def text_key(text: Column) -> Column:
    """A text's identity; null counts as empty."""
    return F.md5(F.coalesce(text, F.lit("")))


def _zipped(words: Column, size: int) -> Column:
    return F.arrays_zip(*[F.slice(words, k + 1, F.greatest(F.size(words), F.lit(1))).alias(f"w{k}") for k in range(size)])


def _joined(size: int) -> Column:
    return F.concat_ws(" ", *[F.col(f"g.w{k}") for k in range(size)])


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, n, words): the distinct windows of each item, lower-cased."""
    words = F.transform(_words(F.col("text")), lower_ascii)
    last = F.greatest(F.size("w") - window, F.lit(0))
    return (
        benchmark.select(F.col("item_id").cast("string").alias("item_id"), words.alias("w"))
        .where(F.size("w") > 0)
        .select("item_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("at"))
        .select("item_id", F.slice("w", F.col("at") + 1, F.lit(window)).alias("words"))
        .distinct()
        .select("item_id", F.size("words").alias("n"), "words")
    )


def _window_shingles(windows: DataFrame, size: int) -> DataFrame:
    """(window, n, offset, shingle) of distinct windows of at least ``size`` words."""
    return (
        windows.select(F.md5(F.concat_ws(" ", "words")).alias("window"), "n", "words").distinct()
        .select("window", "n", F.posexplode(_zipped(F.col("words"), size)).alias("offset", "g"))
        .where(f"g.w{size - 1} IS NOT NULL")
        .select("window", "n", "offset", _joined(size).alias("shingle"))
    )


def _positions(docs: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """One pass over the texts: a row per row of ``docs`` (first), and one per position whose shingle
    may be one of the benchmark."""
    words = docs.select("doc_id", text_key(F.col("text")).alias("tkey"), _words(F.col("text")).alias("w"))
    each = words.select(
        "doc_id", "tkey", F.size("w").cast("long").alias("n_words"),
        F.posexplode_outer(_zipped(F.col("w"), size)).alias("pos", "g"),
    ).select(
        "doc_id", "tkey", "n_words", "pos",
        F.when(F.col(f"g.w{size - 1}").isNotNull(), _joined(size)).alias("raw"),
    )
    return (
        each.withColumn("key", _key(F.col("raw")))
        .join(F.broadcast(keys), "key", "left")
        .where("known OR coalesce(pos, 0) = 0")
        .select(
            "doc_id", "tkey", "n_words", "pos", (F.coalesce("pos", F.lit(0)) == 0).alias("first"),
            F.when(F.col("known"), lower_ascii(F.col("raw"))).alias("shingle"),
        )
    )


def _verified(found: DataFrame, shingles: DataFrame, size: int) -> DataFrame:
    """(tkey, window, start, n): windows that occur in texts, by their rarest shingle."""
    rarity = found.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    # A window with a shingle that no document has cannot occur.
    ranked = shingles.join(rarity, "shingle", "left").groupBy("window", "n").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "shingle", "offset")).alias("rarest")
    ).where("rarest.df > 0")
    tokens = ranked.select("window", "n", "rarest.shingle", "rarest.offset")
    candidates = (
        found.join(F.broadcast(tokens), "shingle")
        .withColumn("start", F.col("pos") - F.col("offset"))
        .where("start >= 0 AND start + n <= n_words")
        .select("tkey", "window", "n", "start")
    )
    wanted = candidates.join(F.broadcast(shingles.drop("n")), "window").select(
        "tkey", "window", "n", "start", (F.col("start") + F.col("offset")).alias("pos"), "shingle"
    )
    return (
        wanted.join(found.select("tkey", "pos", "shingle"), ["tkey", "pos", "shingle"])
        .groupBy("tkey", "window", "start", "n").count()
        .where(F.col("count") == F.col("n") - (size - 1))
        .select("tkey", "window", "start", "n")
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_shingles: int = BLOCK_SHINGLES
) -> tuple[DataFrame, DataFrame]:
    """``rows`` (doc_id, tkey, n_words), one per row of ``docs``, and ``found`` (tkey, n_hit, items), one
    per contaminated text: words inside occurrences of windows, and the items' ids, sorted.

    A null text has no words. Items without words have no window; a null item_id is an item like
    others, without a place in ``items``. Repeated rows are repeated in ``rows`` only. Without
    items nothing is found.
    """
    docs = docs.select("doc_id", "text")
    windows, n_windows = stage(benchmark_windows(benchmark, window))
    sizes = [r[0] for r in windows.select(F.least("n", F.lit(SHINGLE))).distinct().collect()]
    rows, hits = None, []
    for size in sorted(sizes or [SHINGLE], reverse=True):
        own = windows.where(F.least("n", F.lit(SHINGLE)) == size)
        blocks = max(1, ceil(n_windows * (window - size + 1) / block_shingles))
        for block in range(blocks):
            part = own.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == block)
            shingles, _ = stage(_window_shingles(part, size))
            keys = shingles.select(_key(F.col("shingle")).alias("key"), F.lit(True).alias("known")).distinct()
            seen, _ = stage(_positions(docs, keys, size))
            if rows is None:
                rows = seen.where("first").select("doc_id", "tkey", "n_words")
            found = seen.where("shingle IS NOT NULL").select("tkey", "n_words", "pos", "shingle").distinct()
            hits.append(_verified(found, shingles, size))
    occurring, _ = stage(union(*hits))
    n_hit = (
        occurring.select("tkey", F.explode(F.expr("sequence(start, start + n - 1)")).alias("pos"))
        .distinct().groupBy("tkey").agg(F.count(F.lit(1)).alias("n_hit"))
    )
    items = windows.select("item_id", F.md5(F.concat_ws(" ", "words")).alias("window"))
    by_item = (
        occurring.select("tkey", "window").distinct().join(items, "window")
        .groupBy("tkey").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    return rows, n_hit.join(by_item, "tkey")


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, items (sorted item ids), contaminated."""
    rows, found = contamination(docs, benchmark)
    none = F.array().cast("array<string>")
    return rows.join(found, "tkey", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", none).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no window of the benchmark."""
    _, found = contamination(docs, benchmark)
    (name,) = free_names(docs.columns, "_tkey")
    taken = found.select(F.col("tkey").alias(name))
    return docs.withColumn(name, text_key(F.col("text"))).join(taken, name, "left_anti").select(*[quoted(c) for c in docs.columns])
