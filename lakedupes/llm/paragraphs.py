"""Repeated paragraphs: MinHash banding, exact Jaccard, and removal by components.

A paragraph is a line of at least ``MIN_WORDS`` words; its set holds five-word shingles. ``BANDS`` bands of
``ROWS`` MinHash values are tuned for recall: two sets of similarity 0.8 miss each other in all bands with a chance of
1.3e-5. Equal sets are one class, known by a hash of the set, so copies of a paragraph collapse before the
shuffle. Classes that collide in a band are joined to the hub of the band's bucket, checked by exact Jaccard similarity, and
what remains apart in a bucket is compared too, unless no intersection can be large enough. In each
component the first paragraph of the least document stays; the others are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakedupes.llm.batches import distinct_sets, lists, lower_ascii, mix, range_hashes, shingles, slices, text_buffer, words
from lakedupes.llm.components import components
from lakedupes.llm.minhash_forest import (
    SPACES,
    agreeing,
    apart,
    bits_for,
    compared,
    likely_among,
    packed_texts,
    reachable_sets,
    regions_of,
    row_identity,
    to_hubs,
)
from lakedupes.operators.groups import join_counted, join_groups, piece_rows
from lakedupes.staging import stage
from lakedupes.unions import union

MIN_WORDS = 20
BANDS = 11
ROWS = 2

_RANDOM = np.random.default_rng(13)
_FACTORS = _RANDOM.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _RANDOM.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)


def _paragraphs(texts: pa.Array, size: int, min_words: int) -> tuple[np.ndarray, ...]:
    """For each paragraph: text, begin and end in the text's bytes; then distinct shingles, and their paragraphs."""
    data, offsets = text_buffer(texts)
    breaks = np.flatnonzero(data == 10)
    # Lines are the texts of a finer division of the buffer.
    edges = np.unique(np.concatenate((offsets, breaks, breaks + 1)))
    lower = lower_ascii(data)
    starts, ends, owner = words(data, edges, SPACES)
    count = np.bincount(owner, minlength=len(edges) - 1)
    large = count >= max(min_words, 1)
    kept = large[owner]
    number = np.cumsum(large) - 1
    owner = number[owner[kept]]
    hashes, of = distinct_sets(*shingles(range_hashes(lower, starts[kept], ends[kept]), owner, int(large.sum()), size))
    begin, end = edges[:-1][large], edges[1:][large]
    text = np.searchsorted(offsets, begin, "right") - 1
    return text, begin - offsets[text], end - offsets[text], hashes, of


def _signed(docs: DataFrame, size: int, min_words: int) -> DataFrame:
    """(doc_id, rid, begin, end, sid, n, keys): one row per paragraph; ``rid`` is its row's identity, ``keys`` has one long per band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            text, begin, end, hashes, of = _paragraphs(part.column("text"), size, min_words)
            m = len(text)
            n = np.bincount(of, minlength=m)
            first = np.cumsum(n) - n
            sid, keys = np.zeros(m, np.int64), np.zeros((m, BANDS), np.uint64)
            if m:
                sums = np.add.reduceat(hashes, first)
                others = np.bitwise_xor.reduceat(mix(hashes ^ np.uint64(0x5555AAAA5555AAAA)), first)
                sid = mix(sums ^ mix(others)).view(np.int64)
                x = (hashes >> np.uint64(32)).astype(np.uint32)
                for j in range(BANDS * ROWS):
                    least = np.minimum.reduceat(x * _FACTORS[j] + _SHIFTS[j], first).astype(np.uint64)
                    keys[:, j // ROWS] = mix(keys[:, j // ROWS] ^ (least + np.uint64(j << 40)))
            ids, rids = (part.column(c).take(pa.array(text)) for c in ("doc_id", "rid"))
            yield pa.RecordBatch.from_arrays(
                [ids, rids, pa.array(begin), pa.array(end), pa.array(sid), pa.array(n.astype(np.int64)),
                 lists(keys.view(np.int64).ravel(), np.repeat(np.arange(m), BANDS), m, pa.int64())],
                ["doc_id", "rid", "begin", "end", "sid", "n", "keys"],
            )

    return docs.mapInArrow(run, "doc_id long, rid binary, begin long, end long, sid long, n long, keys array<long>")


def _sets_of(docs: DataFrame, places: DataFrame, size: int) -> DataFrame:
    """(sid, n, items) of the paragraphs at ``places`` (rid, begin, end, sid), read from the texts of exactly these rows again."""
    wanted = places.groupBy("rid").agg(F.collect_list(F.struct("begin", "end", "sid")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = batch.slice(at, 200)
                pieces, sids = [], []
                for packed, parts in zip(rows.column("text").to_pylist(), rows.column("parts").to_pylist(), strict=True):
                    text = zstandard.decompress(packed)
                    pieces += [text[p["begin"]:p["end"]] for p in parts]
                    sids += [p["sid"] for p in parts]
                data, offsets = text_buffer(pa.array(pieces, pa.large_binary()))
                data = lower_ascii(data)
                starts, ends, owner = words(data, offsets, SPACES)
                hashes, of = distinct_sets(*shingles(range_hashes(data, starts, ends), owner, len(pieces), size))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sids, pa.int64()), lists(hashes.view(np.int64), of, len(pieces), pa.int64())], ["sid", "items"]
                )

    return (
        # Rows of one rid are copies of each other, and each sid has one rid.
        packed_texts(docs, places).join(wanted, "rid").dropDuplicates(["rid"]).select("text", "parts")
        .mapInArrow(run, "sid long, items array<long>").withColumn("n", F.size("items"))
    )


def repeated_paragraphs(docs: DataFrame, size: int = 5, percent: int = 80, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_paragraphs, removed (array of begin, end in UTF-8 bytes), copies_of.

    ``copies_of`` has, sorted, the doc_id of the documents that keep the paragraphs removed here. Lines of fewer words than
    ``min_words`` are no paragraphs; null and empty texts have none. A paragraph repeated inside its own document is
    removed too. Rows of one doc_id count as one document: each is returned with the paragraphs of all. Rows without doc_id are returned
    without paragraphs.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = narrow.where("doc_id IS NOT NULL").withColumn("rid", row_identity(narrow))
    signed, _ = stage(_signed(known, size, min_words))
    labelled = signed.select("sid", "n", F.posexplode("keys").alias("tree", "hi"))
    met = labelled.groupBy("tree", "hi").agg(F.min("sid").alias("low"), F.max("sid").alias("high"), F.count(F.lit(1)).alias("bucket"))
    # Hot keys of one class stay, so that their rows are known; all other keys of one class are of no use.
    collide, n_collide = stage(met.where(f"low <> high OR bucket > {piece_rows(docs.sparkSession)}"))
    labelled = likely_among(labelled, collide.where("low <> high"), ["tree", "hi"], bits_for(n_collide))
    shared, _ = stage(
        join_groups(labelled, collide, ["tree", "hi"], weight="bucket", spread=["sid"], keep="low <> high").drop("low", "high", "bucket").distinct()
        .select("sid", "n", "tree", "hi", F.col("hi").alias("full"), F.lit(0).cast("long").alias("lo"))
    )
    members, n_members = stage(shared.select("sid").distinct())
    place = F.min(F.struct("rid", "begin", "end")).alias("p")
    near = likely_among(signed.select("rid", "begin", "end", "sid"), members, ["sid"], bits_for(n_members))
    places = near.join(members, "sid").groupBy("sid").agg(place).select("p.*", "sid")
    sets, _ = stage(_sets_of(known, places, size))
    able, n_able = stage(reachable_sets(sets, percent))
    # Sets that pass beside these are in no region.
    sets, _ = stage(likely_among(sets, able, ["sid"], bits_for(n_able)))
    regions, _ = stage(regions_of(shared.join(able, "sid")))
    ordered, _ = stage(to_hubs(regions).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    checked, _ = stage(compared(ordered, sets))
    links = agreeing(checked, percent)
    roots = components(links)
    left, n_left = stage(apart(regions, roots, checked, sets, percent))
    ends = union(left.select(F.col("a").alias("sid")), left.select(F.col("b").alias("sid")))
    more, n_more = stage(agreeing(compared(left, likely_among(sets, ends, ["sid"], bits_for(2 * n_left))), percent))
    if n_more:
        roots = components(union(links, more))
    roots = roots.withColumnRenamed("v", "sid")
    twice = signed.groupBy("sid").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("sid")
    again, n_again = stage(union(twice, roots.select("sid")).distinct())
    # A paragraph that is not among these is alone in its cluster, and only counted.
    told = likely_among(signed.select("doc_id", "begin", "end", "sid"), again, ["sid"], bits_for(n_again), "again")
    rows = join_counted(told.where("again").drop("again"), roots, ["sid"], ["doc_id", "begin"], "left")
    rows, _ = stage(rows.select("doc_id", "begin", "end", F.coalesce("root", "sid").alias("cluster")).distinct())
    heads = rows.groupBy("cluster").agg(F.min(F.struct("doc_id", "begin")).alias("head"), F.count(F.lit(1)).alias("m"))
    gone = join_groups(rows, heads, ["cluster"], weight="m", spread=["doc_id", "begin"], keep="m > 1").where("doc_id <> head.doc_id OR begin <> head.begin")
    by_doc = gone.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("removed"),
        F.array_sort(F.collect_set("head.doc_id")).alias("copies_of"),
    )
    count = union(rows.select("doc_id"), told.where("NOT again").select("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_paragraphs"))
    return (
        narrow.select("doc_id").join(count.join(by_doc, "doc_id", "left"), "doc_id", "left")
        .select(
            "doc_id", F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"),
            F.coalesce("removed", F.array().cast("array<struct<begin:long,end:long>>")).alias("removed"),
            F.coalesce("copies_of", F.array().cast("array<long>")).alias("copies_of"),
        )
    )
