"""Near-duplicate documents by an LSH forest: sorted MinHash labels, checked on full sets.

Every distinct shingle set has ``TREES`` labels of eight MinHash values of 16 bits: two longs, so that
sorting a tree by label puts sets with the longest common prefixes side by side. A region is a run of labels of
one tree with the same first values, as many as keep the chance that two sets of the threshold's
similarity share no region near 1e-5 (four for 0.85, three for 0.8).

Sets that can have no link are taken out first, exactly: a shingle that occurs in one set only of those in
regions is in no intersection, and a set with too many of them is out of reach of the threshold.
Candidates of the others are the hub of each region, the set that shares most regions with others, which is
the text from which near copies were made, or is nearest to it; then, in every tree, the neighbours in label order (longest
common prefix, so dense regions are compared at greater depth) as far as hubs have left them apart. What is then
still apart but shares a region is compared as far as it may agree, so no link between different
components is lost. Links inside a component that is already known need no check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakedupes.llm.batches import (
    byte_set,
    distinct_sets,
    lists,
    lower_ascii,
    mix,
    range_hashes,
    shingles,
    slices,
    text_buffer,
    words,
)
from lakedupes.llm.columns import free_names, quoted
from lakedupes.llm.components import components
from lakedupes.operators.groups import join_counted, join_groups, shuffle_partitions
from lakedupes.staging import stage
from lakedupes.unions import union

TREES = 16
DEPTH = 8
# Cells of the table of shingle frequencies, two long numbers each: four megabytes, whatever the corpus.
FREQUENCY_CELLS = 1 << 18
# Bits that mark the rows whose full texts are read again, four megabytes at most, in pages of PAGE_BITS.
MEMBER_BITS = 1 << 25
PAGE_BITS = 1 << 15
SPACES = byte_set(0x20, (0x09, 0x0D))

_RANDOM = np.random.default_rng(7)
_FACTORS = _RANDOM.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _RANDOM.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles (hashes) of each text, and the texts' numbers, sorted by both."""
    data, offsets = text_buffer(texts)
    data = lower_ascii(data)
    starts, ends, owner = words(data, offsets, SPACES)
    return distinct_sets(*shingles(range_hashes(data, starts, ends), owner, len(texts), size))


def _labels(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two longs per tree for each set: eight MinHash values of 16 bits."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    values = np.empty((len(first), TREES * DEPTH), np.uint64)
    for j in range(TREES * DEPTH):
        values[:, j] = np.minimum.reduceat(x * _FACTORS[j] + _SHIFTS[j], first)
    values = mix(values + np.arange(TREES * DEPTH, dtype=np.uint64) * np.uint64(2**33)) >> np.uint64(48)
    packed = values.reshape(len(first), TREES * 2, 4)
    longs = (packed[..., 0] << np.uint64(48)) | (packed[..., 1] << np.uint64(32)) | (packed[..., 2] << np.uint64(16)) | packed[..., 3]
    return longs.astype(np.int64)


def row_identity(docs: DataFrame) -> Column:
    """16 bytes that rows share only where doc_id and text are equal; a null text counts as empty."""
    doc_id, text = docs["doc_id"].cast("long").cast("string"), F.coalesce(docs["text"].cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id, F.lit("")), F.lit(":"), text).cast("binary")))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, rid, n, set_a, set_b, labels): row identity, set size, a 128-bit identity of the set, and 2 * TREES longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            m = part.num_rows
            hashes, owners = shingle_sets(part.column("text"), size)
            count = np.bincount(owners, minlength=m)
            full = np.flatnonzero(count)
            sums = np.zeros((2, m), np.int64)
            labels = np.zeros((m, TREES * 2), np.int64)
            if len(full):
                first = (np.cumsum(count) - count)[full]
                sums[0, full] = np.add.reduceat(hashes, first).view(np.int64)
                sums[1, full] = np.bitwise_xor.reduceat(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first).view(np.int64)
                labels[full] = _labels(hashes, first)
            each = pa.FixedSizeListArray.from_arrays(pa.array(labels.ravel()), TREES * 2).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("rid"), pa.array(count.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), each],
                ["doc_id", "rid", "n", "set_a", "set_b", "labels"],
            )

    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), row_identity(docs).alias("rid"), F.col("text").cast("string").alias("text")
    )
    return narrow.mapInArrow(run, "doc_id long, rid binary, n long, set_a long, set_b long, labels array<long>")


def likely_among(rows: DataFrame, members: DataFrame, keys: list[str], bits: int, name: str = "") -> DataFrame:
    """The rows whose ``keys`` may be among those of ``members``, or, with a ``name``, all rows with that as a boolean column.

    A bitmap of ``bits`` bits, by a hash of the keys, is all that is sent to the rows. No member is missed; how many
    others pass depends on how full it is.
    """
    bit = F.pmod(F.xxhash64(*keys), F.lit(bits))
    placed = [(bit / F.lit(PAGE_BITS)).cast("int").alias("_page"), (bit % PAGE_BITS).alias("_bit")]
    pages = members.select(*placed).groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    found = rows.select("*", *placed).join(F.broadcast(pages), "_page", "left" if name else "inner")
    byte = "cast(conv(hex(substring(_bits, cast(_bit div 8 AS int) + 1, 1)), 16, 10) AS int)"
    marked = F.expr(f"shiftright({byte}, cast(_bit % 8 AS int)) % 2 = 1")
    if name:
        return found.select(*rows.columns, F.coalesce(marked, F.lit(False)).alias(name))
    return found.where(marked).select(*rows.columns)


def bits_for(members: int) -> int:
    """Bits of a bitmap of so many members: eight to sixteen for each, sixteen megabytes at most."""
    return min(1 << 27, max(PAGE_BITS, 1 << (8 * members).bit_length()))


def packed_texts(texts: DataFrame, members: DataFrame) -> DataFrame:
    """(rid, text): the rows of ``texts`` (rid, text) that may be among ``members`` (rid), their texts compressed for the shuffle.

    Other rows pass as ``likely_among`` a bitmap of ``MEMBER_BITS`` bits, so a join on rid must follow.
    """
    wanted = likely_among(texts.select("rid", "text"), members, ["rid"], MEMBER_BITS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            packed = [zstandard.compress(t or b"", 3) for t in part.column("text").cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("rid"), pa.array(packed, pa.binary())], ["rid", "text"])

    return wanted.mapInArrow(pack, "rid binary, text binary")


def _sets_of(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """(sid, n, items): the full sets of ``members`` (sid, rid), read from the texts again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = batch.slice(at, 200)
                texts = pa.array([zstandard.decompress(t) for t in rows.column("text").to_pylist()], pa.large_binary())
                hashes, owners = shingle_sets(texts, size)
                items = lists(hashes.view(np.int64), owners, rows.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column("sid"), items], ["sid", "items"])

    texts = docs.select(row_identity(docs).alias("rid"), F.col("text").cast("string").alias("text"))
    # Rows of one rid are copies of each other, and each class has one rid.
    wanted = packed_texts(texts, members).join(members.select("sid", "rid"), "rid").dropDuplicates(["rid"]).select("sid", "text")
    return wanted.mapInArrow(run, "sid long, items array<long>").withColumn("n", F.size("items"))


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The staged pairs (a, b) with the sizes of their sets, n and m, and of the intersection, both."""
    left = sets.select(F.col("sid").alias("a"), "n", F.col("items").alias("x"))
    right = sets.select(F.col("sid").alias("b"), F.col("n").alias("m"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y")).alias("both")
    half = join_counted(pairs, left, ["a"], ["b"])
    # The first join keeps all pairs, so they are counted before it; a hub of many pairs is split on either side.
    hot = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("pairs"))
    weighed = right.join(hot, "b")
    return join_groups(half, weighed, ["b"], weight="pairs", spread=["a"]).select("a", "b", "n", "m", both)


def agreeing(compared_pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) where ``100 * intersection >= percent * union``."""
    return compared_pairs.where(f"both * 100 >= (n + m - both) * {percent}").select("a", "b")


def reachable_sets(sets: DataFrame, percent: int) -> DataFrame:
    """(sid, rest): the sets of which enough shingles, ``rest``, occur in other sets too."""
    alone = (
        sets.select("sid", F.explode("items").alias("h"))
        .groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min("sid").alias("sid"))
        .where("df = 1").groupBy("sid").agg(F.count(F.lit(1)).alias("alone"))
    )
    return (
        sets.select("sid", "n").join(alone, "sid", "left")
        .select("sid", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("rest"))
        .where(F.col("rest") * 100 >= F.col("n") * percent)
        .select("sid", "rest")
    )


def regions_of(labelled: DataFrame) -> DataFrame:
    """(sid, n, tree, hi, full, lo, region): rows whose region holds more than one set."""
    shared = labelled.groupBy("tree", "hi").agg(F.count(F.lit(1)).alias("region")).where("region > 1")
    return join_groups(labelled, shared, ["tree", "hi"], weight="region", spread=["sid"])


def _neighbours(regions: DataFrame) -> DataFrame:
    """(a, b): sets side by side in the label order of a tree, within a region.

    The order is cut into ranges; the last set of a range is also a neighbour of the first of the next.
    """
    spark = regions.sparkSession
    order = ["tree", "hi", "full", "lo", "sid"]
    cut, _ = stage(
        regions.select(*order).repartitionByRange(shuffle_partitions(spark), *order)
        .withColumn("part", F.spark_partition_id())
    )
    inside = Window.partitionBy("part", "tree", "hi").orderBy("full", "lo", "sid")
    pairs = cut.withColumn("b", F.lag("sid").over(inside)).where("b IS NOT NULL").select(F.col("sid").alias("a"), "b")
    edge = F.struct(*order)
    ends = cut.groupBy("part").agg(F.min(edge).alias("low"), F.max(edge).alias("high"))
    across = Window.partitionBy(F.lit(0)).orderBy("part")  # one row per partition
    stitched = (
        ends.withColumn("before", F.lag("high").over(across))
        .where("before.tree = low.tree AND before.hi = low.hi")
        .select(F.col("low.sid").alias("a"), F.col("before.sid").alias("b"))
    )
    return union(pairs, stitched)


def to_hubs(regions: DataFrame) -> DataFrame:
    """(a, b): every set and the hub of each of its regions."""
    central = regions.groupBy("sid").agg(F.sum("region").alias("central"))
    placed = regions.select("sid", "tree", "hi").join(central, "sid")
    hub = placed.groupBy("tree", "hi").agg(
        F.max(F.struct("central", (-F.col("sid")).alias("minus"))).alias("hub"), F.count(F.lit(1)).alias("region")
    )
    return join_groups(
        regions.select("sid", "tree", "hi"), hub.select("tree", "hi", "region", (-F.col("hub.minus")).alias("b")), ["tree", "hi"],
        weight="region", spread=["sid"],
    ).where("sid <> b").select(F.col("sid").alias("a"), "b")


def apart(regions: DataFrame, roots: DataFrame, checked: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): sets of different components that may agree, with all such pairs of a region among them.

    No intersection exceeds ``rest`` of either set: a set that cannot agree with one of the least size in its region
    agrees with none there, and regions that then hold one component are done. For the others,
    let h be the set with which x has been found to share most, ``near`` shingles. A partner of x that shares
    nothing with x outside h shares ``near`` at most. If that is too little, the partner must hold some of the
    shingles that x has beyond h, and is found by those (``_by_item``); only pairs for which neither side asks that are
    compared region by region.
    """
    def mixed(rows: DataFrame) -> DataFrame:
        facts = rows.groupBy("tree", "hi").agg(
            F.min("root").alias("low"), F.max("root").alias("high"), F.min("n").alias("fewest"), F.count(F.lit(1)).alias("region")
        )
        return join_groups(
            rows, facts, ["tree", "hi"], weight="region", spread=["sid"], keep="low <> high"
        ).drop("low", "high", "region")

    placed = regions.select("sid", "n", "rest", "tree", "hi").join(
        roots.select(F.col("v").alias("sid"), "root"), "sid", "left"
    ).withColumn("root", F.coalesce("root", "sid"))
    able = mixed(placed).where(f"rest * 100 >= (n + greatest(fewest, rest) - rest) * {percent}").drop("fewest")
    sides = union(
        checked.select(F.col("a").alias("sid"), F.col("b").alias("h"), "both"),
        checked.select(F.col("b").alias("sid"), F.col("a").alias("h"), "both"),
    )
    best = sides.groupBy("sid").agg(F.max(F.struct("both", "h")).alias("best")).select("sid", "best.h", F.col("best.both").alias("near"))
    able, _ = stage(mixed(able).drop("fewest").join(best, "sid"))
    most = "least(rest, rest_b)"
    may = f"root <> root_b AND {most} * 100 >= (n + m - {most}) * {percent}"
    enough = lambda near: f"{near} * (100 + {percent}) >= (n + m) * {percent}"
    by_item = _by_item(able.select("sid", "n", "rest", "root", "h", "near").distinct(), sets, percent, f"{may} AND NOT {enough('near')}")
    mates = able.select(
        "tree", "hi", F.col("sid").alias("b"), F.col("n").alias("m"), F.col("rest").alias("rest_b"),
        F.col("root").alias("root_b"), F.col("near").alias("near_b"),
    )
    by_region = able.withColumnRenamed("sid", "a").join(mates, ["tree", "hi"]).where(
        f"a < b AND {may} AND {enough('near')} AND {enough('near_b')}"
    ).select("a", "b")
    return union(by_item, by_region).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _by_item(open_sets: DataFrame, sets: DataFrame, percent: int, condition: str) -> DataFrame:
    """(a, b): pairs of ``open_sets`` (sid, n, rest, root, h, near) under ``condition`` that may share enough beyond the set h of a.

    To agree, sets of n and m shingles share t = percent * (n + m) / (100 + percent) at least. Of these, a shares ``near`` at
    most inside its h, and where b has the same h, b's ``near`` at most; so s = t less that lie beyond h. In one order of
    all shingles, the rare ones first, a's shingles beyond h must meet b's before the last s - 1 of them (prefix
    filter), and with the same h the meeting must come that early among b's too. Any order is right; frequencies
    are counted in ``FREQUENCY_CELLS`` cells, a table of fixed size, which tells frequent shingles from rare ones.
    """
    items, _ = stage(open_sets.join(sets.select("sid", "items"), "sid"))
    hubs = sets.select(F.col("sid").alias("h"), F.col("items").alias("known"))
    split = join_counted(items, hubs, ["h"], ["sid"])
    beyond = F.transform(F.array_except("items", "known"), lambda i: F.struct(i.alias("item"), F.lit(True).alias("beyond")))
    inside = F.transform(F.array_intersect("items", "known"), lambda i: F.struct(i.alias("item"), F.lit(False).alias("beyond")))
    facts = ["sid", "n", "rest", "root", "h", "near"]
    each, _ = stage(
        split.select(*facts, F.explode(F.concat(beyond, inside)).alias("i"))
        .select(*facts, "i.item", "i.beyond", F.pmod("i.item", F.lit(FREQUENCY_CELLS)).alias("cell"))
    )
    cells = each.groupBy("cell").agg(F.count(F.lit(1)).alias("often"))
    rank = Window.partitionBy("sid").orderBy("often", "item")  # the shingles of one set
    asking, _ = stage(
        each.where("beyond").join(F.broadcast(cells), "cell")
        .withColumns({"pos": F.row_number().over(rank) - 1, "size": F.count(F.lit(1)).over(Window.partitionBy("sid"))})
        .select(*facts, "item", "pos", "size")
    )
    asked = union(
        each.where("NOT beyond").select(*facts, "item", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("long").alias("size")),
        asking.select(*facts, "item", "pos", "size"),
    ).select(
        F.col("sid").alias("b"), F.col("n").alias("m"), F.col("rest").alias("rest_b"), F.col("root").alias("root_b"),
        F.col("h").alias("h_b"), F.col("near").alias("near_b"), "item", F.col("pos").alias("pos_b"), F.col("size").alias("size_b"),
    )
    t = f"ceil({percent} * (n + m) / {100 + percent})"
    s = f"greatest(1, {t} - if(h = h_b, least(near, near_b), near))"
    early = f"pos + {s} <= size AND (h <> h_b OR coalesce(pos_b + {s} <= size_b, false))"
    return asking.withColumnRenamed("sid", "a").join(asked, "item").where(f"a <> b AND {condition} AND {early}").select("a", "b")


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different components."""
    of_a = roots.select(F.col("v").alias("a"), F.col("root").alias("root_a"))
    of_b = roots.select(F.col("v").alias("b"), F.col("root").alias("root_b"))
    return pairs.join(of_a, "a", "left").join(of_b, "b", "left").where(
        "coalesce(root_a, a) <> coalesce(root_b, b)"
    ).select("a", "b")


def _classes(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and (set_a, set_b, root) of the classes of equal sets; root is the least sid of the component."""
    signed, _ = stage(signatures(docs, size))
    full = signed.where("n > 0")
    classes, _ = stage(
        full.groupBy("set_a", "set_b").agg(
            F.min("rid").alias("rid"), F.first("n").alias("n"), F.first("labels").alias("labels")
        ).withColumn("sid", F.xxhash64("set_a", "set_b"))
    )
    # Values of a label that make a region.
    depth = next((d for d in (4, 3, 2) if (1 - (percent / 100) ** d) ** TREES < 1.2e-5), 1)
    labelled = classes.select(
        "sid", "n", F.posexplode(F.expr(f"transform(sequence(0, {TREES - 1}), t -> struct(labels[2 * t] AS hi, labels[2 * t + 1] AS lo))")).alias("tree", "label"),
    ).select(
        "sid", "n", "tree", F.shiftrightunsigned("label.hi", 16 * (4 - depth)).alias("hi"),
        F.col("label.hi").alias("full"), "label.lo",
    )
    regions, _ = stage(regions_of(labelled))
    members, _ = stage(classes.join(regions.select("sid").distinct(), "sid").select("sid", "rid"))
    sets, _ = stage(_sets_of(docs, members, size))
    reachable, _ = stage(reachable_sets(sets, percent))
    sets, _ = stage(sets.join(reachable.select("sid"), "sid"))
    regions, _ = stage(regions_of(regions.drop("region").join(reachable, "sid")))  # with rest
    ordered = lambda pairs: pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # Hubs first: within a group of copies they settle nearly all; then neighbours that are still apart.
    by_hub, _ = stage(ordered(to_hubs(regions)))
    checked, _ = stage(compared(by_hub, sets))
    links = agreeing(checked, percent)
    roots = components(links)
    beside, _ = stage(_between(ordered(_neighbours(regions)), roots).join(by_hub, ["a", "b"], "left_anti"))
    also, _ = stage(compared(beside, sets))
    linked, n_linked = stage(agreeing(also, percent))
    if n_linked:
        links = union(links, linked)
        roots = components(links)
    checked = union(checked, also)
    left, _ = stage(apart(regions, roots, checked, sets, percent))
    more, n_more = stage(agreeing(compared(left, sets), percent))
    if n_more:
        roots = components(union(links, more))
    rooted = classes.select("set_a", "set_b", F.col("sid").alias("v")).join(roots, "v", "left")
    return signed, rooted.select("set_a", "set_b", F.coalesce("root", "v").alias("root"))


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (least doc_id reachable by links).

    Documents are linked where their sets of ``size``-word shingles have a Jaccard similarity of
    ``percent`` / 100 or more. A text with fewer words has one shingle of all of them; a text without words, or
    null, has none and is its own component. Equal sets are one class, whatever their doc_id. Repeated rows share
    their class. A row without doc_id takes part in its component; a component of such rows alone has a null component_id.
    """
    signed, rooted = _classes(docs, size, percent)
    rows = signed.select("doc_id", F.col("n").alias("n_shingles"), "set_a", "set_b")
    least = rows.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("least")).join(rooted, ["set_a", "set_b"])
    named = least.groupBy("root").agg(F.min("least").alias("component_id"))
    classed = rooted.join(named, "root").select("set_a", "set_b", "component_id")
    with_class = rows.where("n_shingles > 0").join(classed, ["set_a", "set_b"])
    without = rows.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id"]
    return union(with_class.select(*columns), without.select(*columns)).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, that represent their component of near duplicates: one row of each.

    It is a row of the least doc_id, one without doc_id only where no other has one. Rows without words stay.
    """
    signed, rooted = _classes(docs, size, percent)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")
    rows, _ = stage(
        signed.where("n > 0").groupBy("set_a", "set_b", "rid").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("m"))
        .join(rooted, ["set_a", "set_b"]).select("root", "place", "m")
    )
    heads = rows.groupBy("root").agg(F.min(F.struct("place", "m")).alias("head")).select("root", "head.place.rid", "head.m")
    tag, lost, twin = free_names(docs.columns, "_rid", "_gone", "_twice")
    gone = rows.join(heads.select("root", "rid"), "root").where("place.rid <> rid").select(F.col("place.rid").alias(lost))
    left = docs.withColumn(tag, row_identity(docs)).join(gone, F.col(tag) == F.col(lost), "left_anti")
    twice, n_twice = stage(heads.where("m > 1").select(F.col("rid").alias(twin)))
    if n_twice:
        again = left.join(twice, F.col(tag) == F.col(twin), "left_semi").dropDuplicates([tag])
        left = union(left.join(twice, F.col(tag) == F.col(twin), "left_anti"), again)
    return left.select(*[quoted(c) for c in docs.columns])
