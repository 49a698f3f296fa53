"""Bytes of documents that repeat a string of fifty bytes of an earlier document.

Suffixes are sorted in buckets that hold all equal strings together. Of the sixteen-byte grams inside a string
of fifty bytes, the one with the least hash is its anchor: equal strings have equal anchors at the same place, and a
document has an anchor about every eighteen bytes. Anchors that occur in one document only are dropped by
their hashes: documents are dealt into blocks, a block sends the sorted hashes of its anchors to the buckets, one pack per bucket, and
gets one bit back for each. Around the others, the strings of each anchor are a short context; contexts of an
anchor meet in one bucket, where their suffixes are put in order by two-stage sorting and
neighbours with a common prefix of fifty bytes are equal strings.

What a block sees twice is settled there: of equal contexts, only that of the least document
travels, the others are repeats already. So a passage in a third of all documents reaches a bucket once per block.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.ipc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakedupes.llm.batches import mix, range_hashes, slices, text_buffer
from lakedupes.llm.suffix_sort import common_prefixes, two_stage_order
from lakedupes.operators.groups import shuffle_partitions

LENGTH = 50
GRAM = 16
FLUSH_BYTES = 4_000_000
BUCKET_BYTES = 4_000_000  # of text per block of documents and per bucket of contexts
PROOF_BYTES = 64_000_000  # of text per bucket of anchors
ANCHOR_BYTES = 250_000  # of text whose anchors are found at once, so that the arrays stay in the cache
KEY_BITS = 48
_BASE = 0x9E3779B97F4A7C15


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(a.tobytes() for a in arrays), 1)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, first, starts): runs of consecutive strings with one anchor. ``first`` is the position of the first
    string, ``starts`` their number, ``key`` a hash of the anchor of ``KEY_BITS`` bits."""
    found, at = [], 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + ANCHOR_BYTES, "right")) - 1)
        begin = offsets[at]
        text, key, first, starts = _anchors_of(data[begin:offsets[end]], offsets[at:end + 1] - begin, length)
        found.append((text + at, key, first + begin, starts))
        at = end
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate((none, *part)) for part in zip(*found, strict=True)) if found else (none,) * 4


def _anchors_of(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 4
    grams = data.astype(np.uint64) + np.uint64(1)
    power = _BASE
    width = 1
    while width < GRAM:
        grams = grams[:-width] * np.uint64(power) + grams[width:]
        power = power * power % 2**64
        width *= 2
    grams = mix(grams)
    # The least hash, and at equal hashes the first place, in every window of grams.
    place = np.arange(len(grams), dtype=np.uint64)
    least, span, window = (grams & np.uint64(0xFFFFFFFF00000000)) | place, 1, length - GRAM + 1
    while span * 2 <= window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < window:
        least = np.minimum(least[:span - window], least[window - span:])
    end = np.repeat(offsets[1:], np.diff(offsets))[:len(least)]
    start = np.flatnonzero(np.arange(len(least)) + length <= end)
    at = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # A run also ends where the text does, so that no context reaches over.
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (np.diff(start) != 1)
    head = np.flatnonzero(new)
    starts = np.diff(np.append(head, len(start)))
    first = start[head]
    # Anchors have small hashes; mixed again, keys are spread evenly.
    key = (mix(grams[at[head]]) >> np.uint64(64 - KEY_BITS)).astype(np.int64)
    return np.searchsorted(offsets, first, "right") - 1, key, first, starts


def _proof_buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The first of the sorted keys in each bucket, and their number; a bucket is a range of keys."""
    return np.searchsorted(keys, [-(-(i << KEY_BITS) // buckets) for i in range(buckets + 1)])


class _Block:
    """The anchors of a block of documents, and its different keys, sorted; ``several`` where more than one document has the key."""

    def __init__(self, table: pa.Table, length: int):
        self.ids = table["doc_id"].to_numpy()
        texts = pa.array([zstandard.decompress(t) for t in table["text"].to_pylist()], pa.large_binary())
        self.data, self.offsets = text_buffer(texts)
        self.runs = anchors(self.data, self.offsets, length)
        text, key = self.runs[:2]
        doc = self.ids[text]
        order = np.argsort(key)
        key, doc = key[order], doc[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        head = np.flatnonzero(new)
        self.keys = key[head]
        self.several = np.zeros(0, bool)
        if len(head):
            self.several = np.minimum.reduceat(doc, head) != np.maximum.reduceat(doc, head)
        self.number = np.empty(len(key), np.int64)  # of each anchor's key
        self.number[order] = np.cumsum(new) - 1


def _proofs(table: pa.Table, length: int, buckets: int) -> pa.Table:
    """(block, bucket, pack): the keys of a block, and whether several of its documents have them, by bucket."""
    block = _Block(table, length)
    marked = block.keys << 1 | block.several
    bounds = _proof_buckets(block.keys, buckets).tolist()
    found = []
    for bucket, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if b > a:
            # Byte by byte, so that the high bytes, which are zero, lie together.
            planes = np.diff(marked[a:b], prepend=0).view(np.uint8).reshape(-1, 8).T
            found.append((bucket, _pack(np.ascontiguousarray(planes))))
    number = table["block"][0].as_py()
    return pa.table([pa.array([number] * len(found), pa.int64()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], ["block", "bucket", "pack"])


def _runs(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of the runs of equal values."""
    if not len(sorted_values):
        return []
    cuts = np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1
    edges = [0, *cuts.tolist(), len(sorted_values)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _meet(table: pa.Table) -> pa.Table:
    """(block, bucket, shared): of one bucket, a bit for each key of a block: whether several documents have it."""
    packs = []
    for pack in table["pack"].to_pylist():
        planes = np.frombuffer(zstandard.decompress(pack), np.uint8).reshape(8, -1)
        packs.append(np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel()))
    marked = np.concatenate(packs)
    order = np.argsort(marked)  # by key first
    key = marked[order] >> 1
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    times = np.diff(np.append(head, len(key)))
    shared = np.empty(len(key), bool)
    shared[order] = np.repeat((times > 1) | (np.maximum.reduceat(marked[order] & 1, head) > 0), times)
    cuts = np.cumsum([len(p) for p in packs])[:-1]
    bits = [np.packbits(part).tobytes() for part in np.split(shared, cuts)]
    return table.select(["block", "bucket"]).append_column("shared", pa.array(bits, pa.binary()))


_CONTEXT = "bucket long, doc_id long, pack binary, gone binary"
_COLUMNS = ["doc_id", "firsts", "context"]


def _write(table: pa.RecordBatch) -> bytes:
    """A batch, each column compressed: in a shuffle that takes half the room of plain rows."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(table)
    return out.getvalue().to_pybytes()


def _contexts(table: pa.Table, bits: pa.Table, length: int, proof_buckets: int, buckets: int) -> pa.Table:
    """Contexts of a block's shared anchors, each different one once with its least document in the block, packed by bucket; and, in
    ``gone``, the repeats that the block settles, on their way with any bucket."""
    if not table.num_rows:
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary())], ["bucket", "doc_id", "pack", "gone"])
    block = _Block(table, length)
    data, offsets, ids = block.data, block.offsets, block.ids
    known = block.several.copy()
    bounds = _proof_buckets(block.keys, proof_buckets).tolist()
    for bucket, shared in zip(bits["bucket"].to_pylist(), bits["shared"].to_pylist(), strict=True):
        a, b = bounds[bucket:bucket + 2]
        known[a:b] |= np.unpackbits(np.frombuffer(shared, np.uint8), count=b - a).astype(bool)
    wanted = known[block.number]
    text, key, first, starts = (x[wanted] for x in block.runs)
    content = range_hashes(data, first, first + starts + length - 1).view(np.int64)
    doc = ids[text]
    order = np.lexsort((first, doc, content, key))
    text, key, first, starts, content, doc = (x[order] for x in (text, key, first, starts, content, doc))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
    head = np.flatnonzero(new)
    least = doc[head][np.cumsum(new) - 1] if len(head) else doc
    gone = _spans(doc[doc > least], (first - offsets[text])[doc > least], (first - offsets[text] + starts + length - 1)[doc > least])
    mine = doc == least
    local = (first - offsets[text])[mine]
    count = np.add.reduceat(mine.astype(int), head) if len(head) else np.zeros(0, int)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array(local, pa.int32()))
    raw = data.tobytes()
    context = [raw[a:b] for a, b in zip(first[head].tolist(), (first[head] + starts[head] + length - 1).tolist(), strict=True)]
    found = pa.RecordBatch.from_arrays(
        [pa.array(doc[head]), lists, pa.array(context, pa.binary())], _COLUMNS
    )
    bucket = key[head] % buckets
    order = np.argsort(bucket, kind="stable")
    bucket, found = bucket[order], found.take(pa.array(order))
    packs = [(int(bucket[a]), _write(found.slice(a, b - a))) for a, b in _runs(bucket)]
    n, m = len(packs), len(gone)
    return pa.table(
        [
            pa.array([*[p[0] for p in packs], *[g[0] % buckets for g in gone]], pa.int64()),
            pa.array([*[None] * n, *[g[0] for g in gone]], pa.int64()),
            pa.array([*[p[1] for p in packs], *[None] * m], pa.binary()),
            pa.array([*[None] * n, *[g[1] for g in gone]], pa.binary()),
        ],
        ["bucket", "doc_id", "pack", "gone"],
    )


def _merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs covered by spans."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    head = np.flatnonzero(new)
    return begin[head], end[np.append(head[1:], len(begin)) - 1]


def _spans(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[tuple[int, bytes]]:
    """For each document its merged spans, packed."""
    if not len(doc):
        return []
    # Documents are laid out one after the other, so that all are merged at once.
    ids, number = np.unique(doc, return_inverse=True)
    room = int(end.max()) + 1
    begin, end = _merged(begin + number * room, end + number * room)
    number = begin // room
    begin, end = begin - number * room, end - number * room
    return [(int(ids[number[a]]), np.concatenate((begin[a:b], end[a:b])).astype(np.int64).tobytes()) for a, b in _runs(number)]


def _owned(table: pa.Table, length: int) -> pa.Table:
    """(doc_id, gone): the repeats among the contexts of one bucket, and those settled before."""
    settled = table.filter(pa.compute.is_valid(table["gone"])).select(["doc_id", "gone"])
    packs = [pa.ipc.open_stream(p).read_all() for p in table["pack"].drop_null().to_pylist()]
    if not packs:
        return settled
    table = pa.concat_tables(packs).combine_chunks()
    doc = table["doc_id"].to_numpy()
    # Equal contexts of several tasks are sorted once, for the least of their documents.
    encoded = table["context"].combine_chunks().dictionary_encode()
    code = encoded.indices.to_numpy()
    data, offsets = text_buffer(encoded.dictionary)
    size = np.diff(offsets)
    owner = np.full(len(size), np.iinfo(np.int64).max)
    np.minimum.at(owner, code, doc)
    order = two_stage_order(data, size, size - length + 1, length)
    prefix = common_prefixes(data, order, length)
    head = np.flatnonzero(prefix < length)
    context = np.repeat(np.arange(len(size)), size)[order]
    least = np.minimum.reduceat(owner[context], head) if len(head) else doc[:0]
    repeat = np.repeat(least, np.diff(np.append(head, len(order)))) < owner[context]
    order, context = order[repeat], context[repeat]
    by_context = np.argsort(context, kind="stable")
    at, found = (order - offsets[context])[by_context], np.searchsorted(context[by_context], np.arange(len(size) + 1))
    # Once for every place of the context in its document: where a smaller document has the context too, all of it is a repeat.
    firsts = table["firsts"].combine_chunks()
    row = np.repeat(np.arange(len(doc)), firsts.value_lengths().to_numpy())
    places = firsts.flatten().to_numpy().astype(np.int64)
    copy = (doc > owner[code])[row]
    whole, mine = row[copy], row[~copy]
    times = np.diff(found)[code[mine]]
    index = np.repeat(found[code[mine]] - np.cumsum(times) + times, times) + np.arange(times.sum())
    begin = np.concatenate((places[copy], np.repeat(places[~copy], times) + at[index]))
    end = np.concatenate((places[copy] + size[code[whole]], begin[len(whole):] + length))
    gone = _spans(np.concatenate((doc[whole], np.repeat(doc[mine], times))), begin, end)
    new = pa.table([pa.array([g[0] for g in gone], pa.int64()), pa.array([g[1] for g in gone], pa.binary())], ["doc_id", "gone"])
    return pa.concat_tables([settled.cast(new.schema), new])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their texts, a few at a time."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            texts = pa.array([zstandard.decompress(t) for t in part.column(at).to_pylist()], pa.large_binary())
            columns = [texts if i == at else c for i, c in enumerate(part.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def _packed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the texts compressed, for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(3)
        for part in slices(batches, "text"):
            packed = [compressor.compress(t or b"") for t in part.column("text").cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(packed, pa.binary())], ["doc_id", "text"])

    return docs.mapInArrow(run, "doc_id long, text binary")


def repeated_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, removed (array of begin, end), kept (binary).

    Each byte covered by a string of ``length`` bytes that also starts in a document with a smaller doc_id is removed; ``removed``
    holds the maximal runs in UTF-8 bytes, ``kept`` what is left. A null text is empty; a text shorter than ``length``
    is kept. Rows of one doc_id do not remove bytes from each other; rows without doc_id neither lose nor remove bytes.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = narrow.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    buckets = max(shuffle_partitions(docs.sparkSession), ceil(whole / BUCKET_BYTES))
    proof_buckets = max(shuffle_partitions(docs.sparkSession), ceil(whole / PROOF_BYTES))
    long = narrow.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    # By the text too, so that many rows of one doc_id are spread; a key that it has in two blocks only counts as shared.
    blocks = _packed_texts(long).withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)))
    proofs = blocks.groupBy("block").applyInArrow(lambda t: _proofs(t, length, proof_buckets), "block long, bucket long, pack binary")
    bits = proofs.groupBy("bucket").applyInArrow(_meet, "block long, bucket long, shared binary")
    contexts = blocks.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(
        lambda t, b: _contexts(t, b, length, proof_buckets, buckets), _CONTEXT
    )
    repeats = contexts.groupBy("bucket").applyInArrow(lambda t: _owned(t, length), "doc_id long, gone binary")
    gone = repeats.groupBy("doc_id").agg(F.collect_list("gone").alias("gone"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _unpacked(batches):
            removed, kept, sizes = [], [], []
            for text, packs in zip(part.column("text").to_pylist(), part.column("gone").to_pylist(), strict=True):
                sizes.append(len(text))
                spans = [np.frombuffer(p, np.int64).reshape(2, -1) for p in packs or []]
                if not spans:
                    removed.append([])
                    kept.append(text)
                    continue
                begin, end = _merged(*np.concatenate(spans, axis=1))
                removed.append([{"begin": a, "end": b} for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
                edges = [0, *np.column_stack((begin, end)).ravel().tolist(), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "removed", "kept"],
            )

    return _packed_texts(narrow).join(gone, "doc_id", "left").select("doc_id", "text", "gone").mapInArrow(
        cut, "doc_id long, n_bytes long, removed array<struct<begin:long,end:long>>, kept binary"
    )
