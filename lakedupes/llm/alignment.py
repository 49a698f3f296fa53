"""Alignment of two tokenizers on the same texts, and counts of the id pairs that they link.

Both tokenizers cut the same bytes. Places where a token of either ends cut both sequences into groups, found by
diagonal run skipping: as long as the end arrays agree at the present index shift, probes of doubling width
jump over one-to-one stretches; where they differ, one irregular group is resolved token by token and the shift
updated. The ids of a group are linked with each other. Both cut at the spaces between words, so a task aligns each
distinct chunk between such spaces once, all new chunks of a slice in one sweep, and puts the groups of a text together by
position; a text without such a space is one chunk.

How many documents hold a pair is counted in two steps. A slice of texts (a block) counts its own pairs; the sums of
all blocks are joined back to the blocks' pair lists, so what is shuffled is a list of distinct pairs per block, not a
row per link, and each block meets its own counts only.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakedupes.llm.batches import lists, slices, text_buffer
from lakedupes.llm.piece_tokens import load as load_pieces
from lakedupes.operators.groups import join_groups
from lakedupes.staging import stage

# Distinct chunks that a task keeps before it starts its tables again.
TABLE_CHUNKS = 200_000
# Chunks that are encoded as one text.
JOINED = 100
# A cut before a space with one of [!-~À-ɏ] on either side is a cut of either tokenizer's own first step: see ``_cuts``. Chunks that
# begin and end with one of these can be joined by spaces and are cut there again.
_JOINABLE = re.compile(r"[!-~À-ɏ](?:.*[!-~À-ɏ])?\Z", re.DOTALL)
_MARK = "▁"


@functools.lru_cache(maxsize=1)
def _byte_letters() -> dict[str, int]:
    """The printable letter of each byte in byte-level vocabularies: itself where it shows, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class ByteTokens:
    """Encoder A: a byte-level vocabulary file; the text is given with a space in front."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            special = {t["id"] for t in json.load(file)["added_tokens"]}
        letters = _byte_letters()
        size = self.model.get_vocab_size()
        names = [self.model.id_to_token(i) for i in range(size)]
        self.bytes = [n.encode() if i in special else bytes(letters[c] for c in n) for i, n in enumerate(names)]
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)

    def _each(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    def encode(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk. Chunks that can be joined are encoded many at a time, and the ids dealt out by their bytes."""
        joined = [c for c in chunks if _JOINABLE.match(c)]
        found = self._each([" ".join(joined[k:k + JOINED]) for k in range(0, len(joined), JOINED)])
        flat = list(itertools.chain.from_iterable(found))
        ends = np.cumsum(self.sizes[np.array(flat, np.int64)])
        want = np.cumsum(np.fromiter((len(c.encode()) + 1 for c in joined), np.int64, len(joined)))
        upto = np.searchsorted(ends, want) + 1
        if not len(joined) or upto[-1] != len(ends) or not np.array_equal(ends[upto - 1], want):
            return self._each(chunks)
        cuts = [0, *upto.tolist()]
        shares = (flat[a:b] for a, b in itertools.pairwise(cuts))
        if len(joined) == len(chunks):
            return list(shares)
        alone = iter(self._each([c for c in chunks if not _JOINABLE.match(c)]))
        return [next(shares) if _JOINABLE.match(c) else next(alone) for c in chunks]


class PieceTokens:
    """Encoder B: a piece model, which adds the space in front itself."""

    def __init__(self, path: str):
        self.model = load_pieces(path)
        byte = re.compile("<0x([0-9A-F]{2})>")
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            name = self.model.id_to_piece(i)
            found = byte.fullmatch(name) if self.model.is_byte(i) else None
            self.bytes.append(bytes([int(found[1], 16)]) if found else name.replace(_MARK, " ").encode())

    def encode(self, chunks: list[str]) -> list[list[int]]:
        return self.model.encode(chunks)


@functools.lru_cache(maxsize=2)
def _encoders(byte_path: str, piece_path: str) -> tuple[ByteTokens, PieceTokens]:
    return ByteTokens(byte_path), PieceTokens(piece_path)


def common_ends(left: list[int], right: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Index after the last token of each group, on either side, from the tokens' ends (both rising to one value).

    At a shift the arrays are compared in probes of doubling width. The first probe that differs is halved
    down to the first difference; there one group is closed by walking both sides to their next common end.
    """
    i = j = 0
    n = len(left)
    firsts: list[int] = []  # one-to-one stretches: first token of A, first of B, length
    others: list[int] = []
    lengths: list[int] = []
    ends_a: list[int] = []  # irregular groups
    ends_b: list[int] = []
    while i < n:
        first, width = i, 1
        while i < n and left[i:i + width] == right[j:j + width]:
            i += width
            j += width
            width *= 2
        while width > 1 and i < n:
            width //= 2
            if left[i:i + width] == right[j:j + width]:
                i += width
                j += width
        i, j = min(i, n), min(j, len(right))  # the last probe may reach beyond the ends
        if i > first:
            firsts.append(first)
            others.append(j - i + first)
            lengths.append(i - first)
        if i < n:
            a, b = left[i], right[j]
            while a != b:
                if a < b:
                    i += 1
                    a = left[i]
                else:
                    j += 1
                    b = right[j]
            i += 1
            j += 1
            ends_a.append(i)
            ends_b.append(j)
    # Groups of stretches and irregular groups, merged in order.
    size = np.array(lengths, np.int64)
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + 1
    a = np.concatenate((np.array(ends_a, np.int64), np.repeat(np.array(firsts, np.int64), size) + step))
    b = np.concatenate((np.array(ends_b, np.int64), np.repeat(np.array(others, np.int64), size) + step))
    return np.sort(a), np.sort(b)


def _group_pairs(
    ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair code, times) of the id pairs that the groups link; a code is a * width + b.

    Ids that a group repeats are counted first, so a group makes no more rows than it has distinct pairs.
    """
    def counted(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.diff(ends, prepend=0)
        code = np.repeat(np.arange(len(ends)), sizes) << 32 | ids
        if len(ends) < len(ids):
            code, times = np.unique(code, return_counts=True)
        else:
            times = np.ones(len(ids), np.int64)
        return code >> 32, code & 0xFFFFFFFF, times

    group_a, a, times_a = counted(ids_a, ends_a)
    group_b, b, times_b = counted(ids_b, ends_b)
    partners = np.bincount(group_b, minlength=len(ends_b))
    first = np.cumsum(partners) - partners
    fan = partners[group_a]
    upto = np.cumsum(fan)
    other = np.repeat(first[group_a] - (upto - fan), fan) + np.arange(int(fan.sum()))
    return np.repeat(group_a, fan), np.repeat(a, fan) * width + b[other], np.repeat(times_a, fan) * times_b[other]


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of the spaces with one of ``[!-~À-ɏ]`` on either side in their text; À-ɏ are C3 80 to C9 8F in UTF-8."""
    padded = np.concatenate((np.zeros(2, np.uint8), data, np.zeros(2, np.uint8)))
    inner = np.ones(len(data) + 1, bool)
    inner[offsets] = False  # no first byte of a text
    place = np.flatnonzero(data == 0x20)
    place = place[inner[place] & inner[place + 1]]
    before, lead = padded[place + 1], padded[place]
    after, trail = padded[place + 3], padded[place + 4]
    plain = lambda b: (b > 0x20) & (b < 0x7F)
    wide = lambda b, c: (b >= 0xC3) & (b <= 0xC8) | (b == 0xC9) & (c <= 0x8F)
    return place[(plain(before) | (before >= 0x80) & wide(lead, before)) & (plain(after) | wide(after, trail))]


def _distinct(sorted_values: np.ndarray) -> np.ndarray:
    """Places where a new value begins."""
    new = np.ones(len(sorted_values), bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    return np.flatnonzero(new)


def _at(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs of ``sizes`` that start at ``starts``, one run after the other."""
    upto = np.cumsum(sizes)
    return np.repeat(starts - (upto - sizes), sizes) + np.arange(int(sizes.sum()))


class Chunks:
    """The distinct chunks of a task with the alignment of each: sizes, pairs, and its groups as text."""

    def __init__(self, byte_path: str, piece_path: str):
        self.encoders = _encoders(byte_path, piece_path)
        self.width = len(self.encoders[1].bytes)
        self.sizes = [np.array([len(b) for b in e.bytes], np.int64) for e in self.encoders]
        names = [[str(i) for i in range(len(e.bytes))] for e in self.encoders]
        self.inner = [np.array([n + "," for n in side], object) for side in names]
        self.last = [np.array([n + mark for n in side], object) for side, mark in zip(names, "|;", strict=True)]
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.groups: list[str] = []
        self.exact = np.zeros(0, bool)  # whether the bytes of the ids of both sides are those of the chunk
        self.facts = np.zeros((4, 0), np.int64)  # tokens of A, of B, groups, links
        self.starts = self.counts = np.zeros(0, np.int64)  # the chunk's pairs in the next two
        self.pairs, self.times = np.zeros((2, 0), np.int64)

    def add(self, chunks: list[str]) -> None:
        """Align new chunks, all in one sweep: their ends coincide, so no group crosses from one to the next."""
        n, sides = len(chunks), []
        exact = np.ones(n, bool)
        given = [b" " + c.encode() for c in chunks]
        widths, whole = np.fromiter(map(len, given), np.int64, n), b"".join(given)
        for encoder, size in zip(self.encoders, self.sizes, strict=True):
            found = encoder.encode(chunks)
            # All at once: where the bytes of all ids are those of all chunks and each has its share, each chunk is exact.
            count = np.fromiter(map(len, found), np.int64, n)
            flat = np.fromiter(itertools.chain.from_iterable(found), np.int64, int(count.sum()))
            names = encoder.bytes
            ends = np.concatenate(([0], np.cumsum(size[flat])))[np.cumsum(count)]
            if not (np.array_equal(np.diff(ends, prepend=0), widths) and b"".join(map(names.__getitem__, flat.tolist())) == whole):
                exact &= [b"".join([names[i] for i in ids]) == t for ids, t in zip(found, given, strict=True)]
            sides.append((count, flat))
        flat = []
        for count, ids in sides:
            if not exact.all():
                ids, count = ids[np.repeat(exact, count)], np.where(exact, count, 0)
            flat.append((ids, np.cumsum(count)))
        (ids_a, to_a), (ids_b, to_b) = flat
        ends = [np.cumsum(size[ids]).tolist() for size, ids in zip(self.sizes, (ids_a, ids_b), strict=True)]
        ends_a, ends_b = common_ends(*ends)
        owner = np.searchsorted(to_a, ends_a - 1, "right")
        group, pair, times = _group_pairs(ids_a, ids_b, ends_a, ends_b, self.width)
        of = owner[group]  # rises; a pair that several groups of a chunk link stays in several rows
        counts = np.bincount(of, minlength=n)
        links = np.bincount(of, times, n).astype(np.int64)
        self.index.update(zip((g[1:] for g in given), range(len(self.index), len(self.index) + n), strict=True))
        self.groups += self._texts(ids_a, ids_b, ends_a, ends_b, to_a + to_b)
        self.exact = np.concatenate((self.exact, exact))
        facts = np.stack((np.diff(to_a, prepend=0), np.diff(to_b, prepend=0), np.bincount(owner, minlength=n), links))
        self.facts = np.concatenate((self.facts, facts), axis=1)
        self.starts = np.concatenate((self.starts, len(self.pairs) + np.cumsum(counts) - counts))
        self.counts = np.concatenate((self.counts, counts))
        self.pairs, self.times = np.concatenate((self.pairs, pair)), np.concatenate((self.times, times))

    def _texts(self, ids_a, ids_b, ends_a, ends_b, upto: np.ndarray) -> list[str]:
        """The groups of each chunk as ``a1,a2|b1;a3|b2,b3;``."""
        sizes_a, sizes_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
        line = np.empty(len(ids_a) + len(ids_b), object)
        # In front of a token stand the tokens of its own side, and those of the other in earlier groups (B: and its own).
        place_a = np.arange(len(ids_a)) + np.repeat(ends_b - sizes_b, sizes_a)
        place_b = np.arange(len(ids_b)) + np.repeat(ends_a, sizes_b)
        line[place_a], line[place_b] = self.inner[0][ids_a], self.inner[1][ids_b]
        line[place_a[ends_a - 1]] = self.last[0][ids_a[ends_a - 1]]
        line[place_b[ends_b - 1]] = self.last[1][ids_b[ends_b - 1]]
        line = line.tolist()
        cuts = [0, *upto.tolist()]
        return ["".join(line[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def block(self, texts: list[str | None]) -> tuple[dict[str, np.ndarray | list | pa.Array], np.ndarray, np.ndarray]:
        """Facts of each text; the distinct pair codes of the block, and in how many of its texts each is."""
        n = len(texts)
        pieces: list[bytes] = []
        upto = [0]
        data, offsets = text_buffer(pa.array(texts, pa.large_string()))
        marked = data.copy()
        marked[_cuts(data, offsets)] = 0xFF  # a byte that UTF-8 has not
        marked = marked.tobytes()
        for a, b in itertools.pairwise(offsets.tolist()):
            if b > a:
                pieces += marked[a:b].split(b"\xff")
            upto.append(len(pieces))
        new = set(pieces).difference(self.index)
        if new:
            self.add([c.decode() for c in new])
        codes = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        owner = np.repeat(np.arange(n), np.diff(upto))
        whole = np.bincount(owner, ~self.exact[codes], n) == 0
        codes, owner = codes[whole[owner]], owner[whole[owner]]
        names = ("n_a", "n_b", "n_groups", "n_links")
        facts: dict[str, np.ndarray | list | pa.Array] = {
            k: np.bincount(owner, f[codes], n).astype(np.int64) for k, f in zip(names, self.facts, strict=True)
        }
        cuts = np.searchsorted(owner, np.arange(n + 1)).tolist()
        order, get = codes.tolist(), self.groups.__getitem__
        lines = ("".join(map(get, order[a:b]))[:-1] for a, b in zip(cuts, cuts[1:], strict=False))
        facts["groups_sha256"] = [hashlib.sha256(line.encode()).hexdigest() if line else "" for line in lines]
        # Pairs of each text, with how often they are linked: chunks first, then the pairs of each.
        whole = np.sort(owner * max(1, len(self.groups)) + codes)
        head = _distinct(whole)
        repeats = np.diff(np.append(head, len(whole)))
        owner, chunk = whole[head] // max(1, len(self.groups)), whole[head] % max(1, len(self.groups))
        # The block's distinct pairs are numbered once for each of its distinct chunks.
        held = np.zeros(len(self.groups), bool)
        held[chunk] = True
        known = np.flatnonzero(held)
        at = _at(self.starts[known], self.counts[known])
        order = np.argsort(self.pairs[at])
        ranked = self.pairs[at][order]
        head = _distinct(ranked)
        pairs = ranked[head]
        local = np.empty(len(at), np.int64)
        local[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(ranked))))
        first = np.zeros(len(self.groups), np.int64)
        first[known] = np.cumsum(self.counts[known]) - self.counts[known]
        sizes = self.counts[chunk]
        places = _at(first[chunk], sizes)
        keys = np.repeat(owner, sizes) * max(1, len(pairs)) + local[places]
        linked = self.times[at][places] * np.repeat(repeats, sizes)
        order = np.argsort(keys)
        key = keys[order]
        head = _distinct(key)
        key, times = key[head], np.add.reduceat(linked[order], head) if len(head) else linked
        owner, code = key // max(1, len(pairs)), key % max(1, len(pairs))
        facts["codes"], facts["times"] = lists(code.astype(np.int32), owner, n, pa.int32()), lists(times, owner, n, pa.int64())
        return facts, pairs, np.bincount(code, minlength=len(pairs))


_DOCS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<int>, times array<long>"


def aligned(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """One row per document, and for each block of documents one list of pairs, in its first row.

    (block, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, codes, times, pairs, texts): ``codes`` are places in the
    block's list ``pairs`` (a * size of B + b); ``texts`` counts the block's documents that hold each pair.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(byte_path, piece_path)
        task = TaskContext.get().partitionId()
        for number, part in enumerate(slices(batches, "text")):
            if len(chunks.index) > TABLE_CHUNKS:
                chunks.clear()
            n = part.num_rows
            facts, pairs, texts = chunks.block(part.column("text").to_pylist())
            made = {"block": pa.array(np.full(n, task << 32 | number)), "doc_id": part.column("doc_id")}
            made |= {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in facts.items()}
            for name, values in (("pairs", pairs), ("texts", texts)):
                offsets = pa.array([0, *[len(values)] * n], pa.int32())
                mask = pa.array(np.arange(n) > 0)
                made[name] = pa.ListArray.from_arrays(offsets, pa.array(values, pa.int64()), mask=mask)
            yield pa.RecordBatch.from_pydict(made)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, f"block long, {_DOCS}, pairs array<long>, texts array<long>")


def pair_counts(blocks: DataFrame, width: int) -> DataFrame:
    """(block, code, count, best) for every pair of a block: documents corpus-wide that hold it, and whether no pair of its A id has more.

    Blocks hold at most as many rows of a pair as there are blocks; pairs that most of them hold are split.
    """
    listed, _ = stage(
        blocks.where("pairs IS NOT NULL").selectExpr("block", "posexplode(arrays_zip(pairs, texts)) AS (code, p)")
        .selectExpr("block", "code", "p.pairs AS pair", "p.texts AS texts")
    )
    counts, _ = stage(
        listed.groupBy("pair").agg(F.sum("texts").alias("count"), F.count(F.lit(1)).alias("n"))
        .withColumn("a", F.expr(f"pair div {width}"))
    )
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    ranked = counts.join(highest, "a").selectExpr("pair", "n", "`count`", "`count` = highest AS best")
    return join_groups(listed, ranked, ["pair"], spread=["block"]).select("block", "code", "count", "best")


def align(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A text that is null or empty, or whose tokens of either side do not join to a space and the text, has no tokens:
    zeros and an empty ``groups_sha256``. Repeated rows count as documents of their own; other columns are left out.
    """
    blocks, _ = stage(aligned(docs, byte_path, piece_path))
    counts = pair_counts(blocks, len(_encoders(byte_path, piece_path)[1].bytes))
    facts = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def score(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        n = texts.num_rows
        count, best = np.zeros((2, pairs.num_rows), np.int64)
        code = pairs.column("code").to_numpy()
        count[code] = pairs.column("count").to_numpy()
        best[code] = pairs.column("best").to_numpy()
        codes, times = texts.column("codes").combine_chunks(), texts.column("times").combine_chunks()
        owner = np.repeat(np.arange(n), codes.value_lengths().to_numpy(zero_copy_only=False))
        places, times = codes.flatten().to_numpy(), times.flatten().to_numpy()
        sums = np.zeros((2, n), np.int64)
        np.add.at(sums[0], owner, times * best[places])
        np.add.at(sums[1], owner, times * count[places])
        out = texts.select(facts)
        return out.append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    # A group is one block: the texts of one slice and their pairs.
    return blocks.select("block", *facts, "codes", "times").groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(
        score, schema
    )
