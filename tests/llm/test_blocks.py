from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import zstandard

from lakedupes.llm import substrings
from lakedupes.llm.suffix_sort import _sorted_rows


def _blocks(texts: list[str], n: int) -> list[pa.Table]:
    return [
        pa.table({
            "doc_id": pa.array(range(i, len(texts), n), pa.int64()),
            "text": pa.array([zstandard.compress(t.encode()) for t in texts[i::n]], pa.binary()),
            "block": pa.array([i] * len(texts[i::n]), pa.int64()),
        })
        for i in range(n)
    ]


def test_one_row_per_block_and_bucket():
    """What a bucket returns is a bit per anchor of a block, not a row per document."""
    r = random.Random(2)
    shared = "".join(r.choices("abcdefgh ", k=400))
    texts = ["".join(r.choices("abcdefgh ", k=300)) + (shared if i % 3 else "") for i in range(300)]
    blocks, buckets = _blocks(texts, 4), 5
    packs = pa.concat_tables([substrings._proofs(b, 50, buckets) for b in blocks])
    assert packs.num_rows <= 4 * buckets
    bits = pa.concat_tables([
        substrings._meet(packs.filter(pa.array([x == i for x in packs["bucket"].to_pylist()]))) for i in range(buckets)
    ])
    assert bits.num_rows == packs.num_rows
    found = pa.concat_tables([
        substrings._contexts(b, bits.filter(pa.array([x == i for x in bits["block"].to_pylist()])), 50, buckets, 1) for i, b in enumerate(blocks)
    ])
    gone = substrings._owned(found, 50)
    removed = {}
    for d, g in zip(gone["doc_id"].to_pylist(), gone["gone"].to_pylist(), strict=True):
        for begin, end in np.frombuffer(g, np.int64).reshape(2, -1).T.tolist():
            removed.setdefault(d, set()).update(range(begin, end))
    first: dict[str, int] = {}
    want: dict[int, set[int]] = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - 49):
            if first.setdefault(t[k:k + 50], i) < i:
                want.setdefault(i, set()).update(range(k, k + 50))
    assert removed == want and len(want) == 199


def test_anchors_of_pieces():
    """Found a few texts at a time, the anchors are those of each text alone."""
    r = random.Random(6)
    texts = ["", "a" * 49, "b" * 50, *["".join(r.choices("ab é", k=r.randint(0, 300))) for _ in range(60)], "", "x" * 2000]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    got = list(zip(*(x.tolist() for x in substrings.anchors(np.frombuffer(b"".join(data), np.uint8), offsets, 50)), strict=True))
    assert sum(x[3] for x in got) == sum(max(0, len(d) - 49) for d in data)
    for i, d in enumerate(data):
        alone = substrings.anchors(np.frombuffer(d, np.uint8), np.array([0, len(d)]), 50)
        want = [(i, k, f + offsets[i], s) for _, k, f, s in zip(*(x.tolist() for x in alone), strict=True)]
        assert [x for x in got if x[0] == i] == want


def test_sorted_rows():
    r = np.random.default_rng(4)
    columns = [r.integers(0, k, 2000).astype(np.uint64) for k in (3, 1, 5, 40)]
    order = _sorted_rows(columns)
    rows = list(zip(*(c.tolist() for c in columns), strict=True))
    assert [rows[i] for i in order] == sorted(rows) and sorted(order.tolist()) == list(range(2000))
    assert _sorted_rows([c[:0] for c in columns]).tolist() == []
