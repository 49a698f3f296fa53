from __future__ import annotations

import numpy as np
import pyarrow as pa

from lakedupes.llm import substrings


def test_equal_contexts_are_sorted_once(monkeypatch):
    """Contexts that several tasks send alike: one is sorted, and every larger document loses all of its places."""
    sorted_bytes = []
    plain = substrings.two_stage_order
    monkeypatch.setattr(substrings, "two_stage_order", lambda data, *a: sorted_bytes.append(len(data)) or plain(data, *a))
    same, near = b"abcdefghijkl", b"xbcdefghijkm"

    def pack(rows):
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(
            (pa.int64(), pa.list_(pa.int32()), pa.binary()))]
        return substrings._write(pa.RecordBatch.from_arrays(columns, substrings._COLUMNS))

    packs = [
        pack([(7, [100], same)]), pack([(5, [0, 40], same), (9, [3], near)]),
        pack([(8, [20, 60], same)]), pack([(5, [90], same)]),
    ]
    n = len(packs)
    table = pa.table(
        {"bucket": pa.array([1] * n, pa.int64()), "doc_id": pa.array([None] * n, pa.int64()), "pack": pa.array(packs), "gone": pa.array([None] * n, pa.binary())}
    )
    out = substrings._owned(table, 10)
    got = {d: np.frombuffer(g, np.int64).reshape(2, -1).T.tolist() for d, g in zip(out["doc_id"].to_pylist(), out["gone"].to_pylist(), strict=True)}
    assert got == {7: [[100, 112]], 8: [[20, 32], [60, 72]], 9: [[4, 14]]}
    assert sorted_bytes == [len(same) + len(near)]
