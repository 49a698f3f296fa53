from __future__ import annotations

import zstandard

from lakedupes.llm.minhash_forest import packed_texts


def test_texts_read_again(spark):
    """Of all texts only those of members travel, but for a few, and compressed."""
    rows = [(i.to_bytes(16, "big"), None if i == 30 else f"text é {i} " * 50) for i in range(3000)]
    texts = spark.createDataFrame(rows, "rid binary, text string")
    members = texts.where("substring(rid, 15, 2) < x'0080'").select("rid")
    got = {bytes(r.rid): zstandard.decompress(r.text).decode() for r in packed_texts(texts, members).collect()}
    assert {r for r, _ in rows[:128]} <= set(got) and len(got) < 150
    assert all(got[r] == (t or "") for r, t in rows if r in got)
    assert packed_texts(texts, members.where("false")).count() == 0
