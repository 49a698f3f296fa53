from __future__ import annotations

import numpy as np

from lakedupes.llm.alignment import Chunks
from lakedupes.llm.queries import tokenizer_path


class Encoder:
    bytes = [b" ", b"a", b"b", b" a", b" b"]

    def __init__(self, ids):
        self.ids = ids

    def encode(self, chunks):
        return [list(self.ids[c]) for c in chunks]


def test_bytes_in_the_wrong_chunk():
    """The bytes of all chunks together are right, but two chunks do not have their own."""
    chunks = Chunks(tokenizer_path("byte_bpe_50k.json"), tokenizer_path())
    chunks.encoders = (Encoder({"a": [3, 0], "b": [2], "ab": [3, 2]}), Encoder({"a": [0, 1], "b": [4], "ab": [0, 1, 2]}))
    chunks.sizes = [np.array([len(b) for b in e.bytes]) for e in chunks.encoders]
    chunks.add(["a", "b", "ab"])
    assert chunks.exact.tolist() == [False, False, True]
    assert chunks.facts.T.tolist() == [[0, 0, 0, 0], [0, 0, 0, 0], [2, 3, 2, 3]]
    assert chunks.groups == ["", "", "3|0,1;2|2;"]
