"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the vocabulary holds a whitespace marker after another character (checked when the model
is loaded), so no merge crosses the start of a run of markers: each marked word, with the
markers before it, is segmented alone. A task segments each distinct marked word once, keeps ids and
decoded text in a table, and puts the ids of a text together by position with array takes. The
table belongs to one task and is emptied beyond ``table_chunks`` entries, so nothing is shuffled and
memory is bounded whatever the vocabulary of the corpus.
"""

from __future__ import annotations

import functools
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lakedupes.llm.columns import with_made

_MARK = "▁"
_CHUNK = re.compile(" +[^ ]+| +")


@functools.lru_cache(maxsize=2)
def load(path: str):
    """The library's model, once per worker; raises where a piece crosses a marker."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    crossing = re.compile(f"[^{_MARK}]{_MARK}")
    for i in range(model.get_piece_size()):
        if crossing.search(model.id_to_piece(i)):
            raise ValueError(f"piece {i} crosses a whitespace marker: chunks are not independent")
    if model.encode("a", out_type=str)[0][0] != _MARK or model.encode("  a", out_type=str)[0][:2] != _MARK * 2:
        raise ValueError("the model must add a dummy prefix and keep extra spaces")
    return model


class ChunkTable:
    """Ids and decoded texts of the distinct chunks seen so far."""

    def __init__(self, path: str):
        self.model = load(path)
        self.alone = self.model.piece_to_id(_MARK)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.starts = self.sizes = np.zeros(0, np.int64)
        self.altered: dict[int, str] = {}

    def add(self, chunks: list[str]) -> None:
        """Segment new chunks; each starts with a space, which stands for the dummy prefix."""
        found = [ids or [self.alone] for ids in self.model.encode([c[1:] for c in chunks])]
        first = len(self.index)
        self.index.update(zip(chunks, range(first, first + len(chunks)), strict=True))
        texts = self.model.decode(found)
        self.altered.update(
            (first + i, " " + t) for i, (c, t) in enumerate(zip(chunks, texts, strict=True)) if t != c[1:]
        )
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(sizes.sum()))
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.flat = np.concatenate((self.flat, flat))


def _encode_slice(texts: list[str | None], table: ChunkTable, end: int) -> tuple[pa.Array, pa.Array]:
    pieces: list[str] = []
    counts = []
    for text in texts:
        found = _CHUNK.findall(" " + text.replace(_MARK, " ")) if text else []
        counts.append(len(found))
        pieces += found
    new = set(pieces).difference(table.index)
    if new:
        table.add(list(new))
    codes = np.fromiter(map(table.index.__getitem__, pieces), np.int64, len(pieces))
    size = table.sizes[codes]
    upto = np.cumsum(size)
    at = np.repeat(table.starts[codes] - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)
    ids = table.flat[at]
    chunk_ends = np.cumsum(counts)
    ends = np.concatenate(([0], upto))[chunk_ends]
    ids = np.insert(ids, ends, end)
    offsets = np.concatenate(([0], ends + np.arange(1, len(texts) + 1))).astype(np.int32)
    altered = table.altered
    if altered:
        odd = np.isin(codes, np.fromiter(altered, np.int64, len(altered)))
        for i in np.flatnonzero(odd):
            pieces[i] = altered[codes[i]]
    starts_at = chunk_ends - counts
    decoded = ["".join(pieces[a:b])[1:] for a, b in zip(starts_at.tolist(), chunk_ends.tolist(), strict=True)]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32())), pa.array(decoded, pa.string())


def encode_decode(
    docs: DataFrame, model_path: str, table_chunks: int = 300_000, column: str = "text"
) -> DataFrame:
    """``ids`` (array<int>, closed by the end id) and ``decoded`` (string) of every row's text.

    Other columns pass through; columns of those two names are replaced. A null text counts as
    empty: its ids are the end id alone, its decoded text is ''. Rows are independent: repeated
    rows give repeated results, an empty table an empty one. Texts may have any length.
    """
    def make():
        table = ChunkTable(model_path)
        end = table.model.eos_id()

        def encode(texts: pa.Array) -> list[pa.Array]:
            if len(table.index) > table_chunks:
                table.clear()
            return list(_encode_slice(texts.to_pylist(), table, end))

        return encode

    return with_made(docs, column, {"ids": "array<int>", "decoded": "string"}, make)
