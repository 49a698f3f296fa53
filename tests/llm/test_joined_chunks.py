from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa

from lakedupes.llm.alignment import ByteTokens, Chunks, _cuts
from lakedupes.llm.batches import text_buffer
from lakedupes.llm.queries import tokenizer_path

PATHS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path()


class Counted:
    """A model that counts the texts given to it."""

    def __init__(self, model):
        self.model, self.texts = model, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.model.encode_batch_fast(texts, **options)


def test_chunks_are_encoded_together():
    """A text for many chunks, not one for each, with the ids of each chunk as if it were alone."""
    r = random.Random(3)
    encoder = ByteTokens(PATHS[0])
    chunks = ["".join(r.choices("abéßɏ.,'0<|", k=r.randint(1, 9))) for _ in range(2000)]
    chunks += ["don", "'t", "a\n\nb", "trail\n", "\x00x", "ɐ x", "日本", "e ́x", "  two", "<|endoftext|>"] * 20
    r.shuffle(chunks)
    alone = [encoder.model.encode(" " + c, add_special_tokens=False).ids for c in chunks]
    encoder.model = Counted(encoder.model)
    assert encoder.encode(chunks) == alone and encoder.model.texts < len(chunks) / 5
    assert encoder.encode(["日本", "\n"]) == [alone[chunks.index("日本")], encoder.model.model.encode(" \n", add_special_tokens=False).ids]
    assert encoder.encode([]) == []


def test_cuts():
    r = random.Random(8)
    texts = ["".join(r.choices("  ab~!\n\x7fÀɏɐÿ̀日😀", k=r.randint(0, 12))) for _ in range(3000)]
    data, offsets = text_buffer(pa.array(texts, pa.large_string()))
    want = [o + len(t[:m.start()].encode()) for o, t in zip(offsets.tolist(), texts, strict=False)
            for m in re.finditer("(?<=[!-~À-ɏ]) (?=[!-~À-ɏ])", t)]
    assert _cuts(data, offsets).tolist() == want and len(want) > 300


def test_repeated_pairs_of_a_block():
    """Pairs of a block, and how often each text links them, added up over chunks that come more than once."""
    chunks = Chunks(*PATHS)
    texts = ["word other word", None, "word other word word", "other"]
    facts, pairs, n = chunks.block(texts)
    assert np.all(np.diff(pairs) > 0) and n.sum() == sum(map(len, facts["codes"].to_pylist()))
    one = {}
    for t in ("word", "other"):
        f, p, _ = Chunks(*PATHS).block([t])
        one[t] = dict(zip(p[f["codes"].to_pylist()[0]].tolist(), f["times"].to_pylist()[0], strict=True))
    for text, codes, times in zip(texts, facts["codes"].to_pylist(), facts["times"].to_pylist(), strict=True):
        want: dict[int, int] = {}
        for t in (text or "").split():
            for p, k in one[t].items():
                want[p] = want.get(p, 0) + k
        assert dict(zip(pairs[codes].tolist(), times, strict=True)) == want
