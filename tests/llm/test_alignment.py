"""Alignment of two tokenizers against plain Python sets of ends, ids from the libraries themselves."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lakedupes.llm.alignment import Chunks, align, common_ends
from lakedupes.llm.queries import QUERIES, tokenizer_path

PATHS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path()
ODD = [
    None, "", " ", "a  b\n\n c", "\x00x \x1c y é日本 😀", "<|endoftext|> </s> <s> a", "  lead", "trail  ", " ▁ mark", "a ▁b", "plain ▁",
    "\u0085 x  y 　 z", "1 2 345 'll we've", "᠎ a​ b", "don 't x", "x\t y\r\n z", "à  Ā  ɏ ɐ x", "É é", "e ́x ́ x", "word " * 3000,
    "x" * 3000, "é" * 2000, " " * 999, "word", "word",
]


def expected(rows: list[tuple]) -> list[tuple]:
    a_model = Tokenizer.from_file(PATHS[0])
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    links, out = [], []
    for i, text in rows:
        a, b = (a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)) if text else ([], [])
        bytes_a = [bytes(letter[c] for c in a_model.id_to_token(t)) for t in a]
        names = [b_model.id_to_piece(t) for t in b]
        bytes_b = [bytes([int(n[3:5], 16)]) if b_model.is_byte(t) else n.replace("▁", " ").encode() for t, n in zip(b, names, strict=True)]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == b" " + text.encode():
            links.append(collections.Counter())
            out.append((i, 0, 0, 0, ""))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
        cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        groups = [([], []) for _ in cuts]
        for t, g in zip(a, group_a, strict=True):
            groups[g][0].append(t)
        for t, g in zip(b, group_b, strict=True):
            groups[g][1].append(t)
        links.append(collections.Counter((x, y) for left, right in groups for x in left for y in right))
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(a), len(b), len(groups), hashlib.sha256(line.encode()).hexdigest()))
    count = collections.Counter(pair for each in links for pair in each)
    highest: dict[int, int] = {}
    for (x, _), n in count.items():
        highest[x] = max(n, highest.get(x, 0))
    return [
        (i, n_a, n_b, n_groups, sum(own.values()), sum(n for p, n in own.items() if count[p] == highest[p[0]]),
         sum(n * count[p] for p, n in own.items()), digest)
        for (i, n_a, n_b, n_groups, digest), own in zip(out, links, strict=True)
    ]


def same(found, want) -> None:
    assert sorted(map(repr, found)) == sorted(map(repr, want))


def test_query(spark, folder, rows):
    found = QUERIES["op12_alignment"](spark, folder).collect()
    same([tuple(r) for r in found], expected([(r[0], r[1]) for r in rows]))
    assert any(r.n_groups < min(r.n_a, r.n_b) for r in found)


def test_odd_texts(spark):
    rows = [(None if i == 3 else i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, block int, codes int").repartition(3)
    same([tuple(r) for r in align(docs, *PATHS).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()], expected(rows))


def test_chunks_are_independent(spark):
    """Results from chunks are those of the libraries on whole texts of letters that mix every kind of character."""
    r = random.Random(5)
    letters = "ab Z09 .,'éßñ\n\t  ɏɐ日😀  ́▁<>_-"
    rows = [(i, "".join(r.choices(letters, k=r.randint(1, 60)))) for i in range(1500)]
    found = align(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), *PATHS)
    same([tuple(x) for x in found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()], expected(rows))


def test_table_starts_again():
    chunks = Chunks(*PATHS)
    first = chunks.block(["one two two", "three  four"])
    chunks.clear()
    again = chunks.block(["one two two", "three  four"])
    assert first[0]["groups_sha256"] == again[0]["groups_sha256"] and first[1].tolist() == again[1].tolist()
    assert chunks.block([None, ""])[0]["groups_sha256"] == ["", ""]


@pytest.mark.parametrize("seed", range(40))
def test_common_ends(seed):
    r = random.Random(seed)
    total = r.choice([1, 2, 7, 64, 300])
    share = r.choice([0.1, 0.5, 0.9, 1.0])
    left, right = (sorted({total, *[e for e in range(1, total) if r.random() < share]}) for _ in range(2))
    if seed % 3 == 0:
        right = left[:] if seed % 2 else [*range(1, total + 1)]
    a, b = common_ends(left, right)
    both = sorted(set(left) & set(right))
    assert a.tolist() == [left.index(e) + 1 for e in both] and b.tolist() == [right.index(e) + 1 for e in both]
    assert [x.tolist() for x in common_ends([], [])] == [[], []]
