"""Spelling variants against plain Python over all pairs of words."""

from __future__ import annotations

import collections
import random
import re
import zlib

import pytest

from lakedupes.llm import spellings
from lakedupes.llm.queries import QUERIES


def near(x: str, y: str) -> bool:
    """Exactly one inserted, deleted or replaced letter."""
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    return len(y) - len(x) == 1 and any(y[:i] + y[i + 1:] == x for i in range(len(y)))


def words_of(rows) -> dict[str, int]:
    count = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def expected(rows) -> list[tuple]:
    n = words_of(rows)
    mates = {w: [v for v in n if abs(len(v) - len(w)) < 2 and near(w, v)] for w in n}
    form = {}
    for w, others in mates.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(mates[w]), n[form[w]] if form[w] else None))
    return out


def corpus() -> list[tuple[int | None, str | None]]:
    """Families of near words of every length from 4 on, chains of forms, ties, and words that are damaged."""
    r = random.Random(8)
    rows: list[tuple[int | None, str | None]] = [(None, None), (1, ""), (2, "12 34 ... x"), (None, "lonely lonely lonely")]
    letters = "abcdeéßÿ×÷à"
    stems = ["".join(r.choices(letters, k=k)) for k in (4, 5, 5, 6, 7, 8, 9, 12, 20, 63, 64, 65, 70, 200)] + ["aaaaa", "aaaaaa", "ababab", "intern", "internal"]
    for stem in stems:
        for step in range(18):
            at = r.randrange(len(stem))
            word = [stem[:at] + r.choice(letters) + stem[at + 1:], stem[:at] + stem[at + 1:], stem[:at] + r.choice(letters) + stem[at:]][step % 3]
            rows.append((10 + step, " ".join([word] * r.choice([2, 3, 6, 6, 13]) + [stem.upper()] * (step % 2))))
    rows += [(50, "chaina " * 40), (51, "chainb " * 20), (52, "bchainb " * 10), (53, "bchainbb " * 5), (54, "Chaina " * 9)]
    rows += [(i, "repeat damage colour color COLOUR") for i in range(60, 400)]
    return rows


@pytest.mark.parametrize("size", [spellings.LETTERS, 200, 30])
def test_variants(spark, monkeypatch, size):
    """The same result whether all words fit one block or hot halves are cut into tiles."""
    monkeypatch.setattr(spellings, "LETTERS", size)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 3, "w") for i, t in rows], "doc_id long, text string, n int, word string")
    found = spellings.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = expected(rows)
    assert sorted(map(repr, (tuple(r) for r in found))) == sorted(map(repr, want))
    assert len(want) > 150 and sum(w[1] is not None and w[2] != w[1] for w in want) > 3


def test_query(spark, folder, rows):
    found = QUERIES["op13_spellings"](spark, folder).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(repr, (tuple(r) for r in found))) == sorted(map(repr, expected([(r[0], r[1]) for r in rows])))


def test_index_all_pairs():
    r = random.Random(2)
    words = sorted({"".join(r.choices("abc", k=r.randint(1, 6))) for _ in range(400)})
    left, right = spellings.Index([w.encode() for w in words]).near()
    got = {(words[a], words[b]) for a, b in zip(left.tolist(), right.tolist(), strict=True)}
    assert got == {(x, y) for x in words for y in words if near(x, y)} and len(left) == len(got)
