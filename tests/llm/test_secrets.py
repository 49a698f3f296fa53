from __future__ import annotations

import itertools
import math
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from lakedupes.llm.secrets import (
    ACCESS_PATTERN,
    ASSIGN_PATTERN,
    ENCODINGS,
    HEX_PATTERN,
    KINDS,
    TOKEN_PATTERN,
    class_cuts,
    find_secrets,
    redact,
)


def lost(n: int, others: dict, rounds: int = 200) -> float:
    """The share of ``n`` uniform p-values in a class that its cut drops."""
    r, gone = np.random.default_rng(n), 0
    for _ in range(rounds):
        p = r.random(n)
        own = np.bincount((p * 100).astype(int), minlength=100).astype(float)
        gone += (p < class_cuts({**others, (32, 1): own})[32, 1]).sum()
    return gone / n / rounds


def test_random_tokens_are_kept_in_classes_of_any_size():
    many = np.full(100, 50.0)
    many[0] += 3000
    for others in ({}, {(16, 2): many}):
        assert all(lost(n, others) < 0.08 for n in (1, 2, 3, 5, 10, 30, 100, 1000))


def test_other_tokens_raise_the_cut():
    words = np.zeros(100)
    words[:40] = 25.0
    assert class_cuts({(62, 0): words, (16, 2): np.full(100, 10.0)})[62, 0] >= 0.3


def test_lone_tokens_are_found(spark):
    r = random.Random(3)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    docs = [(i, "plain words " * 20) for i in range(30)]
    docs.append((50, "key " + "".join(r.choices(alphabet, k=32)) + " end"))
    docs.append((51, "not " + "A2" * 16 + " end"))
    found = {d.doc_id: d.spans for d in find_secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [(s.start, s.end, s.kind) for s in found[50]] == [(4, 36, "random")]
    assert not any(found[i] for i in found if i != 50)


TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def tail(z: float) -> float:
    t = 1 / (1 + 0.2316419 * abs(z))
    upper = math.exp(-z * z / 2) * 0.3989422804014327 * sum(c * t**i for i, c in enumerate(TAIL, 1))
    return upper if z >= 0 else 1 - upper


def judged(token: str) -> tuple[int, int, float] | None:
    """Alphabet size, length class and p-value of one token, from the definitions of the three tests."""
    if re.fullmatch("[A-Za-z]+|[0-9]+", token):
        return None
    letters = next((a for pattern, a in ENCODINGS if re.fullmatch(pattern, token)), None)
    if letters is None:
        return None
    k, n, x = len(letters), len(token), [letters.index(c) for c in token]
    chi = sum((x.count(v) - n / k) ** 2 / (n / k) for v in range(k))
    normal = ((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
    turns = sum((a * 2 >= k) != (b * 2 >= k) for a, b in itertools.pairwise(x))
    runs = abs(turns - (n - 1) / 2) / math.sqrt((n - 1) / 4)
    product = sum((a - (k - 1) / 2) * (b - (k - 1) / 2) for a, b in itertools.pairwise(x))
    serial = abs(product / ((k * k - 1) / 12 * math.sqrt(n - 1)))
    half = -sum(math.log(max(p, 1e-300)) for p in (tail(normal), 2 * tail(runs), 2 * tail(serial)))
    return k, sum(n >= at for at in (28, 40, 64)), math.exp(-half) * (1 + half + half * half / 2)


def expected(texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """All spans by plain search: every pair of spans is compared."""
    tests = [[(m.span(), judged(m[0])) for m in re.finditer(TOKEN_PATTERN, t)] for t in texts]
    counts: dict = {}
    for _, found in itertools.chain(*tests):
        if found:
            k, longer, p = found
            counts.setdefault((k, longer), np.zeros(100))[min(int(p * 100), 99)] += 1
    cut, out = class_cuts(counts), []
    for text, tokens in zip(texts, tests, strict=True):
        assigned = [m.span() for m in re.finditer(ASSIGN_PATTERN, text, re.ASCII) if len(m[1]) >= 12]
        spans = [(a, 0, b) for a, b in assigned]
        spans += [(*m.span()[:1], i, m.end()) for i, pattern in ((1, ACCESS_PATTERN), (2, HEX_PATTERN)) for m in re.finditer(pattern, text)]
        base = list(spans)
        for (a, b), found in tokens:
            if found and found[2] >= cut[found[:2]] and not any(s < b and a < e for s, _, e in base):
                spans.append((a, 3, b))
        out.append([(a, b, (*KINDS, "random")[i]) for a, i, b in sorted(spans)])
    return out


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], "[secret]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def odd_texts(r: random.Random) -> list[str]:
    """Tokens of all encodings among words, wide characters and base spans that touch or overlap them."""
    def part() -> str:
        _, letters = r.choice(ENCODINGS)
        token = "".join(r.choices(letters, k=r.randint(12, 70)))
        return r.choice([
            token, token, "pass" * 6, "é😀日本", "word", "1" * 25, "abcabc123" * 4, "AKIA" + "Z9" * 8, "PassWord = " + token,
            'api_key: "' + token, "token=" + token + "/" + token, "AKIA" + "A" * 14 + token, "f" * 16 + token,
        ])

    return ["", " ", *[r.choice([" ", "\n", "", "日"]).join(part() for _ in range(r.randint(1, 40))) for _ in range(60)]]


def test_all_spans_and_masks_equal_plain_search(spark):
    texts = odd_texts(random.Random(11))
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)] + [(-1, None, None)], "doc_id int, text string, n_chars long")
    want = expected([*texts, ""])
    assert sum(kind == "random" for spans in want for *_, kind in spans) > 50
    found = {d.doc_id: [tuple(s) for s in d.spans] for d in find_secrets(docs).collect()}
    assert found == {**{i: w for i, w in enumerate(want[:-1])}, -1: []}
    clean = {d.doc_id: (d.text, d.n_chars) for d in redact(docs).collect()}
    after = [masked(t, w) for t, w in zip(texts, want, strict=False)]
    assert clean == {**{i: (t, len(t)) for i, t in enumerate(after)}, -1: (None, None)}


def test_many_matches_in_one_text(spark):
    """A log of 100,000 tokens: the time must not grow with their square (it would take an hour)."""
    r = random.Random(5)
    text = "\n".join(f"é{r.getrandbits(128):032x}" for _ in range(100_000))
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    began = time.monotonic()
    spans = find_secrets(docs).select(F.size("spans"), F.element_at("spans", -1)["end"]).first()
    assert tuple(spans) == (100_000, len(text))
    assert redact(docs).first().text == "\n".join(["é[secret]"] * 100_000)
    assert time.monotonic() - began < 120
