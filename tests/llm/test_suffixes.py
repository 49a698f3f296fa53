from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lakedupes.llm.language import ORDER, _grams, grow, identify, sampled
from lakedupes.llm.quality import isotonic
from lakedupes.llm.suffix_sort import common_prefixes, two_stage_order

DEPTH = 5


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0, 1, 97, 98, 255]), min_size=DEPTH, max_size=14).map(bytes), min_size=1, max_size=12))
def test_two_stage_order(texts):
    data = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts])
    order = two_stage_order(data, lengths, lengths - DEPTH + 1, DEPTH)
    keys = [data[i:i + DEPTH].tobytes() for i in order]
    starts = np.cumsum(lengths) - lengths
    assert keys == sorted(keys)
    assert sorted(order) == [s + k for s, n in zip(starts, lengths, strict=True) for k in range(n - DEPTH + 1)]
    prefixes = common_prefixes(data, order, DEPTH)
    assert [p == DEPTH for p in prefixes[1:]] == [a == b for a, b in zip(keys, keys[1:], strict=False)]


@given(st.lists(st.floats(-5, 5), min_size=1, max_size=30))
def test_isotonic(values):
    out = isotonic(np.array(values), np.ones(len(values)))
    assert len(out) == len(values) and np.all(np.diff(out) >= -1e-12)
    assert abs(out.sum() - sum(values)) < 1e-6


def test_code_lengths():
    """Against the definition, byte by byte, in two languages that know different bytes."""
    import pandas as pd
    import pyarrow as pa

    train = {"x": ["abracadabra", "abba"], "y": ["дом, сад 12", "abra日本"]}
    tables, seen = [], {}
    for lang, texts in train.items():
        gram, _ = _grams(pa.array(texts))
        values, n = np.unique(gram, return_counts=True)
        tables.append(pd.DataFrame({"lang": lang, "gram": values.astype(np.int64), "n": n}))
        padded = [b" " * ORDER + t.encode() for t in texts]
        seen[lang] = [p[k - ORDER:k + 1] for p in padded for k in range(ORDER, len(p))]
    trees = grow(pd.concat(tables))

    def cost(seen: list[bytes], context: bytes, symbol: int) -> float:
        here = [s[-1] for s in seen if s[:-1].endswith(context)]
        lower = cost(seen, context[1:], symbol) if context else 8.0
        if not here:
            return lower
        whole = len(here) + len(set(here))
        return -np.log2(here.count(symbol) / whole) if symbol in here else -np.log2(len(set(here)) / whole) + lower

    test = ["abra", "zebra", "", "cab abba", "садовод", "本日 12\x00", "\U0010ffff"]
    got = trees.bits(pa.array(test))
    for column, lang in enumerate(trees.languages):
        padded = [b" " * ORDER + t.encode() for t in test]
        want = [sum(cost(seen[lang], p[k - ORDER:k], p[k]) for k in range(ORDER, len(p))) for p in padded]
        assert np.allclose(got[:, column], want, atol=1e-3)


def test_scripts_are_told_apart(spark):
    """Languages of other scripts, whose bytes are rare beside those of a large language."""
    words = {
        "en": "the cat sat on a mat", "ru": "мама мыла раму дом сад", "uk": "її ґанок є дім їжак", "el": "το σπίτι είναι μεγάλο",
        "ja": "これは日本語の文です", "ko": "이것은 한국어 문장", "ar": "هذا نص باللغة العربية", "he": "זה טקסט בעברית", "hi": "यह हिन्दी का वाक्य है",
    }
    r = np.random.default_rng(1)
    text = lambda w: " ".join(r.permutation(w.split() * 3)) if " " in w else w[r.integers(3):] * 2
    rows = [(i, lang if i % 4 else None, text(w)) for i, (lang, w) in enumerate((k, v) for _ in range(30) for k, v in words.items())]
    rows += [(1000 + i, "en", text(words["en"])) for i in range(600)]
    got = {x.doc_id: x.lang_pred for x in identify(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()}
    truth = {i: list(words)[i % len(words)] for i in range(30 * len(words))}
    assert all(got[i] == lang for i, lang in truth.items())


def test_every_language_is_sampled(spark):
    """However small the share, one text of each language is drawn; copies count once, and the bytes are bounded."""
    rows = [("a", f"{i} " + "x" * 100) for i in range(2000)] + [("a", "copy " * 20)] * 1000
    rows += [("b", "y" * 50_000), ("c", "only one"), ("d", ""), ("d", None)]
    got = sampled(spark.createDataFrame(rows, "lang string, text string"), 2_000).collect()
    assert {r.lang for r in got} == {"a", "b", "c"} and len(set(got)) == len(got)
    assert 1 <= sum(r.lang == "a" for r in got) <= 60
    few = sampled(spark.createDataFrame(rows, "lang string, text string"), 1).groupBy("lang").count().collect()
    assert sorted((r.lang, r["count"]) for r in few) == [("a", 1), ("b", 1), ("c", 1)]
