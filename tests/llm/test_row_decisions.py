from __future__ import annotations

import collections

import pytest

from lakedupes.llm import quality
from lakedupes.llm.decontaminate import drop_contaminated
from lakedupes.llm.paragraphs import repeated_paragraphs
from lakedupes.llm.piece_tokens import encode_decode
from lakedupes.llm.queries import tokenizer_path
from lakedupes.llm.minhash_forest import keep_one, near_duplicates
from lakedupes.llm.quality import keep_good

ROWS = "doc_id long, text string, _rid long"
long_text = lambda word, n=60: " ".join(f"{word}{i}" for i in range(n))
changed = lambda word: long_text(word).replace(f"{word}59", "other")


def texts(df) -> list:
    return sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in df.collect())


def test_keep_good_goes_by_text(spark, monkeypatch):
    class Model:
        def score(self, x):
            return (x[:, quality.STATISTICS.index("upper")] < 0.5).astype(float)

    monkeypatch.setattr(quality, "fit", lambda *args: Model())
    docs = spark.createDataFrame(
        [(None, "GOES AWAY", 1), (None, "stays here", 2), (7, "GOES TOO", 3), (7, "stays too", 4), (8, "stays", 5), (None, None, 6)], ROWS
    )
    labels = spark.createDataFrame([(8, 1)], "doc_id long, quality int")
    assert sorted(r._rid for r in keep_good(docs, labels).collect()) == [2, 4, 5, 6]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([
        (1, long_text("a"), 1), (None, long_text("a"), 2), (None, long_text("b"), 3),  # a null id copies 1; b is clean
        (None, long_text("c"), 4), (None, long_text("c"), 5), (None, changed("c"), 6),  # copies among null ids only
        (2, long_text("d"), 7), (2, long_text("d"), 8),  # equal rows
        (3, long_text("e"), 9), (3, long_text("f"), 10), (4, changed("f"), 11), (5, changed("e"), 12),  # two texts of one id
        (None, "", 13), (None, None, 14),
    ], ROWS)


def test_keep_one_keeps_one_row_of_each_group(docs):
    found = keep_one(docs)
    assert found.columns == docs.columns
    got = [r._rid for r in found.collect()]
    assert len(got) == len(set(got)) and {1, 3, 9, 10, 13, 14} <= set(got)
    groups = collections.Counter(next(g for g in ("a1", "b1", "c1", "d1", "e1", "f1") if g in r.text) for r in found.where("text > ''").collect())
    assert groups == dict.fromkeys(("a1", "b1", "c1", "d1", "e1", "f1"), 1)


def test_components_of_repeated_ids(docs):
    got = collections.Counter((r.doc_id, r.component_id) for r in near_duplicates(docs, 5, 80).collect())
    assert got[3, 3] == 2 and got[4, 3] == 1 and got[5, 3] == 1 and got[None, 1] == 1 and got[2, 2] == 2


def test_columns_of_the_caller_stay(spark, monkeypatch):
    """Names that the stages use inside, and names with dots, are the caller's own."""
    names = ["_tkey", "_gone", "_twice", "_rid", "a.b", "c`d"]
    docs = spark.createDataFrame(
        [(1, long_text("a"), *names), (2, long_text("a"), *names), (2, long_text("a"), *names), (3, long_text("b"), *names)], ["doc_id", "text", *names]
    )
    benchmark = spark.createDataFrame([(1, " ".join(long_text("b").split()[5:30]))], "item_id long, text string")
    monkeypatch.setattr(quality, "fit", lambda *args: None)
    labels = spark.createDataFrame([(8, 1)], "doc_id long, quality int")
    steps = {
        "good": (keep_good(docs, labels), [1, 2, 2, 3]), "one": (keep_one(docs), [1, 3]),
        "clean": (drop_contaminated(docs, benchmark), [1, 2, 2]), "ids": (encode_decode(docs, tokenizer_path()), [1, 2, 2, 3]),
    }
    for done, want in steps.values():
        found = done.collect()
        assert sorted(r.doc_id for r in found) == want and done.columns[:8] == docs.columns
        assert all(list(r[2:8]) == names for r in found)


def test_paragraphs_of_repeated_ids(spark):
    """Twelve ids with two texts each, and a near copy of every text: all copies are found."""
    rows = []
    for i in range(12):
        for part in "xy":
            word = f"{part}{chr(97 + i)}"
            rows += [(i, long_text(word)), (100 + 2 * i + (part == "y"), changed(word))]
    found = repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    copies = {r.doc_id: (len(r.removed), r.copies_of) for r in found if r.doc_id >= 100}
    assert copies == {100 + 2 * i + k: (1, [i]) for i in range(12) for k in range(2)}


def test_far_texts_keep_the_share_of_labels():
    """Far from every labelled text the score is the share of good labels, near them it is the calibrated one."""
    import numpy as np

    d = len(quality.STATISTICS)
    model = quality.Model(
        np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.array([0.0, 0.2]), -np.ones(d), np.ones(d), 0.7,
        np.array([0.0, 1.0]), np.array([0.0, 1.0]),
    )
    x = np.zeros((3, d))
    x[1, 0], x[2, 0] = 3.0, 1e6
    near, between, far = model.score(x)
    assert abs(near - 0.2) < 1e-9 and abs(far - 0.7) < 1e-9 and near < between < far


@pytest.mark.parametrize("share", [0.75, 0.8])
def test_links_around_a_hub(spark, share):
    """Copies of one text just below the threshold, some linked among each other only through what they have beyond it."""
    import itertools
    import random

    r = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(24):
        words = base[:]
        for at in r.sample(range(len(words)), 4 + k % 5):
            words[at] = f"x{r.randrange(6)}"
        tail = [f"t{k // 3}n{i}" for i in range(12)]
        rows.append((k, " ".join(words + tail)))
    sets = {i: {tuple(t.split()[a:a + 5]) for a in range(len(t.split()) - 4)} for i, t in rows}
    root = dict(zip(sets, sets, strict=True))
    for i, j in itertools.combinations(sets, 2):
        if 100 * len(sets[i] & sets[j]) >= int(share * 100) * len(sets[i] | sets[j]):
            low, high = sorted((root[i], root[j]))
            root = {k: low if v == high else v for k, v in root.items()}
    found = {x.doc_id: x.component_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, int(share * 100)).collect()}
    assert found == root
