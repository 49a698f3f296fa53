from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakedupes.llm import neighbours
from lakedupes.llm.neighbours import LEAST_PARTITIONS, PARTITION_ROWS, SAMPLE_ROWS, Router, learn, nearest

VECTORS = "vec_id long, embedding array<double>"


def ranked(df) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_repeated_rows_use_one_place(spark):
    x = np.random.default_rng(2).normal(size=(60, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    copies = rows + [rows[i] for i in range(1, 6) for _ in range(30)] + rows
    near = lambda data: ranked(nearest(spark.createDataFrame(data, VECTORS), F.col("vec_id") % 20 == 0, k=20))
    got = near(copies)
    assert got == near(rows) and sorted(got) == [0, 20, 40]
    for q, ids in got.items():
        assert ids == [i for i in np.argsort(-(x @ x[q]), kind="stable").tolist() if i != q][:20]


def test_visits_go_on_until_there_are_enough(spark, monkeypatch):
    # Ten vectors along each of eight axes, and a router that visits the likeliest axis only.
    rows = [(i, [float(10 + i / 100 if a == i % 8 else 0.1) for a in range(8)]) for i in range(80)]
    router = Router(np.vstack([50 * np.eye(8), np.zeros(8)]), 1)
    monkeypatch.setattr(neighbours, "learn", lambda *args: router)
    got = ranked(nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") < 4, k=20))
    assert [len(got[q]) for q in range(4)] == [20] * 4
    assert all({i for i in range(80) if i % 8 == q} - {q} <= set(got[q]) for q in range(4))
    assert len(ranked(nearest(spark.createDataFrame(rows[:15], VECTORS), F.col("vec_id") < 1, k=20))[0]) == 14


def test_routed_goes_on_by_rows():
    chances = np.array([[0.7, 0.2, 0.1]])
    visits = lambda *args: Router(np.zeros((2, 3))).routed(chances, 1, *args).tolist()
    assert visits() == [[True, False, False]]
    assert visits(np.array([5, 16, 9]), 21) == [[True, True, False]]
    assert visits(np.array([5, 15, 9]), 21) == [[True, True, True]]


@pytest.mark.parametrize("spread", [0.08, 0.15])
def test_queries_are_routed(spread):
    """40,000 vectors in 200 clusters: a recall of 0.95 or more for less than a third of the table."""
    r = np.random.default_rng(3)
    middle = r.normal(size=(200, 64))
    middle /= np.linalg.norm(middle, axis=1, keepdims=True)
    x = middle[r.integers(200, size=40_000)] + spread * r.normal(size=(40_000, 64))
    router = learn(x[r.permutation(len(x))[:SAMPLE_ROWS]], max(LEAST_PARTITIONS, len(x) // PARTITION_ROWS), 20, len(x))
    home = router.chances(x).argmax(axis=1)
    held = np.bincount(home, minlength=router.weights.shape[1])
    queries = np.arange(0, len(x), 40)
    visit = router.routed(router.chances(x[queries]), router.probes, held, 21)
    scores = x[queries] @ x.T
    scores[np.arange(len(queries)), queries] = -np.inf
    near = np.argpartition(-scores, 20, axis=1)[:, :20]
    assert np.take_along_axis(visit, home[near], 1).mean() >= 0.95
    assert (visit @ held).mean() / len(x) <= 0.3
    assert held.max() <= 3 * len(x) / len(held)


def test_partitions_follow_the_table(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(neighbours, "learn", lambda x, parts, k, total: asked.append((len(x), parts, total)) or learn(x[:50], 1, k))
    monkeypatch.setattr(neighbours, "PARTITION_ROWS", 40)
    monkeypatch.setattr(neighbours, "SAMPLE_PER_PARTITION", 8)
    for n in (300, 2400):
        x = np.random.default_rng(n).normal(size=(n, 8))
        nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS), F.col("vec_id") % 100 == 0, 5).collect()
    assert asked == [(300, 32, 300), (2400, 60, 2400)]
