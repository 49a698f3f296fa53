from __future__ import annotations

import collections
import random

from lakedupes.llm.shards import shard_rows

SCHEMA = "doc_id long, text string"


def cut_links(found: list, text: dict[int, str]) -> float:
    """The share of pairs of equal texts that lie in different shards."""
    groups = collections.defaultdict(collections.Counter)
    for r in found:
        groups[text[r.doc_id]][r.shard] += 1
    pairs = lambda n: n * (n - 1) // 2
    whole = sum(pairs(sum(g.values())) for g in groups.values())
    return 1 - sum(pairs(n) for g in groups.values() for n in g.values()) / whole


def test_groups_that_fit_stay_whole(spark):
    r = random.Random(8)
    rows, n = [], 0
    for g in range(580):
        for _ in range(r.choice((2, 2, 2, 3, 5, 25))):
            rows.append((n, f"group {g}"))
            n += 1
    rows += [(n + i, f"alone {i}") for i in range(6000)]
    found = shard_rows(spark.createDataFrame(rows, SCHEMA)).collect()
    sizes = collections.Counter(r.shard for r in found)
    assert len(found) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    assert cut_links(found, dict(rows)) <= 0.01


def test_result_does_not_follow_the_files(spark):
    r = random.Random(9)
    rows = [(i % 350 if i % 50 else None, f"text {r.randrange(200)}") for i in range(400)] + [(None, None)] * 120
    docs = spark.createDataFrame(rows, SCHEMA)
    a, b = (sorted(map(repr, shard_rows(d, 5).collect())) for d in (docs.repartition(3), docs.orderBy("text").coalesce(1)))
    assert a == b
