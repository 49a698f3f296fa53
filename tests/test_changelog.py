"""The index read through a change log, and counts that follow changes."""

from __future__ import annotations

import datetime as dt
import random

import lakedupes as ld
from lakedupes.operators import counts
from lakedupes.operators.index import classified, index_of
from lakedupes.sinks import changelog
from lakedupes.streaming.upkeep import listing_stream
from tests.conftest import DAY, rows
from tests.test_streaming import EVENTS, page


def changes(spark, *notes):
    """Rows (key, size, etag, day, deleted)."""
    full = [("b", k, s, e, False, None if d is None else dt.datetime(2024, 1, d), gone) for k, s, e, d, gone in notes]
    return spark.createDataFrame(full, changelog.CHANGES)


def test_batches_are_merged_in_order(spark, make, tmp_path):
    path = str(tmp_path / "index")
    changelog.start_log(
        make.objects(("same", 1, "e", False, "h"), ("changed", 1, "e", False, "h"), ("gone", 1, "e"), ("back", 1, "e")),
        make.media(*[(k, "A", "S") for k in ("same", "changed", "gone", "back")]), path,
    )
    index, media = changelog.read_merged(spark, path)
    assert rows(index, "key") == ["same", "changed", "gone", "back"] and media.count() == 4
    changelog.append_changes(changes(spark, ("same", 1, "e", 2, False), ("changed", 1, "f", 2, False), ("back", None, None, 2, True), ("changed", 9, "x", 1, False)), path, 1)
    changelog.append_changes(changes(spark, ("changed", 2, "g", 1, False), ("gone", None, None, None, True), ("gone", 3, "q", 4, False), ("back", 5, "z", 3, None), ("new", 7, "n", 3, False)), path, 2)

    def state():
        index, media = changelog.read_merged(spark, path)
        return rows(index, "key", "size", "etag", "sha256"), rows(media, "key")

    want = [("same", 1, "e", "h"), ("changed", 2, "g", None), ("back", 5, "z", None), ("new", 7, "n", None)], ["same"]
    assert state() == want
    # A batch that runs again replaces itself; one that died half-way is not read.
    changelog.append_changes(changes(spark, ("changed", 2, "g", 1, False), ("gone", None, None, None, True), ("back", 5, "z", 3, None), ("new", 7, "n", 3, False)), path, 2)
    changes(spark, ("same", None, None, 9, True)).write.parquet(f"{path}/log/seq=000000000003")
    (tmp_path / "index/log/seq=000000000003/_SUCCESS").unlink()
    assert state() == want
    assert not changelog.compact(spark, path, share=5.0)
    assert changelog.compact(spark, path, share=0.5) and not changelog.compact(spark, path, share=0.0)
    assert state() == want
    changelog.append_changes(changes(spark, ("new", None, None, 1, True)), path, 4)
    assert state() == ([w for w in want[0] if w[0] != "new"], want[1])


def test_follow_log_equals_replay(spark, make, tmp_path):
    """Random pages, followed as a stream and compacted now and then, equal the last change of each key."""
    r = random.Random(6)
    path, pages = str(tmp_path / "index"), str(tmp_path / "pages")
    start = [(f"k{i}", 1, f"e{i}", False, f"h{i}") for i in range(20)]
    changelog.start_log(make.objects(*start), make.media(*[(k, "A", "S") for k, *_ in start]), path)
    live = {k: (s, e, h) for k, s, e, _, h in start}
    tagged = set(live)
    for turn in range(4):
        notes = []
        for key in r.sample([f"k{i}" for i in range(30)], 9):
            gone = r.random() < 0.3
            size, etag = live[key][:2] if key in live and r.random() < 0.3 else (turn + 2, f"n{turn}")
            notes.append((key, size, None if gone else etag, turn + 2, gone))
        page(spark, pages, *notes)
        changelog.follow_log(listing_stream(spark, pages, bucket="b", schema=EVENTS), path, str(tmp_path / "c"), share=0.6).awaitTermination()
        for key, size, etag, _, gone in notes:
            if gone:
                live.pop(key, None)
                tagged.discard(key)
            elif key not in live or live[key][1] != etag:
                live[key] = (size, etag, None)
                tagged.discard(key)
        index, media = changelog.read_merged(spark, path)
        assert rows(index, "key", "size", "etag", "sha256") == [(k, *v) for k, v in live.items()]
        assert rows(media, "key") == list(tagged)


def test_log_needs_a_start(spark, tmp_path):
    import pytest

    with pytest.raises(ValueError, match="start_log"):
        changelog.read_merged(spark, str(tmp_path / "nothing"))


def test_counts_follow_scans_and_hashes(spark, make):
    r = random.Random(3)

    def some(n, day):
        return [(f"k{r.randrange(40)}", r.choice([1, 2]), f"e{r.randrange(5)}", r.random() < 0.3, r.choice([None, "s1", "s2"]), day) for _ in range(n)]

    unique = lambda notes: list({n[0]: n for n in notes}.values())
    index = make.objects(*unique(some(40, DAY)))
    kept = counts.group_counts(index)
    for turn in range(3):
        listing = make.objects(*unique(some(30, DAY + dt.timedelta(days=turn)))).drop("sha256", "scanned_at")
        changed = classified(index, listing, "k" if turn else "k1")
        kept, index = counts.counts_after_scan(kept, changed), ld.conform(index_of(changed), ld.OBJECTS)
        index = spark.createDataFrame(index.collect(), ld.OBJECTS)
        hashes = spark.createDataFrame(
            [("b", f"k{i}", r.choice([None, "s1", "s3"])) for i in range(0, 40, 3)], "bucket string, key string, sha256 string"
        )
        kept = counts.counts_after_hashing(kept, index, hashes)
        index = spark.createDataFrame(ld.update_sha256(index, hashes).collect(), ld.OBJECTS)
        kept = spark.createDataFrame(kept.collect(), kept.schema)
        assert rows(kept) == rows(counts.group_counts(index))
        assert rows(counts.stats_of_counts(kept)) == rows(ld.scan_stats(index))
    assert rows(counts.stats_of_counts(kept.where("false"))) == [(0, 0, 0, 0, 0)]


def test_folder_counts_follow_moves(spark, make):
    keys = make.keys("a /x", "a /y", "b/ c/x", "b/d", "e/f ", "e/g", "h /i/j ", "top ")
    resolved = ld.plan_renames(keys, ("strip-spaces",))
    kept = counts.folder_counts(keys)
    assert rows(counts.emptied_by_counts(kept, resolved)) == rows(ld.emptied_folders(resolved, keys))
    assert rows(counts.folders_after_rename(kept, resolved)) == rows(counts.folder_counts(ld.keys_after_rename(resolved, keys)))


def test_counted_folders_explode_moved_keys_only(spark, make):
    keys = make.keys("a /x", "b/y")
    kept = spark.createDataFrame(counts.folder_counts(keys).collect(), "bucket string, dir string, n long")
    resolved = spark.createDataFrame(ld.plan_renames(keys, ("strip-spaces",)).collect(), ld.plan_renames(keys, ("strip-spaces",)).schema)
    plan = counts.emptied_by_counts(kept, resolved)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2  # old key and target of a move, and their folders
