from __future__ import annotations

import datetime as dt

from pyspark.sql import types as T

import lakedupes as ld
from lakedupes.schema import LISTING
from lakedupes.sinks.tables import read_snapshot, write_snapshot
from lakedupes.streaming.upkeep import fold_changes, follow, listing_stream, log_changes
from lakedupes.streaming.runs import PAGES, log_missing, with_pages
from tests.conftest import Bag, rows

EVENTS = T.StructType([*LISTING, T.StructField("deleted", T.BooleanType())])


def page(spark, path, *notes):
    full = [(k, s, e, dt.datetime(2024, 1, d), gone) for k, s, e, d, gone in notes]
    spark.createDataFrame(full, EVENTS).coalesce(1).write.mode("append").parquet(path)


def test_log_and_fold(spark, make, tmp_path):
    pages, log = str(tmp_path / "pages"), str(tmp_path / "log")
    index = make.objects(("same", 1, "e", False, "h"), ("changed", 1, "e", False, "h"),
                         ("gone", 1, "e"), ("back", 1, "e"))
    media = make.media(*[(k, "A", "S") for k in ("same", "changed", "gone", "back")])
    page(spark, pages, ("same", 1, "e", 2, None), ("changed", 1, "f", 2, None),
         ("back", None, None, 2, True), ("empty", 0, "x", 2, None))
    stream = listing_stream(spark, pages, bucket="b", schema=EVENTS)
    log_changes(stream, log, str(tmp_path / "c")).awaitTermination()
    page(spark, pages, ("changed", 2, "g", 3, None), ("gone", None, None, 3, True),
         ("back", 5, "z", 3, None), ("new", 7, "n-2", 3, None))
    log_changes(stream, log, str(tmp_path / "c")).awaitTermination()

    changes = spark.read.parquet(log)
    assert changes.count() == 7
    objects, tags = fold_changes(index, media, changes)
    assert rows(objects, "key", "size", "etag", "sha256", "is_multipart") == [
        ("same", 1, "e", "h", False), ("changed", 2, "g", None, False),
        ("back", 5, "z", None, False), ("new", 7, "n-2", None, True),
    ]
    assert rows(tags, "key") == ["same"]


def test_follow_writes_one_version_per_batch(spark, make, tmp_path):
    pages, base, tags = (str(tmp_path / n) for n in ("pages", "index", "media"))
    write_snapshot(make.objects(("a", 1, "e", False, "h")), base, 0)
    write_snapshot(make.media(("a", "A", "S")), tags, 0)
    page(spark, pages, ("a", 1, "e", 2, None), ("b", 2, "f", 2, None))
    stream = listing_stream(spark, pages, bucket="b")
    follow(stream, base, tags, str(tmp_path / "c")).awaitTermination()
    assert rows(read_snapshot(spark, base, 1), "key", "sha256") == [("a", "h"), ("b", None)]
    page(spark, pages, ("a", 3, "g", 3, None))
    follow(stream, base, tags, str(tmp_path / "c")).awaitTermination()
    assert rows(read_snapshot(spark, base, 2), "key", "size") == [("a", 3), ("b", 2)]
    assert rows(read_snapshot(spark, tags, 2), "key") == []
    # Running a batch again gives the same version from the same input.
    assert rows(read_snapshot(spark, base, 1), "key", "size") == [("a", 1), ("b", 2)]


def test_end_to_end(spark, make, tmp_path):
    listing = [("music/a.mp3", 5, "e"), ("music/b.mp3", 5, "e"), ("music/c.mp3", 5, "e"),
               ("music/d.mp3", 6, "x"), ("film/a.mp4", 9, "f"), ("film/b.mp4", 9, "f"),
               ("film/c.txt", 1, "t")]
    now = make.objects(*listing).drop("sha256", "scanned_at")
    empty, none = make.objects(), make.media()
    scoped = ld.snapshot_diff(empty, now, "music/")
    assert rows(ld.scan_result(scoped)) == [(4, 0, 0)]
    index, _ = ld.apply_listing(empty, none, now)
    assert rows(ld.scan_result(ld.snapshot_diff(empty, now))) == [(7, 0, 0)]
    assert rows(ld.scan_result(ld.snapshot_diff(index, now))) == [(0, 0, 0)]
    assert rows(ld.scan_stats(index)) == [(7, 40, 2, 3, 19)]
    assert len(rows(ld.report_rows(ld.all_duplicates(index)))) == 5
    assert len(rows(ld.delete_plan(index))) == 3


def test_intervals_of_pages():
    assert with_pages([], [], [3, 1, 0]) == ([0, 3], [1, 3])
    assert with_pages([0, 3], [1, 3], [2, 2, 0]) == ([0], [3])


def listing_page(spark, path, run, day, number, last, *keys):
    started = dt.datetime(2024, 1, day)
    full = [("b", k, 1, "e", started, run, started, number, last) for k in keys]
    spark.createDataFrame(full, PAGES).coalesce(1).write.mode("append").parquet(path)


def test_end_of_listing(spark, make, tmp_path):
    pages, out, point = (str(tmp_path / n) for n in ("pages", "out", "c"))
    index = make.objects(*[(k, 1, "e") for k in ("a", "d", "e", "gone", "lost")],
                         ("young", 1, "e", False, None, dt.datetime(2024, 1, 9)), ("gone", 1, "e", False, None, dt.datetime(2024, 1, 1), "other"))
    media = make.media(*[(k, "A", "S") for k in ("a", "gone")])

    def follow_on() -> list[tuple]:
        query = log_missing(spark, pages, lambda: index, out, point)
        query.awaitTermination()
        return [r for n in range(query.lastProgress["batchId"] + 1 if query.lastProgress else 0)
                for r in rows(read_snapshot(spark, out, n), "bucket", "key", "last_modified", "deleted")]

    # The last page comes before the first; nothing is known to be missing yet.
    listing_page(spark, pages, "r1", 2, 2, True, "e")
    listing_page(spark, pages, "r1", 2, 0, False, "a", "a", "lost")
    listing_page(spark, pages, "r2", 3, 0, False, "a")
    assert follow_on() == []
    # A page comes again; then a late page without objects completes the run.
    listing_page(spark, pages, "r1", 2, 0, False, "a", "lost")
    listing_page(spark, pages, "r1", 2, 1, False, None)
    want = [("b", k, dt.datetime(2024, 1, 2), True) for k in ("d", "gone")]
    assert Bag(follow_on()) == want
    # Pages repeated after the end do not end it again; the second run completes later and lists less.
    listing_page(spark, pages, "r1", 2, 1, False, None)
    listing_page(spark, pages, "r2", 3, 1, True, "d")
    later = [("b", k, dt.datetime(2024, 1, 3), True) for k in ("e", "gone", "lost")]
    assert Bag(follow_on()) == [*want, *later]

    changes = spark.read.parquet(f"{out}/*").distinct()
    objects, tags = fold_changes(index, media, changes)
    assert rows(objects, "bucket", "key") == [("b", "a"), ("b", "young"), ("other", "gone")]
    assert rows(tags, "key") == ["a"]
