from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

import lakedupes as ld
from lakedupes.operators.index import upsert
from lakedupes.schema import BUCKET_CONFIG, MEDIA
from lakedupes.sinks.tables import save_index
from lakedupes.sources import listing
from tests.conftest import DAY, rows


def listed(make, *notes):
    return make.objects(*notes).drop("sha256", "scanned_at")


def test_diff(make):
    index = make.objects(("p/same", 1, "e"), ("p/changed", 1, "e"), ("p/gone", 1, "e"),
                         ("q/other", 1, "e"), ("p/two", 1, "e", False, None, DAY, "b2"))
    now = listed(make, ("p/same", 1, "e"), ("p/changed", 1, "f"), ("p/new", 1, "e"))
    diff = ld.snapshot_diff(index, now, "p/", "b")
    assert rows(diff, "key", "change") == [
        ("p/changed", "updated"), ("p/gone", "deleted"), ("p/new", "new"), ("p/same", "unchanged")
    ]
    assert rows(ld.scan_result(diff)) == [(1, 1, 1)]


def test_apply_listing(make):
    index = make.objects(("p/same", 1, "e", False, "h"), ("p/changed", 1, "e", False, "h"),
                         ("p/gone", 1, "e"), ("q/other", 1, "e", False, "h"))
    media = make.media(("p/same", "A", "S"), ("p/changed", "A", "S"), ("p/gone", "A", "S"),
                       ("q/other", "A", "S"))
    now = listed(make, ("p/same", 1, "e"), ("p/changed", 2, "f"), ("p/new", 3, "e-2", True))
    stamp = F.lit("2030-01-01").cast("timestamp_ntz")
    objects, tags = ld.apply_listing(index, media, now, "p/", scanned_at=stamp)
    assert rows(objects, "key", "size", "etag", "is_multipart", "sha256") == [
        ("p/same", 1, "e", False, "h"), ("p/changed", 2, "f", False, None),
        ("p/new", 3, "e-2", True, None), ("q/other", 1, "e", False, "h"),
    ]
    assert rows(tags, "key") == ["p/same", "q/other"]
    again, _ = ld.apply_listing(objects, tags, now, "p/")
    assert rows(again) == rows(objects)


def test_upserts(make):
    old = make.objects(("a", 1, "e", False, "h"), ("b", 1, "e", False, "h"))
    new = listed(make, ("a", 2, "f"), ("a", 3, "g"), ("c", 4, "x"))
    new = new.withColumn("turn", F.col("size"))
    stamped = F.lit("2030-01-01").cast("timestamp_ntz")
    out = ld.upsert_objects(old, new, ["turn"], stamped)
    assert rows(out, "key", "size", "sha256") == [("a", 3, None), ("b", 1, "h"), ("c", 4, None)]
    assert {r.scanned_at for r in out.where("key <> 'b'").collect()} == {dt.datetime(2030, 1, 1)}
    old_tags = make.media(("a", "A", "S"), ("b", "B", "S"))
    tags = ld.upsert_media(old_tags, make.media(("a", None, None)))
    assert rows(tags, "key", "artist") == [("a", None), ("b", "B")]
    assert rows(upsert(old, old.limit(0), ["bucket", "key"])) == rows(old)


def test_config(spark):
    def given(*pairs):
        return spark.createDataFrame(pairs, "bucket string, endpoint_url string")

    config = spark.createDataFrame(
        [("changed", "old", DAY), ("same", "u", DAY), ("null", None, DAY), ("kept", "k", DAY),
         ("cleared", "c", DAY)], BUCKET_CONFIG,
    )
    out = ld.upsert_config(config, given(
        ("changed", "new"), ("same", "u"), ("null", "n"), ("fresh", "f"), ("cleared", None)
    ))
    assert rows(out, "bucket", "endpoint_url", "previous") == [
        ("changed", "new", "old"), ("same", "u", None), ("null", "n", None), ("fresh", "f", None),
        ("kept", "k", None), ("cleared", None, "c"),
    ]
    looked = listing.with_endpoint(given(("kept", None), ("none", None)).select("bucket"), out)
    assert rows(looked) == [("kept", "k"), ("none", None)]
    assert rows(listing.with_endpoint(looked.select("bucket"), out, "x"), "endpoint_url") == [
        "x", "x"
    ]


def test_delete_and_update(spark, make):
    objects = make.objects(("a", 1, "e"), ("b", 1, "e"), ("a", 1, "e", False, None, DAY, "b2"))
    media = make.media(("a", "A", "S"), ("b", "A", "S"))
    left, tags = ld.delete_objects(objects, media, make.keys("a"))
    assert rows(left, "bucket", "key") == [("b", "b"), ("b2", "a")]
    assert rows(tags, "key") == ["b"]
    hashes = spark.createDataFrame([("b", "a", "h"), ("b", "b", None)],
                                   "bucket string, key string, sha256 string")
    assert rows(ld.update_sha256(objects, hashes), "bucket", "key", "sha256") == [
        ("b", "a", "h"), ("b", "b", None), ("b2", "a", None)
    ]


def test_reads(make):
    objects = make.objects(("a_b/x", 1, "e"), ("aXb/x", 1, "f"), ("a_b/y", 1, "g", False, None, DAY,
                                                                   "b2"))
    assert rows(listing.keys_with_etags(objects, "a_b/", "b"), "key", "etag") == [("a_b/x", "e")]
    assert rows(listing.all_keys(objects, "a_b/"), "key") == ["a_b/x", "a_b/y"]


def test_conform(spark):
    bare = spark.createDataFrame([("b", "k", 320)], "bucket string, key string, bitrate int")
    media = ld.conform(bare, MEDIA)
    assert media.schema["bitrate"].dataType.typeName() == "long"
    assert media.first().artist is None
    with pytest.raises(ValueError, match="key"):
        ld.conform(bare.drop("key"), MEDIA)


def test_listing_formats(spark, tmp_path):
    raw = spark.createDataFrame(
        [("d/a, \"b\".mp3", 5, '"x-2"', DAY), ("d/", 0, '"e"', DAY), ("o/c", 7, '"y"', DAY)],
        "Key string, Size long, ETag string, LastModified timestamp_ntz",
    )
    for fmt in ("parquet", "csv", "json", "orc"):
        path = str(tmp_path / fmt)
        options = {"header": "true", "escape": '"'} if fmt == "csv" else {}
        raw.write.format(fmt).options(**options).save(path)
        out = ld.read_listing(spark, path, fmt, bucket="b")
        assert rows(out) == [
            ("b", 'd/a, "b".mp3', 5, '"x-2"', True, DAY), ("b", "o/c", 7, '"y"', False, DAY)
        ], fmt
    assert rows(ld.read_listing(spark, path, fmt, "b", prefix="o/"), "key") == ["o/c"]


def test_bucketed_index_is_not_shuffled(spark, make, tmp_path):
    save_index(make.objects(("a", 1, "e"), ("b", 2, "f")), "idx", 4, str(tmp_path / "idx"))
    index = spark.table("idx")
    now = listed(make, ("a", 1, "x"), ("c", 1, "y"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        diff = ld.snapshot_diff(index, now)
        plan = diff._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
        assert rows(diff, "key", "change") == [("a", "updated"), ("b", "deleted"), ("c", "new")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table idx")
