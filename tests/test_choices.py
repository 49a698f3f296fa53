from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

import lakedupes as ld
from lakedupes.operators.retention import parse_keep, register_criterion
from tests.conftest import rows


def keeper(objects, keep="cleanest,shortest,oldest"):
    kept = ld.retention(ld.all_duplicates(objects), keep).where("is_keeper")
    return [r.key for r in kept.collect()]


def test_default_policy(make):
    objects = make.objects(*[(k, 5, "e") for k in ("image.jpg", "image_1.jpg", "image_2.jpg")])
    assert keeper(objects) == ["image.jpg"]
    assert rows(ld.to_delete(ld.retention(ld.all_duplicates(objects))), "key") == [
        "image_1.jpg", "image_2.jpg"
    ]


def test_ties_and_order(make):
    jan, jun = dt.datetime(2024, 1, 1), dt.datetime(2024, 6, 1)
    objects = make.objects(("a.mp3", 5, "e", False, None, jan), ("b.mp3", 5, "e", False, None, jun))
    assert keeper(objects, "shortest,newest") == ["b.mp3"]
    assert keeper(objects, "shortest,oldest") == ["a.mp3"]
    assert keeper(objects, "shortest") == ["a.mp3"]
    dirty = make.objects(("x (1).mp3", 5, "e"), ("a very long clean name.mp3", 5, "e"))
    assert keeper(dirty) == ["a very long clean name.mp3"]
    assert keeper(dirty, "shortest, cleanest") == ["x (1).mp3"]


def test_policy_names():
    assert parse_keep("oldest, shortest") == ["oldest", "shortest"]
    with pytest.raises(ValueError, match="biggest"):
        parse_keep("oldest,biggest")


def test_own_criterion(make):
    register_criterion("last-key", lambda: -F.ascii(F.col("key")))
    objects = make.objects(("a", 5, "e"), ("b", 5, "e"))
    assert keeper(objects, "last-key") == ["b"]


def test_delete_plan(spark, make):
    objects = make.objects(
        ("it's.mp3", 2048, "e"), ("its.mp3", 2048, "e"), ("c.mp3", 2048, "e", False, "h"),
        ("d.mp3", 2048, "m-2", True, "h"),
    )
    config = spark.createDataFrame([("b", "https://s")], "bucket string, endpoint_url string")
    plan = ld.delete_plan(objects, config=config)
    assert rows(plan, "key", "keeper", "copies", "wasted") == [
        ("d.mp3", "c.mp3", 4, "6.0 Ko"), ("it's.mp3", "c.mp3", 4, "6.0 Ko"),
        ("its.mp3", "c.mp3", 4, "6.0 Ko"),
    ]
    assert "aws s3 rm --endpoint-url 'https://s' 's3://b/it'\\''s.mp3'" in rows(plan, "command")
    bare = ld.delete_plan(objects)
    assert "aws s3 rm 's3://b/d.mp3'" in rows(bare, "command")


def test_suspects(make):
    objects = make.objects(
        ("a/photo été.jpg", 1, "e1"), ("b/photo ete.jpg", 2, "e2"), ("rapport.pdf", 3, "e3"),
        ("rapport (1).pdf", 4, "e4"), ("song.mp3", 5, "e5"), ("song (1).mp3", 5, "e5"),
        ("unique.txt", 6, "e6"),
    )
    assert rows(ld.suspect_names(objects), "normalized", "key") == [
        ("photo ete.jpg", "a/photo été.jpg"), ("photo ete.jpg", "b/photo ete.jpg"),
        ("rapport.pdf", "rapport (1).pdf"), ("rapport.pdf", "rapport.pdf"),
    ]


def test_suspects_by_content(make):
    objects = make.objects(("x/a.mp3", 5, "p-2", True, "h"), ("y/a.mp3", 5, "q-3", True, "h"))
    assert len(rows(ld.suspect_names(objects))) == 2
    assert rows(ld.suspect_names(ld.content_identity(objects), "fingerprint")) == []


def test_same_work(make):
    objects = make.objects(("s.flac", 50, "e1"), ("s.mp3", 5, "e2"), ("t.mp3", 6, "e3"))
    media = make.media(("s.flac", "A", "S", "flac"), ("s.mp3", "A", "S", "mp3"),
                       ("t.mp3", None, "S"), ("u.mp3", None, "S"))
    assert rows(ld.same_work_groups(objects, media), "artist", "title", "key", "size") == [
        ("A", "S", "s.flac", 50), ("A", "S", "s.mp3", 5)
    ]
    # Repetition counts media rows, with or without an object.
    gone = make.media(("s.flac", "A", "S"), ("gone.mp3", "A", "S"))
    assert rows(ld.same_work_groups(objects, gone), "key") == ["s.flac"]
