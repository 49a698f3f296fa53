"""Cases in which a careless plan would lose data, or leave a hot key whole."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

import lakedupes as ld
from lakedupes.functions import rules
from lakedupes.operators.exact import content_identity, multipart_candidates
from lakedupes.operators.groups import join_groups
from lakedupes.streaming.upkeep import fold_changes
from tests.conftest import DAY, rows


def test_listing_with_repeats_and_unknown_etags(spark, make):
    index = make.objects(
        ("same", 1, "e", False, "h"), ("unsure", 1, "e", False, "h"), ("gone", 1, "e"), ("changed", 1, "e", False, "h"),
        ("same", 1, "e", False, "h", DAY, "other"),
    )
    media = make.media(("same", "A", "S"), ("unsure", "A", "S"), ("gone", "A", "S"), ("changed", "A", "S"))
    later = DAY + dt.timedelta(days=1)
    listing = make.objects(
        ("same", 1, "e"), ("same", 1, "e"), ("unsure", 1, "?"), ("changed", 9, "x"), ("changed", 2, "y", False, None, later),
        ("new", 3, "n"), ("new", 3, "n"),
    ).drop("sha256", "scanned_at").withColumn("etag", F.expr("nullif(etag, '?')"))
    assert rows(ld.snapshot_diff(index, listing, "", "b"), "key", "change") == [
        ("same", "unchanged"), ("unsure", "updated"), ("gone", "deleted"), ("changed", "updated"), ("new", "new")
    ]
    objects, tags = ld.apply_listing(index, media, listing, "", "b")
    assert rows(objects, "bucket", "key", "size", "etag", "sha256", "is_multipart") == [
        ("b", "same", 1, "e", "h", False), ("b", "unsure", 1, "", None, True), ("b", "changed", 2, "y", None, False),
        ("b", "new", 3, "n", None, False), ("other", "same", 1, "e", "h", False),
    ]
    assert rows(tags, "key") == ["same"]


@pytest.fixture
def letters(monkeypatch):
    """Rules that move letters on, in a chain or in a circle."""
    monkeypatch.setitem(rules._RULES, "next", lambda key: F.translate(key, "abcd", "bcde"))
    monkeypatch.setitem(rules._RULES, "swap", lambda key: F.translate(key, "xy", "yx"))


def test_rename_chain_is_ordered(make, letters):
    objects = make.objects(*[(k, 1, k) for k in "abcd"])
    plan = ld.rename_plan(objects, rules=("next",))
    in_order = plan.where("step < 3").orderBy("step", "order_key", "key")
    assert [(r.key, r.target) for r in in_order.collect()] == [("d", "e"), ("c", "d"), ("b", "c"), ("a", "b")]


def test_rename_circle_has_no_command(make, letters):
    plan = ld.rename_plan(make.objects(("x", 1, "e"), ("y", 1, "f"), ("z", 1, "g")), rules=("swap",))
    assert rows(plan.where("step < 3"), "key", "target", "order_key", "command") == [("x", "y", None, None), ("y", "x", None, None)]


def test_deletions_are_not_lost(spark, make):
    index = make.objects(("tie", 1, "e"), ("open", 1, "e"), ("written", 1, "e"))
    schema = "bucket string, key string, size long, etag string, is_multipart boolean, last_modified timestamp_ntz, deleted boolean"
    changes = spark.createDataFrame([
        ("b", "tie", 2, "f", False, DAY, False), ("b", "tie", None, None, None, DAY, True),
        ("b", "open", 2, "f", False, DAY, False), ("b", "open", None, None, None, None, True),
        ("b", "written", None, None, None, DAY, True), ("b", "written", 2, "f", False, DAY + dt.timedelta(days=1), False),
    ], schema)
    for log in (changes, changes.union(changes)):
        objects, _ = fold_changes(index, make.media(), log)
        assert rows(objects, "key", "etag") == [("written", "f")]


def test_conflicting_hashes_are_no_identity(make):
    objects = make.objects(("a", 1, "e-2", True, "h1"), ("b", 1, "e-2", True, "h2"), ("c", 1, "e-2", True), ("d", 1, "f-2", True, "h"), ("x", 1, "f-2", True))
    assert rows(content_identity(objects), "key", "fingerprint") == [("a", "h1"), ("b", "h2"), ("c", None), ("d", "h"), ("x", "h")]


def test_hot_groups_that_are_dropped(spark, make):
    """Rows of a hot key do not meet in one partition, whether its group is kept or not."""
    data = spark.range(3000).selectExpr("id", "if(id % 3 = 0, -1, id % 500) AS k", "'b' AS bucket", "cast(id AS string) AS key")
    groups = data.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("_good", F.col("k") >= 0)
    spread = join_groups(data, groups, ["k"], how="left", keep="_good")
    sizes = [r.n for r in spread.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert spread.count() == 3000 and max(sizes) < 2 * 3000 / 4
    assert spread.where("_good IS NULL").count() == 1000
    assert join_groups(data, groups, ["k"], keep="_good").count() == 2000
    objects = make.objects(*[(f"k{i}", 5, f"e{i}") for i in range(50)], ("m", 6, "x-2", True), ("n", 6, "y"))
    assert rows(multipart_candidates(objects), "key") == ["m", "n"]
