"""What the plans must look like to hold at scale."""

from __future__ import annotations

import pytest

import lakedupes as ld
from lakedupes.functions.names import normalize_name
from lakedupes.sources.listing import under_prefix
from tests.conftest import rows
from workload.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
# Their work is on the bytes of objects: a hash carried over rows, and a caller's tag parser.
READ_BYTES = {"chunked_sha256", "enrich_media"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, make, tmp_path):
    path = str(tmp_path / "objects")
    make.objects(("a/x", 1, "e"), ("a/y", 1, "e"), ("b/z", 2, "f")).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_no_cross_join(spark, name):
    if name in ("ranked_groups", "top_groups", "resolve_conflicts", "rename_plan",
                "keys_after_rename", "emptied_folders"):
        pytest.skip("starts jobs while it is built; see the tests of its operators")
    text = plan(QUERIES[name](spark, FOLDER))
    python = ("Python", "Pandas", "MapInArrow")
    if name in READ_BYTES:
        assert any(p in text for p in python)
        python = ("BatchEvalPython", "ArrowEvalPython")
    for bad in (*python, "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text, bad


def test_pushdown_and_pruning(stored):
    text = plan(under_prefix(stored, "a/", "b").select("key"))
    assert "StringStartsWith(key,a/)" in text and "EqualTo(bucket,b)" in text
    sizes = plan(ld.scan_stats(stored))
    assert "last_modified" not in sizes


def test_unhashed_rows_are_skipped_by_the_scan(stored):
    assert "IsNotNull(sha256)" in plan(ld.hash_duplicates(stored))


def test_hot_list_is_whole_and_windows_are_partitioned(stored):
    text = plan(ld.all_duplicates(stored))
    assert "TakeOrderedAndProject" not in text and "Limit" not in text
    for name in ("all_duplicates", "exclusive_duplicates", "size_duplicates", "suspect_names"):
        assert "Window" not in plan(getattr(ld, name)(stored))


def test_content_is_not_read_for_listing(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"x")
    text = plan(ld.read_files(spark, str(tmp_path), "b"))
    assert "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>" in text


def test_names_stay_in_the_jvm(make):
    df = make.texts("ﬁ é 한 (1).txt")
    out = df.select(normalize_name(df.t))
    assert "Python" not in plan(out) and len(rows(out)) == 1
