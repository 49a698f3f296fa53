"""Content jobs: bins, remembered failures, chunked content, heads from a table."""

from __future__ import annotations

import hashlib
import random

import pytest

import lakedupes as ld
from lakedupes.operators.bins import running_total, spread_by_bin
from lakedupes.sources import content as source
from lakedupes.sources.content import hash_paths, open_uri
from tests.conftest import rows


def sized(spark, sizes):
    return spark.createDataFrame(
        [("b", f"k{i:04}", s) for i, s in enumerate(sizes)], "bucket string, key string, size long"
    ).repartition(3)


@pytest.mark.parametrize("seed", range(4))
def test_bins_are_bounded(spark, seed):
    r = random.Random(seed)
    sizes = [r.choice([0, 1, 5, 50, 400, 5000, None]) for _ in range(r.choice([1, 40, 300]))]
    target, cost = r.choice([(1, 0), (100, 0), (1000, 7), (10**9, 3)])
    found = sorted(ld.content_bins(sized(spark, sizes), target, cost).collect(), key=lambda x: x.key)
    before = 0
    weight: dict[int, list[int]] = {}
    for row, size in zip(found, sizes, strict=True):
        assert row.bin == before // target and row["size"] == size
        weight.setdefault(row.bin, []).append((size or 0) + cost)
        before += (size or 0) + cost
    assert all(sum(w[:-1]) < target for w in weight.values())


def test_bins_of_nothing(spark):
    assert rows(ld.content_bins(sized(spark, []), 10)) == []
    with pytest.raises(ValueError):
        ld.content_bins(sized(spark, [1]), 0)


def test_running_total_with_ties_cut_apart(spark):
    data = spark.range(50).selectExpr("id", "id % 3 AS w")
    found = {r.id: r.before for r in running_total(data, ["id"], data["w"], "before").collect()}
    assert found == {i: sum(k % 3 for k in range(i)) for i in range(50)}


def test_one_task_per_bin(spark):
    binned = ld.content_bins(sized(spark, [60, 60, 500, 1, 1, 1, 60]), 100)
    parts = spread_by_bin(binned).rdd.glom().map(lambda p: sorted(r.key for r in p)).collect()
    assert [p for p in parts if p] == [["k0000", "k0001"], ["k0002"], ["k0003", "k0004", "k0005", "k0006"]]


def test_hashing_by_bins(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(source, "OPEN_BYTES", 10)
    files = {f"f{i}": bytes([i]) * (i * 37 % 200) for i in range(20)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    paths = spark.createDataFrame(
        [("b", n, str(tmp_path / n), len(d)) for n, d in files.items()] + [("b", "lost", str(tmp_path / "lost"), None)],
        "bucket string, key string, path string, size long",
    )
    found = {r.key: r.sha256 for r in hash_paths(paths).collect()}
    assert found == {n: hashlib.sha256(d).hexdigest() for n, d in files.items()} | {"lost": None}


def test_pending_objects(spark, make):
    objects = make.objects(
        ("a", 4, "x-2", True), ("b", 4, "y"), ("c", 4, "z", False, "known"), ("d", 9, "w-2", True), ("e", 4, "v", False, None),
    )
    failures = spark.createDataFrame([("b", "b", "y", "denied", None), ("b", "a", "old-2", "denied", None), ("b", "b", "y", "again", None)], ld.FAILURES)
    assert rows(ld.hash_pending(objects), "key") == ["a", "b", "e"]
    assert rows(ld.hash_pending(objects, failures), "key") == ["a", "e"]
    assert rows(ld.hash_pending(objects, failures, "other"), "key") == []
    found = spark.createDataFrame([("b", "a", "timeout"), ("b", "e", None), ("b", "gone", "x")], "bucket string, key string, error string")
    assert rows(ld.remember_failures(failures.where("error <> 'again'"), objects, found), "key", "etag", "error") == [
        ("a", "x-2", "timeout"), ("b", "y", "denied")
    ]


def test_second_scan_opens_nothing(spark, make, tmp_path):
    for name in "abc":
        (tmp_path / name).write_bytes(b"same")
    log = tmp_path / "opened"
    log.mkdir()

    def opener(path):
        import uuid

        (log / f"{path.rsplit('/', 1)[1]}-{uuid.uuid4().hex}").touch()
        return open_uri(path)

    listing = make.objects(("a", 4, "x-2", True), ("b", 4, "y"), ("c", 4, "z"), ("lost", 4, "w")).drop("sha256", "scanned_at")
    listing = listing.selectExpr("*", f"concat('{tmp_path}/', key) AS path")
    first = ld.scan(make.objects(), make.media(), listing, bucket="b", opener=opener, endpoint_url="https://one")
    assert sorted(p.name[0] for p in log.iterdir()) == ["a", "b", "c", "l"]
    assert rows(first.failures, "key", "etag") == [("lost", "w")] and rows(first.errors, "key") == ["lost"]
    assert rows(first.config, "bucket", "endpoint_url", "previous") == [("b", "https://one", None)]
    again = ld.scan(first.objects, first.media, listing, bucket="b", opener=opener, failures=first.failures,
                    config=first.config, endpoint_url="https://two")
    assert len(list(log.iterdir())) == 4 and again.hashed == 0
    assert rows(again.config, "endpoint_url", "previous") == [("https://two", "https://one")]
    # With another ETag the lost object is tried again, and only that one.
    changed = listing.selectExpr("bucket", "key", "size", "if(key = 'lost', 'w2', etag) AS etag", "is_multipart", "last_modified", "path")
    third = ld.scan(again.objects, again.media, changed, bucket="b", opener=opener, failures=again.failures)
    assert len(list(log.iterdir())) == 5 and third.hashed == 1
    assert rows(third.failures, "key", "etag") == [("lost", "w2")] and rows(third.config, "bucket", "endpoint_url") == [("b", None)]


def chunk_rows(spark, rows_):
    return spark.createDataFrame(rows_, "bucket string, key string, chunk int, content binary").repartition(5)


def test_chunks(spark):
    r = random.Random(1)
    want, data = {}, []
    for i in range(30):
        text = r.randbytes(r.choice([0, 1, 100, 5000]))
        parts = [text[a:a + 100] for a in range(0, max(1, len(text)), 100)]
        want[f"k{i}"] = (hashlib.sha256(text).hexdigest(), len(text), len(parts), None)
        data += [("b", f"k{i}", n, bytearray(p)) for n, p in enumerate(parts)]
    data += data[::7]  # chunks given twice
    data += [("b", "gap", 0, bytearray(b"x")), ("b", "gap", 2, bytearray(b"y")), ("b", "late", 1, bytearray(b"x"))]
    data += [("b", "two", 0, bytearray(b"x")), ("b", "two", 0, bytearray(b"y")), ("b", "two", 1, bytearray(b"z"))]
    data += [("b", "null", 0, None), ("b", "number", None, bytearray(b"x")), (None, None, 0, bytearray(b"x"))]
    found = {r.key: (r.sha256, r["size"], r.chunks, r.error) for r in ld.hash_chunks(chunk_rows(spark, data)).collect()}
    assert {k: v for k, v in found.items() if k in want} == want
    assert found["gap"] == (None, 1, 1, "chunk 1 is missing") and found["late"][3] == "chunk 0 is missing"
    assert found["two"][0] is None and found["two"][3] == "chunk 0 has several contents"
    assert found["null"][3] == found["number"][3] == "chunk 0 is missing"
    assert found[None][0] == hashlib.sha256(b"x").hexdigest() and len(found) == 36
    assert rows(ld.hash_chunks(chunk_rows(spark, []))) == []


def test_chunks_over_batches(spark):
    """The state of a hash goes on from one Arrow batch to the next."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        data = [("b", k, n, bytearray(f"{k}{n}".encode())) for k in ("x", "y", "z") for n in range(11)]
        found = {r.key: r.sha256 for r in ld.hash_chunks(chunk_rows(spark, data)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {k: hashlib.sha256("".join(f"{k}{n}" for n in range(11)).encode()).hexdigest() for k in ("x", "y", "z")}


def test_enrichment_from_a_table(spark, make):
    objects = make.objects(("a.mp3", 9, "x"), ("b.MP3", 9, "y"), ("c.txt", 9, "z"), ("d.flac", 9, "w"), ("e.wav", 9, "v"))
    content = spark.createDataFrame(
        [("b", "a.mp3", bytearray(b"Artist:Title:rest")), ("b", "b.MP3", bytearray(b"none")), ("b", "c.txt", bytearray(b"A:B:")), ("b", "e.wav", bytearray(b"E:F:"))],
        "bucket string, key string, content binary",
    )

    def extractor(data, ext):
        assert len(data) <= 13
        artist, title, *_ = data.decode().split(":")
        return {"artist": artist, "title": title, "codec": ext}

    pending = ld.media_pending(objects, make.media(("e.wav", "E", "F")))
    found = ld.enrich_media(pending, extractor, content=content, head=13)
    assert rows(found, "key", "artist", "title", "codec") == [
        ("a.mp3", "Artist", "Title", ".mp3"), ("b.MP3", None, None, None), ("d.flac", None, None, None)
    ]
    told = dict(rows(found, "key", "error"))
    assert told["a.mp3"] is None and "ValueError" in told["b.MP3"] and told["d.flac"] == "FileNotFoundError: content not found"


def test_heads_are_cut_before_the_join(spark, make):
    content = spark.createDataFrame([("b", "a.mp3", bytearray(b"x"))], "bucket string, key string, content binary")
    found = ld.enrich_media(ld.media_pending(make.objects(("a.mp3", 1, "x")), make.media()), lambda d, e: {}, content=content, head=5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.rindex("substring")
