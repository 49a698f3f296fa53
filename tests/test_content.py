from __future__ import annotations

import hashlib
import io

import lakedupes as ld
from lakedupes.sources.content import hash_paths, open_uri, sha256_stream
from lakedupes.sources.listing import read_files
from tests.conftest import rows


def folder(tmp_path, **files):
    for name, data in files.items():
        (tmp_path / "sub").mkdir(exist_ok=True)
        (tmp_path / "sub" / name.replace("_", ".")).write_bytes(data)
    return str(tmp_path)


def test_stream_hash():
    data = b"x" * 3_000_001
    assert sha256_stream(io.BytesIO(data)) == hashlib.sha256(data).hexdigest()


def test_files_are_listed_hashed_and_grouped(spark, tmp_path):
    root = folder(tmp_path, a_bin=b"same", b_bin=b"same", c_bin=b"diff", d_bin=b"longer", e_bin=b"")
    files = read_files(spark, root, "b")
    assert rows(files, "key", "size") == [
        ("sub/a.bin", 4), ("sub/b.bin", 4), ("sub/c.bin", 4), ("sub/d.bin", 6)
    ]
    assert rows(read_files(spark, root, "b", "nope/")) == []
    index = ld.conform(files, ld.OBJECTS)
    hashes = ld.hash_candidates(files.selectExpr("*", "cast(null as string) as sha256"))
    assert rows(hashes, "key") == ["sub/a.bin", "sub/b.bin", "sub/c.bin"]
    hashed = ld.update_sha256(index, hashes)
    assert rows(ld.exclusive_duplicates(hashed), "key") == ["sub/a.bin", "sub/b.bin"]
    assert rows(ld.multipart_candidates(hashed)) == []


def test_unreadable_object_keeps_its_error(spark, tmp_path):
    good = tmp_path / "good"
    good.write_bytes(b"x")
    paths = spark.createDataFrame(
        [("b", "good", str(good)), ("b", "bad", str(tmp_path / "bad"))],
        "bucket string, key string, path string",
    )
    out = {r.key: r for r in hash_paths(paths, tasks=2).collect()}
    assert out["good"].sha256 == hashlib.sha256(b"x").hexdigest() and out["good"].error is None
    assert out["bad"].sha256 is None and "FileNotFoundError" in out["bad"].error


def test_hashes_from_a_content_table(spark, make):
    objects = make.objects(("a", 4, "x-2", True), ("b", 4, "y"), ("c", 9, "z-2", True))
    content = spark.createDataFrame(
        [("b", "a", bytearray(b"same")), ("b", "c", bytearray(b"nine"))],
        "bucket string, key string, content binary",
    )
    assert rows(ld.hash_candidates(objects, content), "key", "sha256", "error") == [
        ("a", hashlib.sha256(b"same").hexdigest(), None), ("b", None, "content not found")
    ]


def test_enrichment(spark, make, tmp_path):
    root = folder(tmp_path, song_mp3=b"TAG:A:S" + b"z" * 300_000, bad_mp3=b"none", note_txt=b"TAG")
    files = read_files(spark, root, "b")

    def extractor(data, ext):
        assert len(data) <= 256 * 1024 and ext == ".mp3"
        if not data.startswith(b"TAG"):
            raise ValueError("no tags")
        _, artist, title = data[:7].decode().split(":")
        return {"artist": artist, "title": title, "duration_s": 1.5, "bitrate": 320, "codec": "mp3"}

    none = make.media()
    media = ld.enrich_media(ld.media_pending(files, none), extractor, tasks=2).cache()
    assert rows(media, "key", "artist", "title", "duration_s", "bitrate") == [
        ("sub/song.mp3", "A", "S", 1.5, 320), ("sub/bad.mp3", None, None, None, None)
    ]
    assert [r.error for r in media.where("artist is null").collect()] == ["ValueError: no tags"]
    stored = ld.upsert_media(none, media)
    assert rows(ld.media_pending(files, stored)) == []


def test_scan(spark, make, tmp_path):
    root = folder(tmp_path, a_mp3=b"same", b_mp3=b"same", c_txt=b"diff")
    (tmp_path / "sub" / "d #1%20.txt").write_bytes(b"same")
    files = read_files(spark, root, "b")
    old = make.objects(("sub/gone.mp3", 3, "e"))
    tags = make.media(("sub/gone.mp3", "A", "S"))
    done = ld.scan(old, tags, files, bucket="b", extractor=lambda data, ext: {"title": ext})
    assert rows(done.result) == [(4, 0, 1)]
    assert rows(done.stats) == [(4, 16, 1, 2, 8)]
    assert rows(done.media, "key", "title") == [("sub/a.mp3", ".mp3"), ("sub/b.mp3", ".mp3")]
    assert rows(done.errors) == [] and (done.hashed, done.enriched) == (4, 2)
    assert rows(ld.exclusive_duplicates(done.objects), "key") == [
        "sub/a.mp3", "sub/b.mp3", "sub/d #1%20.txt"
    ]
    again = ld.scan(done.objects, done.media, files, bucket="b")
    assert rows(again.result) == [(0, 0, 0)]
    assert rows(again.objects, "key", "sha256") == rows(done.objects, "key", "sha256")


def test_scan_compares_with_objects_outside_the_prefix(spark, make, tmp_path):
    root = folder(tmp_path, a_bin=b"same")
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "b.bin").write_bytes(b"same")
    files = read_files(spark, root, "b")
    first = ld.scan(make.objects(), make.media(), files, "other/", "b")
    assert rows(first.stats) == [(1, 4, 0, 0, 0)]
    # The second scan lists only sub/, and hashes what lies outside it by its store address.
    both = ld.scan(first.objects, first.media, files.where("key like 'sub/%'"), "sub/", "b",
                   opener=lambda p: open_uri(p.replace("s3://b", str(tmp_path))))
    assert rows(both.stats) == [(2, 8, 1, 1, 4)] and rows(both.errors) == []
