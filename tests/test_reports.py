from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

import lakedupes as ld
from lakedupes.operators.ranking import ordered_rows
from lakedupes.plans.report import folder_report_rows, same_work_rows, summary_text
from lakedupes.sinks import reports
from tests.conftest import DAY, rows


def index(make):
    return make.objects(("a.mp3", 2048, "e"), ("b/a (1).mp3", 2048, "e"), ("c/a.mp3", 10, "f"),
                        ("x.bin", 4096, "g"), ("y.bin", 4096, "g"), ("z.bin", 4096, "g"))


def test_report_rows(make):
    objects = index(make)
    media = make.media(("a.mp3", "Artist", "Song", "mp3"), ("c/a.mp3", "Artist", "Song"))
    assert rows(ld.report(objects, media)) == [
        ("duplicate", "e", 2048, "a.mp3", "2024-01-01T00:00:00"),
        ("duplicate", "e", 2048, "b/a (1).mp3", "2024-01-01T00:00:00"),
        *[("duplicate", "g", 4096, k, "2024-01-01T00:00:00") for k in ("x.bin", "y.bin", "z.bin")],
        ("suspect_name", "a.mp3", 2048, "a.mp3", "e"),
        ("suspect_name", "a.mp3", 2048, "b/a (1).mp3", "e"),
        ("suspect_name", "a.mp3", 10, "c/a.mp3", "f"),
        ("same_work", "Artist - Song", 2048, "a.mp3", "mp3"),
        ("same_work", "Artist - Song", 10, "c/a.mp3", ""),
    ]
    shown = same_work_rows(ld.same_work_groups(objects, media))
    assert rows(shown, "codec", "size_text") == [("mp3", "2.0 Ko"), ("?", "10.0 o")]
    assert rows(ld.report_rows(ld.all_duplicates(make.objects()))) == []


def test_ranked_groups(make):
    groups = ld.duplicate_groups(index(make))
    ranked = ld.ranked_groups(groups)
    assert rows(ranked, "group_no", "fingerprint", "copies", "wasted_text") == [
        (1, "g", 3, "8.0 Ko"), (2, "e", 2, "2.0 Ko")
    ]
    assert rows(ld.ranked_groups(groups, k=1), "group_no", "fingerprint") == [(1, "g")]
    text = summary_text(ld.scan_stats(index(make))).first()
    assert (text.total_size_text, text.wasted_text) == ("16.0 Ko", "10.0 Ko")


def test_json_report(make, tmp_path):
    objects = index(make)
    path = str(tmp_path / "r")
    ld.write_json_report(path, ld.scan_stats(objects), ld.all_duplicates(objects),
                         ld.suspect_names(objects), None)

    def text(section):
        return "".join(f.read_text() for f in sorted((tmp_path / "r" / section).glob("part*")))

    assert json.loads(text("stats")) == {"total_objects": 6, "total_size": 16394, "duplicate_groups": 2,
                                         "duplicate_objects": 3, "wasted_bytes": 10240}
    groups = json.loads(text("groups"))
    assert [(g["fingerprint"], [o["key"] for o in g["objects"]]) for g in groups] == [
        ("g", ["x.bin", "y.bin", "z.bin"]), ("e", ["a.mp3", "b/a (1).mp3"])
    ]
    assert groups[1] == {
        "fingerprint": "e", "size": 2048, "wasted_bytes": 2048, "objects": [
            {"bucket": "b", "key": k, "last_modified": "2024-01-01T00:00:00"} for k in ("a.mp3", "b/a (1).mp3")
        ],
    }
    names = json.loads(text("suspect_names"))
    assert [[f["key"] for f in n["files"]] for n in names] == [["a.mp3", "b/a (1).mp3", "c/a.mp3"]]
    assert not (tmp_path / "r" / "same_work").exists()


def test_documents_of_any_size(spark, make, tmp_path):
    """A group larger than a task's share, groups of one row, null names, and order by position."""
    works = [("b", f"k{i:03}", "A", "S", None, i % 7) for i in range(200)]
    works += [("b", "z", None, "S", "mp3", 1), ("b", "y", "A", 'T"', "é", None), ("b", "x", "B", None, None, 3)]
    found = spark.createDataFrame(works, "bucket string, key string, artist string, title string, codec string, bitrate long")
    lines = reports.work_lines(found.withColumn("size", F.col("bitrate") * 2)).orderBy("position").collect()
    assert [r.position for r in lines] == list(range(1, 204))
    documents = json.loads("".join(r.text for r in lines))
    assert [(d["artist"], d["title"], len(d["files"])) for d in documents] == [
        (None, "S", 1), ("A", "S", 200), ("A", 'T"', 1), ("B", None, 1)
    ]
    files = [(f["size"], f["key"]) for f in documents[1]["files"]]
    assert files == sorted(files, key=lambda f: (-f[0], f[1])) and len(set(files)) == 200
    assert rows(reports.work_lines(ld.same_work_groups(make.objects(), make.media()))) == []
    placed, n = ordered_rows(found, ["-bitrate", "key"], 1)
    assert n == 203 and placed.where("first").count() == 8
    assert placed.where("first").orderBy("position").first().bitrate is None


def test_documents_name_the_bucket(make):
    objects = make.objects(("k", 5, "e"), ("k", 5, "e", False, None, DAY, "b2"))
    found = reports.duplicate_documents(ld.all_duplicates(objects))
    assert rows(found, "object.bucket", "object.key") == [("b", "k"), ("b2", "k")]


def test_work_documents(make):
    objects = index(make)
    media = make.media(("a.mp3", "A", "S", "mp3"), ("c/a.mp3", "A", "S"))
    found = reports.work_documents(ld.same_work_groups(objects, media))
    assert rows(found, "artist", "file.key", "file.codec", "file.size") == [
        ("A", "a.mp3", "mp3", 2048), ("A", "c/a.mp3", None, 10)
    ]


def test_csv_is_quoted(spark, make, tmp_path):
    objects = make.objects(('a, "1".mp3', 5, "e"), ("b\nc.mp3", 5, "e"))
    path = str(tmp_path / "csv")
    ld.write_report(ld.report_rows(ld.all_duplicates(objects)).coalesce(1), path, "csv")
    back = spark.read.csv(path, header=True, escape='"', multiLine=True)
    assert back.columns == ["section", "group_id", "group_size", "object_key", "detail"]
    assert rows(back, "object_key") == ['a, "1".mp3', "b\nc.mp3"]
    ordered = str(tmp_path / "ordered")
    ld.write_report(back, ordered, "csv", order_by=["object_key"])
    files = sorted((tmp_path / "ordered").glob("part*"))
    text = "".join(f.read_text() for f in files)
    assert text.index("1") < text.index("b\nc")
    with pytest.raises(ValueError, match="xlsx"):
        ld.write_report(back, path, "xlsx")


def test_folder_rows(make):
    stats = ld.folder_stats(make.objects(
        ("Music/A/X/1.mp3", 3_000_000, "e"), ("Music/A/X [1]/c.jpg", 2000, "f")
    ))
    out = folder_report_rows(ld.duplicate_folders(stats))
    assert rows(out) == [
        ("orphan", "Music/A/X", "Music/A/X", 1, 1, 3_000_000, 2929, 2),
        ("orphan", "Music/A/X", "Music/A/X [1]", 1, 0, 2000, 1, 0),
    ]
