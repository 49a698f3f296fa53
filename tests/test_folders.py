from __future__ import annotations

import pytest

import lakedupes as ld
from lakedupes.operators.folders import with_category
from lakedupes.sinks.reports import folder_documents
from tests.conftest import rows


def files(make, *keys):
    return make.objects(*[(k, 10, f"e{i}") for i, k in enumerate(keys)])


def test_counts(make):
    stats = ld.folder_stats(files(
        make, "Music/A/X/1.mp3", "Music/A/X/2.FLAC", "Music/A/X/c.jpg", "Music/A/X/n/deep.txt",
        "Music/A/file.mp3", "Music/A", "Other/A/X/1.mp3",
    ))
    assert rows(stats, "folder", "file_count", "media_count", "image_count", "total_size") == [
        ("Music/A/X", 4, 2, 1, 40), ("Music/A/file.mp3", 0, 0, 0, 0)
    ]


def test_prefix_below_the_depth_measures_whole_folders(make):
    objects = files(make, "Music/A/X/1.mp3", "Music/A/X/sub/2.mp3", "Music/A/Y/1.mp3")
    stats = ld.folder_stats(objects, prefix="Music/A/X/sub")
    assert rows(stats, "folder", "file_count") == [("Music/A/X", 2)]


def test_wildcards_in_a_prefix_are_literal(make):
    objects = files(make, "a_b/c/d/1.mp3", "axb/c/d/1.mp3")
    assert rows(ld.folder_stats(objects, prefix="a_b/"), "folder") == ["a_b/c/d"]


def test_orphans_and_both(make):
    stats = ld.folder_stats(files(
        make, "Music/A/One/1.mp3", "Music/A/One [12] [2020]/c.jpg", "Music/A/One [7]/c.png",
        "Music/A/Two/1.mp3", "Music/A/Two [5]/1.mp3", "Music/A/Solo/1.mp3",
        "Music/A/Mute/c.jpg", "Music/A/Mute [1]/c.jpg", "Music/A/Film/1.mp3",
        "Music/A/Film [9]/v.mkv",
    ))
    folders = ld.duplicate_folders(stats)
    assert rows(folders, "base_name", "category", "any_media", "folder", "role") == [
        ("Music/A/Film", "orphan", True, "Music/A/Film [9]", "orphan"),
        ("Music/A/Film", "orphan", True, "Music/A/Film", "complete"),
        ("Music/A/Mute", "both_music", False, "Music/A/Mute [1]", None),
        ("Music/A/Mute", "both_music", False, "Music/A/Mute", None),
        ("Music/A/One", "orphan", True, "Music/A/One [12] [2020]", "orphan"),
        ("Music/A/One", "orphan", True, "Music/A/One [7]", "orphan"),
        ("Music/A/One", "orphan", True, "Music/A/One", "complete"),
        ("Music/A/Two", "both_music", True, "Music/A/Two [5]", None),
        ("Music/A/Two", "both_music", True, "Music/A/Two", None),
    ]
    assert rows(ld.diagnosis_summary(stats)) == [(10, 4, 2, 2)]
    groups = ld.folder_groups(stats).where("base_name = 'Music/A/One'").first()
    assert (groups.first_orphan, groups.first_complete) == (
        "Music/A/One [12] [2020]", "Music/A/One"
    )
    assert len(rows(with_category(folders, "both_music"))) == 4
    with pytest.raises(ValueError):
        with_category(folders, "other")

    plan = ld.orphan_plan(stats)
    assert rows(plan.where("category = 'orphan'"), "folder", "action") == [
        ("Music/A/Film [9]", "review"), ("Music/A/One [12] [2020]", "delete"),
        ("Music/A/One [7]", "delete"),
    ]
    assert rows(plan.where("category = 'both_music'").select("action").distinct()) == ["review"]
    assert "aws s3 rm --recursive 's3://b/Music/A/One [7]/'" in rows(plan, "command")
    assert rows(ld.orphan_totals(plan)) == [(2, 2, 20)]

    documents = folder_documents(folders).where("base_name = 'Music/A/Two'")
    assert rows(documents, "folder.path") == ["Music/A/Two", "Music/A/Two [5]"]


def test_empty_folder_is_never_deleted(make):
    stats = ld.folder_stats(files(make, "Music/A/One/1.mp3", "Music/A/One [12]"))
    assert rows(ld.duplicate_folders(stats).where("role = 'orphan'"), "folder") == [
        "Music/A/One [12]"
    ]
    assert rows(ld.orphan_plan(stats)) == []


def test_prefix_separates(make):
    objects = files(make, "Music/A/One/1.mp3", "Music/A/One [1]/c.jpg", "Other/A/One/1.mp3",
                    "Other/A/One [1]/c.jpg")
    assert rows(ld.folder_groups(ld.folder_stats(objects)), "base_name") == ["Music/A/One"]
