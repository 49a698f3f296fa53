from __future__ import annotations

import random

import lakedupes as ld
from tests.conftest import rows


def test_size_pass(make):
    objects = make.objects(("a", 100, "e1"), ("b", 100, "e2"), ("c", 200, "e3"))
    assert rows(ld.size_duplicates(objects), "key", "n") == [("a", 2), ("b", 2)]


def test_etag_pass(make):
    objects = make.objects(("a", 100, "same"), ("b", 100, "same"), ("c", 100, "diff"))
    assert rows(ld.etag_duplicates(objects), "fingerprint", "key", "wasted_bytes") == [
        ("same", "a", 100), ("same", "b", 100)
    ]


def test_same_etag_other_size(make):
    objects = make.objects(("a", 100, "same"), ("b", 200, "same"))
    assert rows(ld.etag_duplicates(objects)) == []


def test_candidates(make):
    open_ = make.objects(("a", 100, "abc-2", True), ("b", 100, "def-3", True),
                         ("c", 7, "x-1", True))
    assert rows(ld.multipart_candidates(open_), "key") == ["a", "b"]
    done = make.objects(("a", 100, "abc-2", True, "h"), ("b", 100, "def-3", True, "h2"))
    assert rows(ld.multipart_candidates(done), "key") == []
    mixed = make.objects(("a", 100, "abc-2", True), ("b", 100, "plain"),
                         ("c", 100, "x", False, "h"))
    assert rows(ld.multipart_candidates(mixed), "key") == ["a", "b", "c"]


def test_combined_groups_and_stats(make):
    objects = make.objects(
        ("a", 100, "e1"), ("b", 100, "e1"),
        ("c", 200, "x-2", True, "h1"), ("d", 200, "y-3", True, "h1"), ("e", 50, "e9"),
    )
    assert rows(ld.duplicate_groups(objects), "kind", "fingerprint", "n", "wasted_bytes") == [
        ("etag", "e1", 2, 100), ("sha256", "h1", 2, 200)
    ]
    assert rows(ld.all_duplicates(objects), "kind", "key") == [
        ("etag", "a"), ("etag", "b"), ("sha256", "c"), ("sha256", "d")
    ]
    assert rows(ld.scan_stats(objects)) == [(5, 650, 2, 2, 300)]


def test_mixed_multipart_group_is_none(make):
    objects = make.objects(("a", 100, "e1"), ("b", 100, "e1", True))
    assert rows(ld.all_duplicates(objects)) == []


def test_stats_of_nothing(make):
    assert rows(ld.scan_stats(make.objects())) == [(0, 0, 0, 0, 0)]


def test_exclusive_groups_of_four(make):
    objects = make.objects(
        ("a", 9, "e"), ("b", 9, "e", False, "h"), ("c", 9, "e", False, "h"),
        ("d", 9, "m-2", True, "h"), ("u", 9, "k-2", True), ("v", 9, "k-2", True),
        ("w", 5, "p"), ("x", 5, "p"),
    )
    assert rows(ld.exclusive_duplicates(objects), "fingerprint", "key", "n") == sorted(
        [("h", k, 4) for k in "abcd"] + [("p", "w", 2), ("p", "x", 2)]
    )
    # The overlapping view counts the plain copies in both kinds of group.
    assert len(rows(ld.all_duplicates(objects))) == 3 + 3 + 2
    known = dict(rows(ld.content_identity(objects), "key", "fingerprint"))
    assert known["a"] == "h" and known["u"] is None


def test_hot_groups_stay_whole(make):
    rng = random.Random(7)
    notes = []
    for i in range(400):
        hot = i % 3 == 0
        etag = "hot" if hot else f"e{rng.randint(0, 120)}"
        size = 10 if hot else 20 + int(etag[1:]) % 7
        sha = f"s{etag}" if rng.random() < 0.5 else None
        notes.append((f"k{i}", size, etag, False, sha))
    objects = make.objects(*notes)
    by_etag: dict = {}
    by_sha: dict = {}
    by_size: dict = {}
    for key, size, etag, _, sha in notes:
        by_etag.setdefault((etag, size), []).append(key)
        by_size.setdefault(size, []).append(key)
        if sha:
            by_sha.setdefault(sha, []).append(key)
    expected = sorted(
        [("etag", k, len(g)) for g in by_etag.values() if len(g) > 1 for k in g]
        + [("sha256", k, len(g)) for g in by_sha.values() if len(g) > 1 for k in g]
    )
    assert sorted(rows(ld.all_duplicates(objects), "kind", "key", "n")) == expected
    assert sorted(rows(ld.size_duplicates(objects), "key", "n")) == sorted(
        (k, len(g)) for g in by_size.values() if len(g) > 1 for k in g
    )
    exclusive = rows(ld.exclusive_duplicates(objects), "key")
    assert len(exclusive) == len(set(exclusive))
    kept = ld.retention(ld.all_duplicates(objects), "shortest")
    assert len(rows(kept)) == len(expected)
    groups = sum(len(g) > 1 for g in [*by_etag.values(), *by_sha.values()])
    assert len(rows(kept.where("is_keeper"))) == groups
