from __future__ import annotations

import posixpath
import random

import lakedupes as ld
from lakedupes.operators import ranking, rename
from lakedupes.plans import actions
from tests.conftest import rows

RULES = ("strip-spaces", "strip-backslashes")


def served(wanted: dict[str, str], existing: set[str]) -> dict[str, str]:
    """The definition: serve sources one at a time and look up what is in use."""
    used = existing - set(wanted)
    first = {}
    for key in sorted(wanted):
        first.setdefault(wanted[key], key)
    out = {}
    seen = set()
    for key in sorted(wanted, key=lambda k: (first[wanted[k]], k)):
        target = name = wanted[key]
        root, ext = posixpath.splitext(target)
        number = 2
        while name in used or (target in seen and name == target):
            name, number = f"{root}_{number}{ext}", number + 1
        seen.add(target)
        used.add(name)
        out[key] = name
    return out


def resolved(spark, make, wanted, existing):
    renamed = spark.createDataFrame(
        [("b", k, t) for k, t in wanted.items()], "bucket string, key string, wanted string"
    )
    out = ld.resolve_conflicts(renamed, make.keys(*sorted(existing)))
    return {r.key: r for r in out.collect()}


def test_cleaning(make):
    cleaned = ld.clean_keys(make.keys(" a/x\\ \\ y.txt", "a/ok", "c / d"), RULES)
    assert rows(cleaned, "key", "wanted", "rules_fired") == [
        (" a/x\\ \\ y.txt", "a/x y.txt", ["strip-spaces", "strip-backslashes"]),
        ("a/ok", "a/ok", []), ("c / d", "c/d", ["strip-spaces"]),
    ]
    assert rows(ld.rename_stats(cleaned)) == [(3, 2)]
    assert rows(ld.rule_counts(cleaned)) == [("strip-spaces", 2), ("strip-backslashes", 1)]


def test_simple_conflicts(spark, make):
    keys = [" photo.jpg", "photo.jpg", " a.txt", "a.txt "]
    plan = {r.key: r for r in ld.plan_renames(make.keys(*keys)).collect()}
    assert plan[" photo.jpg"].target == "photo_2.jpg" and plan[" photo.jpg"].conflict
    assert {plan[" a.txt"].target, plan["a.txt "].target} == {"a.txt", "a_2.txt"}


def test_blank_key_stays(spark, make):
    out = resolved(spark, make, {"  ": ""}, {"  "})["  "]
    assert (out.target, out.invalid_target, out.conflict) == ("  ", True, False)


def test_conflict_outside_the_prefix(make):
    objects = make.keys("p /x", "p/x")
    plan = ld.plan_renames(objects, prefix="p /").collect()
    assert [r.target for r in plan] == ["p/x_2"]


def test_random_conflicts_match_the_definition(spark, make):
    rng = random.Random(11)
    stems = ["a", "a_2", "a_2_2", "a_3", "a_02", "b", "_2", "a_2_3"]
    checked = conflicts = 0
    for trial in range(3):
        wanted, existing = {}, set()
        for directory in range(60):
            for _ in range(rng.randint(1, 9)):
                target = f"d{directory}/{rng.choice(stems)}{rng.choice(['.t', '.t', ''])}"
                source = "".join(rng.choice(" !~") for _ in range(rng.randint(1, 4))) + target
                wanted[source] = target
            for _ in range(rng.randint(0, 4)):
                existing.add(f"d{directory}/{rng.choice(stems)}.t")
        for _ in range(20):
            wanted[f"!{rng.random()}"] = "hot.t"
        existing |= {"hot_4.t", "hot_9.t", "hot_10.t"} | set(wanted)
        got = resolved(spark, make, wanted, existing)
        expected = served(wanted, existing)
        assert {k: r.target for k, r in got.items()} == expected
        checked += len(expected)
        conflicts += sum(expected[k] != wanted[k] for k in wanted)
    assert checked > 500 and conflicts > 200


def test_many_sources_of_one_target(spark, make):
    wanted = {f"{'!' * (i % 5)} {i:03d}": f"t{i % 3}.x" for i in range(90)}
    existing = {"t0.x", "t0_5.x", "t1_2.x", "t1_3.x"} | set(wanted)
    got = resolved(spark, make, wanted, existing)
    assert {k: r.target for k, r in got.items()} == served(wanted, existing)


def test_number_rows(spark):
    df = spark.range(200).selectExpr("id", "id % 7 as v", "concat('k', id) as k")
    got = {r.id: r.group_no for r in ranking.number_rows(df, ["-v", "k"]).collect()}
    order = sorted(range(200), key=lambda i: (-(i % 7), f"k{i}"))
    assert got == {i: n for n, i in enumerate(order, 1)}


def test_emptied_folders(make):
    objects = make.keys("Music/ Artist / Album /track.mp3", "Music/other.mp3")
    plan = ld.plan_renames(objects)
    assert rows(ld.emptied_folders(plan, objects)) == [
        ("b", "Music/ Artist / Album ", 2), ("b", "Music/ Artist ", 1)
    ]
    assert rows(ld.keys_after_rename(plan, objects), "key") == [
        "Music/Artist/Album/track.mp3", "Music/other.mp3"
    ]
    stays = make.keys("d /x ", "d /y", "d / ")
    kept = ld.plan_renames(stays, prefix="d /x")
    assert rows(ld.emptied_folders(kept, stays)) == []


def test_rename_plan(make):
    # A move onto a name that another move gives up comes after that move.
    objects = make.keys("a/ \\ /b", "a//b", "it's /x")
    plan = actions.rename_plan(objects, ("strip-spaces", "strip-backslashes"))
    assert rows(plan, "step", "key", "target", "depends_on") == [
        (2, "a/ \\ /b", "a//b", "a//b"), (1, "a//b", "a/b", None),
        (1, "it's /x", "it's/x", None), (3, "it's /", None, None), (3, "a/ \\ /", None, None),
    ]
    assert rename.moves(ld.plan_renames(objects)).count() == 3
    assert ("aws s3 mv --copy-props none 's3://b/it'\\''s /x' 's3://b/it'\\''s/x'"
            in rows(plan, "command"))
