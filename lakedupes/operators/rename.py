"""Cleaning keys: wanted names, conflict-free targets, folders left empty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakedupes.fixed import DEFAULT_RULES
from lakedupes.functions.paths import ancestors, extension, folder_depth, without_extension
from lakedupes.functions.rules import rules_named
from lakedupes.operators.ranking import spread_row_number
from lakedupes.sources.listing import under_prefix
from lakedupes.staging import stage
from lakedupes.unions import union

KEY = ["bucket", "key"]
_TARGET = ["bucket", "wanted"]


def clean_keys(objects: DataFrame, rules: Sequence[str] = DEFAULT_RULES) -> DataFrame:
    """(bucket, key, wanted, rules_fired) of every key, rules applied one after another."""
    wanted = F.col("key")
    fired = []
    for name, rule in rules_named(rules):
        after = rule(wanted)
        fired.append(F.when(~after.eqNullSafe(wanted), name))
        wanted = after
    fired_names = F.array_compact(F.array(*fired)) if fired else F.array().cast("array<string>")
    return objects.select(*KEY, wanted.alias("wanted"), fired_names.alias("rules_fired"))


def renames(cleaned: DataFrame) -> DataFrame:
    """The keys that a rule changed."""
    return cleaned.where(F.col("wanted") != F.col("key"))


def rename_stats(cleaned: DataFrame) -> DataFrame:
    """Total keys and renamed keys in one row."""
    return cleaned.agg(
        F.count(F.lit(1)).alias("total_keys"),
        F.count_if(F.col("wanted") != F.col("key")).alias("rename_count"),
    )


def rule_counts(cleaned: DataFrame) -> DataFrame:
    """How often each rule changed a key."""
    return (
        cleaned.select(F.explode("rules_fired").alias("rule"))
        .groupBy("rule")
        .agg(F.count(F.lit(1)).alias("fired"))
    )


def _claims(names: DataFrame, name: str) -> DataFrame:
    """The targets a name in use stands in the way of: ``names`` with wanted and _number added.

    Every name is in the way of the target of that name (no number). ``root_n.ext``, with n >= 2
    and no leading zero, is also in the way of the n-th suffix of ``root.ext``. Numbers beyond 18
    digits are left out: to reach them takes 10^18 rows.
    """
    named = names.withColumn("_ext", extension(F.col(name))).withColumn(
        "_root", F.expr(f"left({name}, length({name}) - length(_ext))")
    )
    read = named.withColumn(
        "_digits", F.regexp_extract("_root", r"(?s)_([2-9]|[1-9][0-9]{1,17})\z", 1)
    )
    whole = f"named_struct('wanted', {name}, '_number', cast(null as bigint))"
    suffix = (
        "named_struct('wanted', concat(left(_root, length(_root) - length(_digits) - 1), _ext),"
        " '_number', cast(_digits as bigint))"
    )
    return read.selectExpr(
        *names.columns, f"inline(if(_digits = '', array({whole}), array({whole}, {suffix})))"
    )


def _suffixed(target: Column, number: Column) -> Column:
    return F.concat(
        without_extension(target), F.lit("_"), number.cast("string"), extension(target)
    )


def _place(
    sources: DataFrame, taken: DataFrame, blocked: DataFrame
) -> DataFrame:
    """Targets for ``sources`` (bucket, wanted, key, _rank), given what is taken.

    ``taken`` (bucket, wanted, _number, _rank) are the suffix numbers not free for a target,
    ``blocked`` (bucket, wanted) the targets that are themselves taken. A target that is free goes
    to the first source; the others get the next free numbers from 2.

    The j-th free number is found by merging: with c the count of free numbers below a taken one,
    a taken number stands before the j-th source iff c < j, and the j-th free number is the
    position of that source in the merged order plus one.
    """
    ranked = sources.join(blocked.selectExpr(*_TARGET, "1 AS _skip"), _TARGET, "left")
    # Turn 0 gets the target itself; a blocked target has no turn 0.
    turns = ranked.selectExpr(
        *_TARGET, "key", "coalesce(_skip, 0) AS _skip", "_rank - 1 + coalesce(_skip, 0) AS _turn",
    ).selectExpr("*", "2 * _turn AS _slot", "cast(0 as bigint) AS _tie")
    # _number - 1 - _rank free numbers lie below the taken number of rank _rank.
    used = taken.selectExpr(
        *_TARGET, "cast(null as string) AS key", "0 AS _skip", "cast(null as bigint) AS _turn",
        "2 * (_number - 1 - _rank) + 1 AS _slot", "_rank AS _tie",
    )
    merged = spread_row_number(
        union(turns, used), _TARGET, ["_slot", "_tie"], "_position"
    ).where("key is not null")
    # The position counts turn 0, where there is one.
    suffixed = _suffixed(F.col("wanted"), F.expr("_position + _skip"))
    return merged.select(
        *_TARGET, "key",
        F.when(F.col("_turn") == 0, F.col("wanted")).otherwise(suffixed).alias("target"),
    )


def resolve_conflicts(renamed: DataFrame, existing: DataFrame) -> DataFrame:
    """Conflict-free targets for ``renamed`` (bucket, key, wanted) among ``existing`` keys.

    Output: (bucket, key, wanted, target, conflict, invalid_target, depends_on). Targets are served
    in the order of their smallest source, the sources of one target in key order: the first gets
    the target if it is free, the others ``_2``, ``_3`` and so on, skipping every name in use. Keys
    that are themselves moved away count as free; ``depends_on`` names such a key, whose own move
    must come first. Keys that clean to nothing are left where they are (``invalid_target``).

    Only the rows in conflict are ranked. Targets depend on each other along one path: a generated
    ``a_2.txt`` may be another target. Whether it was there first follows from the smallest sources,
    so one pass settles all targets but those that lose their own name to a suffix; only these are
    placed again, once per link of the longest such chain (normally not at all).
    """
    # The cleaning rules run once, not in each of the uses below.
    renamed, _ = stage(renamed.select(*KEY, "wanted"))
    valid = renamed.where("wanted <> ''")
    targets, _ = stage(valid.groupBy(*_TARGET).agg(
        F.count(F.lit(1)).alias("n"), F.min("key").alias("_first")
    ))
    # One pass over the index finds the targets and the suffixes its keys stand in the way of; keys
    # that move away are not in the way.
    in_the_way = (
        _claims(existing.select(KEY), "key")
        .join(targets.select(_TARGET), _TARGET, "left_semi")
        .join(valid.select(KEY), KEY, "left_anti")
        .drop("key")
        .distinct()
    )
    # A target that reads like a suffix of another one: in the way if served before it, else it
    # may be lost to it.
    children = targets.selectExpr("bucket", "wanted AS _child", "_first AS _child_first")
    links = (
        _claims(children, "_child")
        .where("_number is not null")
        .join(targets.select(*_TARGET, "_first"), _TARGET)
        .selectExpr(*_TARGET, "_number", "if(_child_first > _first, _child, null) AS _later")
    )
    facts, _ = stage(
        union(in_the_way.withColumn("_later", F.lit(None).cast("string")), links)
    )
    blocked = facts.where("_number is null").select(_TARGET)
    numbers = (
        facts.where("_number is not null and _later is null").select(*_TARGET, "_number").distinct()
    )
    later = facts.where("_later is not null").selectExpr("bucket", "_later AS target")

    chained = not later.isEmpty()
    contested = union(
        targets.where("n > 1").select(_TARGET), blocked,
        later.selectExpr("bucket", "target AS wanted"),
    ).distinct()
    sources = spread_row_number(
        valid.join(contested, _TARGET, "left_semi"), _TARGET, ["key"], "_rank"
    )
    taken = spread_row_number(numbers, _TARGET, ["_number"], "_rank")
    placed = _place(sources, taken, blocked)
    if chained:
        placed = _settle_chains(placed, numbers, blocked, later)

    target = F.coalesce(
        "_placed", F.when(F.col("wanted") != "", F.col("wanted")).otherwise(F.col("key"))
    )
    settled = (
        renamed.select(*KEY, "wanted")
        .join(placed.select(*KEY, F.col("target").alias("_placed")), KEY, "left")
        .withColumn("target", target)
        .drop("_placed")
    )
    moved = valid.select("bucket", F.col("key").alias("target"), F.col("key").alias("depends_on"))
    # Plans read the outcome several times.
    return stage(settled.join(moved, ["bucket", "target"], "left").selectExpr(
        *KEY, "wanted", "target", "target <> wanted and wanted <> '' AS conflict",
        "wanted = '' AS invalid_target", "nullif(depends_on, key) AS depends_on",
    ))[0]


def _settle_chains(
    placed: DataFrame, numbers: DataFrame, blocked: DataFrame, later: DataFrame
) -> DataFrame:
    """Place the targets again that lost their own name to a suffix of another target.

    A target is lost at most once: it is placed in the first pass, and perhaps in one later pass.
    """
    first, _ = stage(placed)
    placed, parts, again = first, [], []
    while True:
        generated = placed.where("target <> wanted").select("bucket", "target")
        lost, n = stage(
            later.join(generated, ["bucket", "target"], "left_semi")
            .selectExpr("bucket", "target AS wanted")
            .join(blocked, _TARGET, "left_anti")
            .distinct()
        )
        if not n:
            break
        again.append(lost)
        blocked = union(blocked, lost)
        sources = first.join(lost, _TARGET, "left_semi").select(*_TARGET, "key")
        placed, _ = stage(_place(
            spread_row_number(sources, _TARGET, ["key"], "_rank"),
            spread_row_number(
                numbers.join(lost, _TARGET, "left_semi"), _TARGET, ["_number"], "_rank"
            ),
            lost,
        ))
        parts.append(placed)
    if not parts:
        return first
    return union(first.join(union(*again), _TARGET, "left_anti"), *parts)


def moves(resolved: DataFrame) -> DataFrame:
    """The resolved rows that change a key."""
    return resolved.where("not invalid_target")


def keys_after_rename(resolved: DataFrame, existing: DataFrame) -> DataFrame:
    """(bucket, key) of all objects once the moves are done. Resolved targets are unique."""
    moved = moves(resolved)
    stay = existing.select(KEY).join(moved.select(KEY), KEY, "left_anti")
    return union(stay, moved.selectExpr("bucket", "target AS key"))


def _folders(keys: DataFrame) -> DataFrame:
    return keys.select(
        "bucket", F.explode(ancestors(F.col("key"))).alias("dir")
    ).distinct()


def emptied_folders(resolved: DataFrame, existing: DataFrame) -> DataFrame:
    """(bucket, dir, depth) of the folders above moved keys that nothing is left in.

    Every key names its folders; the distinct folders of the remaining keys are removed from those
    of the moved keys. Folders shared by many keys are merged before the shuffle.
    """
    left = _folders(keys_after_rename(resolved, existing))
    return (
        _folders(moves(resolved))
        .join(left, ["bucket", "dir"], "left_anti")
        .withColumn("depth", folder_depth(F.col("dir")))
    )


def plan_renames(
    objects: DataFrame, rules: Sequence[str] = DEFAULT_RULES, prefix: str = "",
    bucket: str | None = None,
) -> DataFrame:
    """Resolved renames of the keys below a prefix, checked against the whole index."""
    cleaned = clean_keys(under_prefix(objects, prefix, bucket), rules)
    return resolve_conflicts(renames(cleaned), objects)
