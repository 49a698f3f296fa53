"""Plans: rows with a command to review. Nothing here deletes or renames anything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakedupes.fixed import DEFAULT_KEEP, DEFAULT_RULES, ORPHAN
from lakedupes.functions.text import human_size, shell_quote, store_uri
from lakedupes.operators.exact import exclusive_duplicates
from lakedupes.operators.folders import duplicate_folders
from lakedupes.operators.rename import emptied_folders, moves, plan_renames
from lakedupes.operators.retention import retention, to_delete
from lakedupes.sources.listing import with_endpoint
from lakedupes.staging import stage
from lakedupes.unions import union


def _endpoint(df: DataFrame, config: DataFrame | None, given: str | None) -> DataFrame:
    if config is not None:
        return with_endpoint(df, config, given)
    return df.withColumn("endpoint_url", F.lit(given).cast("string"))


def _command(verb: str, *words: Column) -> Column:
    """``aws s3 verb [--endpoint-url url] words``."""
    endpoint = F.when(
        F.col("endpoint_url").isNotNull(),
        F.concat(F.lit("--endpoint-url "), shell_quote(F.col("endpoint_url"))),
    )
    return F.concat_ws(" ", F.lit(f"aws s3 {verb}"), endpoint, *words)


def delete_plan(
    objects: DataFrame,
    keep: str = DEFAULT_KEEP,
    config: DataFrame | None = None,
    endpoint_url: str | None = None,
    members: DataFrame | None = None,
) -> DataFrame:
    """One row per object to delete, each object at most once.

    ``members`` replaces the default groups, ``exclusive_duplicates``.
    """
    chosen = to_delete(retention(
        exclusive_duplicates(objects) if members is None else members, keep
    ))
    return _endpoint(chosen, config, endpoint_url).select(
        "fingerprint", "size", F.col("n").alias("copies"), "wasted_bytes",
        human_size(F.col("wasted_bytes")).alias("wasted"),
        "keeper_bucket", "keeper", "bucket", "key",
        _command("rm", store_uri(F.col("bucket"), F.col("key"))).alias("command"),
    )


def _depths(moved: DataFrame) -> DataFrame:
    """(bucket, key, _depth): the number of moves that must come before, for moves that wait for another.

    Every pass doubles the stretch that a move looks back over its chain, so there are as many passes as the longest
    chain has binary digits. What still looks back after as many as the number of waiting moves has, goes in a circle
    and is left out.
    """
    chain, n = stage(
        moved.where("depends_on is not null")
        .selectExpr("bucket", "key", "depends_on AS _back", "cast(1 as bigint) AS _depth")
    )
    open_rows, passes = n, n.bit_length()
    while open_rows and passes:
        before = chain.selectExpr("bucket", "key AS _back", "_back AS _further", "_depth AS _more")
        # A chain ends at a move that waits for none: that one is not in the table.
        chain, _ = stage(
            chain.join(before, ["bucket", "_back"], "left").selectExpr(
                "bucket", "key", "_further AS _back", "_depth + coalesce(_more, 0) AS _depth"
            )
        )
        open_rows = chain.where("_back is not null").count()
        passes -= 1
    return chain.where("_back is null").select("bucket", "key", "_depth")


def rename_plan(
    objects: DataFrame,
    rules: Sequence[str] = DEFAULT_RULES,
    prefix: str = "",
    bucket: str | None = None,
    config: DataFrame | None = None,
    endpoint_url: str | None = None,
    resolved: DataFrame | None = None,
) -> DataFrame:
    """Moves, then deletions of the folders they leave empty.

    Run in the order of (step, order_key, key): moves first (1), then the moves onto a name that another move
    gives up (2; ``order_key`` counts the moves that must come before, less one), then folders, deepest first (3).
    Moves that wait for each other in a circle, and those that wait for such, have neither ``order_key`` nor command.
    """
    if resolved is None:
        resolved = plan_renames(objects, rules, prefix, bucket)
    waiting = F.col("depends_on").isNotNull()
    command = _command(
        "mv --copy-props none", store_uri(F.col("bucket"), F.col("key")),
        store_uri(F.col("bucket"), F.col("target")),
    )
    ordered = moves(resolved).join(_depths(moves(resolved)), ["bucket", "key"], "left")
    move = _endpoint(ordered, config, endpoint_url).select(
        F.when(waiting, 2).otherwise(1).alias("step"),
        F.when(waiting, F.col("_depth") - 1).otherwise(0).cast("int").alias("order_key"),
        "bucket", "key", "target", "conflict", "depends_on",
        F.when(~waiting | F.col("_depth").isNotNull(), command).alias("command"),
    )
    text = F.lit(None).cast("string")
    marker = F.concat("dir", F.lit("/"))
    tidy = _endpoint(emptied_folders(resolved, objects), config, endpoint_url).select(
        F.lit(3).alias("step"), (-F.col("depth")).alias("order_key"), "bucket",
        marker.alias("key"), text.alias("target"), F.lit(False).alias("conflict"),
        text.alias("depends_on"),
        _command("rm", store_uri(F.col("bucket"), marker)).alias("command"),
    )
    return union(move, tidy)


def orphan_plan(
    stats: DataFrame, config: DataFrame | None = None, endpoint_url: str | None = None
) -> DataFrame:
    """One row per folder to delete or to review.

    ``delete``: a folder without audio that holds nothing but images, next to one with audio.
    ``review``: other folders without audio, and both sides of groups that all have audio.
    """
    folders = duplicate_folders(stats).where(
        (F.col("file_count") > 0)
        & ((F.col("category") != ORPHAN) | (F.col("role") == "orphan"))
    )
    sure = (F.col("category") == ORPHAN) & F.col("only_images")
    address = store_uri(F.col("bucket"), F.concat("folder", F.lit("/")))
    return _endpoint(folders, config, endpoint_url).select(
        "bucket", "base_name", "category", "folder", "file_count", "media_count", "total_size",
        human_size(F.col("total_size")).alias("size_text"), "first_complete",
        F.when(sure, "delete").otherwise("review").alias("action"),
        _command("rm --recursive", address).alias("command"),
    )


def orphan_totals(plan: DataFrame) -> DataFrame:
    """Files and bytes that the ``delete`` rows of an orphan plan free, in one row."""
    zero = F.lit(0).cast("long")
    rows = plan.where("action = 'delete'")
    return rows.agg(
        F.count(F.lit(1)).alias("folders"),
        F.coalesce(F.sum("file_count"), zero).alias("files"),
        F.coalesce(F.sum("total_size"), zero).alias("bytes"),
    )
