"""Folders that were imported twice under different names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakedupes.fixed import BOTH_MUSIC, DEFAULT_FOLDER_DEPTH, DEFAULT_FOLDER_PREFIX, ORPHAN
from lakedupes.functions.paths import folder_at, folder_base_name, is_audio, is_image
from lakedupes.operators.groups import join_groups
from lakedupes.sources.listing import under_prefix
from lakedupes.unions import union

STATS = ["file_count", "media_count", "image_count", "total_size"]


def folder_stats(
    objects: DataFrame,
    prefix: str = DEFAULT_FOLDER_PREFIX,
    depth: int = DEFAULT_FOLDER_DEPTH,
    bucket: str | None = None,
) -> DataFrame:
    """One row per folder at ``depth`` that holds a key below ``prefix``; one pass, one shuffle.

    Depth counts from the start of the key. A file exactly at the depth is a folder with no files.
    A folder is measured whole, also where the prefix reaches below it.
    """
    segments = prefix.split("/")
    reach = prefix if len(segments) <= depth else "/".join(segments[:depth]) + "/"
    key = F.col("key")
    rows = (
        under_prefix(objects, reach, bucket)
        .select("bucket", "key", "size", folder_at(key, depth).alias("folder"))
        .where(F.col("folder").isNotNull())
    )
    inside = F.length(key) > F.length("folder")
    none = F.lit(0).cast("long")
    return (
        rows.groupBy("bucket", "folder")
        .agg(
            F.count_if(inside).alias("file_count"),
            F.count_if(inside & is_audio(key)).alias("media_count"),
            F.count_if(inside & is_image(key) & ~is_audio(key)).alias("image_count"),
            F.sum(F.when(inside, F.col("size")).otherwise(none)).alias("total_size"),
            F.bool_or(key.startswith(prefix)).alias("_seen"),
        )
        .where("_seen")
        .select(
            "bucket", "folder", folder_base_name(F.col("folder"), depth).alias("base_name"),
            *STATS, ((F.col("image_count") == F.col("file_count")) & (F.col("file_count") > 0))
            .alias("only_images"),
        )
    )


def folder_groups(stats: DataFrame) -> DataFrame:
    """One row per base name with several folders.

    ``orphan``: some of its folders have audio and some have none. Everything else is
    ``both_music``; ``any_media`` tells the groups apart in which no folder has audio.
    """
    with_audio = F.col("media_count") > 0
    return (
        stats.groupBy("bucket", "base_name")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.bool_or(with_audio).alias("any_media"),
            F.bool_and(with_audio).alias("_all_media"),
            F.min(F.when(~with_audio, F.col("folder"))).alias("_silent"),
            F.min(F.when(with_audio, F.col("folder"))).alias("_audible"),
        )
        .where("n > 1")
        .withColumn(
            "category",
            F.when(F.col("any_media") & ~F.col("_all_media"), ORPHAN).otherwise(BOTH_MUSIC),
        )
        .select(
            "bucket", "base_name", "category", "any_media", "n",
            F.when(F.col("category") == ORPHAN, F.col("_silent")).alias("first_orphan"),
            F.when(F.col("category") == ORPHAN, F.col("_audible")).alias("first_complete"),
        )
    )


def duplicate_folders(stats: DataFrame) -> DataFrame:
    """One row per folder of a duplicate group, with its ``role`` in an orphan group."""
    rows = join_groups(
        stats, folder_groups(stats), ["bucket", "base_name"], spread=["folder"]
    )
    role = F.when(
        F.col("category") == ORPHAN,
        F.when(F.col("media_count") > 0, "complete").otherwise("orphan"),
    )
    return rows.select(
        "bucket", "base_name", "category", "any_media", "folder", *STATS, "only_images",
        role.alias("role"), "first_orphan", "first_complete", "n",
    )


def with_category(folders: DataFrame, category: str) -> DataFrame:
    """The folder rows, or group rows, of one category."""
    if category not in (ORPHAN, BOTH_MUSIC):
        raise ValueError(f"unknown category: {category}")
    return folders.where(F.col("category") == category)


def diagnosis_summary(stats: DataFrame) -> DataFrame:
    """Folders, duplicate groups, and groups per category, in one row."""
    zero = F.lit(0).cast("long")
    one = F.lit(1).cast("long")
    names = ["total_folders", "duplicate_groups", "orphan_groups", "both_music_groups"]
    folders = stats.select(one.alias(names[0]), *[zero.alias(n) for n in names[1:]])
    groups = folder_groups(stats).select(
        zero.alias(names[0]),
        one.alias(names[1]),
        (F.col("category") == ORPHAN).cast("long").alias(names[2]),
        (F.col("category") == BOTH_MUSIC).cast("long").alias(names[3]),
    )
    return union(folders, groups).agg(*[
        F.coalesce(F.sum(n), zero).alias(n) for n in names
    ])
