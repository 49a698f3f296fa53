"""Report rows: summary, ranked groups, and the three sections in one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakedupes.functions.text import codec_label, human_size, iso_time, whole_units, work_label
from lakedupes.operators.exact import all_duplicates
from lakedupes.operators.ranking import number_rows
from lakedupes.operators.suspects import suspect_names
from lakedupes.operators.works import same_work_groups
from lakedupes.unions import union

COLUMNS = ["section", "group_id", "group_size", "object_key", "detail"]


def report_rows(
    groups: DataFrame, suspects: DataFrame | None = None, works: DataFrame | None = None
) -> DataFrame:
    """(section, group_id, group_size, object_key, detail) of all report sections."""
    rows = groups.select(
        F.lit("duplicate").alias("section"), F.col("fingerprint").alias("group_id"),
        F.col("size").alias("group_size"), F.col("key").alias("object_key"),
        iso_time(F.col("last_modified")).alias("detail"),
    )
    if suspects is not None:
        rows = union(rows, suspects.select(
            F.lit("suspect_name").alias("section"), F.col("normalized").alias("group_id"),
            F.col("size").alias("group_size"), F.col("key").alias("object_key"),
            F.col("etag").alias("detail"),
        ))
    if works is not None:
        rows = union(rows, works.select(
            F.lit("same_work").alias("section"),
            work_label(F.col("artist"), F.col("title")).alias("group_id"),
            F.col("size").alias("group_size"), F.col("key").alias("object_key"),
            codec_label(F.col("codec"), "").alias("detail"),
        ))
    return rows.select(COLUMNS)


def report(objects: DataFrame, media: DataFrame) -> DataFrame:
    """The report rows of an index."""
    return report_rows(
        all_duplicates(objects), suspect_names(objects), same_work_groups(objects, media)
    )


def ranked_groups(groups: DataFrame, k: int | None = None) -> DataFrame:
    """Groups numbered by wasted bytes, largest first; with ``k`` only the top of that list.

    ``groups`` has one row per group (``duplicate_groups`` or ``exclusive_groups``).
    """
    if k is not None:
        groups = groups.orderBy(F.desc("wasted_bytes"), "fingerprint", "kind").limit(k)
    return number_rows(groups, ["-wasted_bytes", "fingerprint", "kind"]).select(
        "group_no", "kind", "fingerprint", F.col("n").alias("copies"), "size",
        human_size(F.col("size")).alias("size_text"),
        "wasted_bytes", human_size(F.col("wasted_bytes")).alias("wasted_text"),
    )


def summary_text(stats: DataFrame) -> DataFrame:
    """``scan_stats`` with its sizes also as text."""
    return stats.withColumns({
        "total_size_text": human_size(F.col("total_size")),
        "wasted_text": human_size(F.col("wasted_bytes")),
    })


def same_work_rows(works: DataFrame) -> DataFrame:
    """Same-work members as shown to people: codec label and size text."""
    return works.select(
        "artist", "title", "key", codec_label(F.col("codec")).alias("codec"),
        human_size(F.col("size")).alias("size_text"),
    )


def folder_report_rows(folders: DataFrame) -> DataFrame:
    """(category, base_name, folder_path, file_count, media_count, total_size), and whole units."""
    return folders.select(
        "category", "base_name", F.col("folder").alias("folder_path"), "file_count",
        "media_count", "total_size",
        whole_units(F.col("total_size"), 1).alias("size_kib"),
        whole_units(F.col("total_size"), 2).alias("size_mib"),
    )
