"""Counts of groups and folders that are kept, and changed by what a scan or a rename changes.

A count table has one row per group or folder. A change costs a shuffle of the changed rows and one join with
the counts; the index itself is not read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakedupes.functions.paths import ancestors, folder_depth
from lakedupes.functions.text import wasted_bytes
from lakedupes.operators.rename import moves
from lakedupes.unions import union

_GROUP = ["kind", "fingerprint", "size"]


def _fingerprints(rows: DataFrame, sign: int) -> DataFrame:
    """(kind, fingerprint, size, n, multipart): what each row adds to its ETag group and its hash group."""
    one = F.lit(sign).cast("long")
    by_etag = F.struct(
        F.lit("etag").alias("kind"), F.col("etag").alias("fingerprint"), one.alias("n"),
        F.when(F.col("is_multipart"), one).otherwise(F.lit(0).cast("long")).alias("multipart"),
    )
    by_hash = F.struct(
        F.lit("sha256").alias("kind"), F.col("sha256").alias("fingerprint"), one.alias("n"), F.lit(0).cast("long").alias("multipart")
    )
    each = rows.select("size", F.explode(F.array(by_etag, by_hash)).alias("g"))
    return each.select("g.kind", "g.fingerprint", "size", "g.n", "g.multipart").where("fingerprint IS NOT NULL")


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*_GROUP).agg(F.sum("n").alias("n"), F.sum("multipart").alias("multipart"))


def group_counts(objects: DataFrame) -> DataFrame:
    """(kind, fingerprint, size, n, multipart) of every ETag group and hash group of the index, also those of one object."""
    return _summed(_fingerprints(objects, 1))


def counts_after_scan(counts: DataFrame, changes: DataFrame) -> DataFrame:
    """``group_counts`` after the scan that ``changes`` (rows of ``classified``) describes.

    Deleted and updated rows leave the groups they were in, new and updated ones enter those of their new ETag, unhashed.
    """
    left = _fingerprints(changes.where("change IN ('deleted', 'updated')"), -1)
    entered = _fingerprints(
        changes.where("change IN ('new', 'updated')").select(
            F.col("new_size").alias("size"), F.col("new_etag").alias("etag"), F.col("new_is_multipart").alias("is_multipart"),
            F.lit(None).cast("string").alias("sha256"),
        ), 1,
    )
    return _summed(union(counts.select(*_GROUP, "n", "multipart"), _summed(union(left, entered)))).where("n > 0")


def counts_after_hashing(counts: DataFrame, objects: DataFrame, hashes: DataFrame) -> DataFrame:
    """``group_counts`` after ``update_sha256(objects, hashes)``: each changed hash leaves one group and enters another."""
    key = ["bucket", "key"]
    found = objects.select(*key, "size", "sha256").join(
        hashes.where("sha256 IS NOT NULL").select(*key, F.col("sha256").alias("_sha")), key
    ).where("NOT sha256 <=> _sha")
    row = [F.lit(None).cast("string").alias("etag"), F.lit(False).alias("is_multipart")]
    left = _fingerprints(found.select("size", "sha256", *row), -1)
    entered = _fingerprints(found.select("size", F.col("_sha").alias("sha256"), *row), 1)
    return _summed(union(counts.select(*_GROUP, "n", "multipart"), _summed(union(left, entered)))).where("n > 0")


def stats_of_counts(counts: DataFrame) -> DataFrame:
    """The five totals of ``scan_stats`` from ``group_counts``: every object is in one ETag group."""
    in_etag = F.col("kind") == "etag"
    group = (F.col("n") > 1) & (~in_etag | (F.col("multipart") == 0))

    def total(value: Column, where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, value)), F.lit(0)).cast("long")

    return counts.agg(
        total(F.col("n"), in_etag).alias("total_objects"), total(F.col("n") * F.col("size"), in_etag).alias("total_size"),
        F.count_if(group).alias("duplicate_groups"), total(F.col("n") - 1, group).alias("duplicate_objects"),
        total(wasted_bytes(F.col("size"), F.col("n")), group).alias("wasted_bytes"),
    )


def folder_counts(keys: DataFrame) -> DataFrame:
    """(bucket, dir, n): how many keys lie in each folder, at any depth below it."""
    return keys.select("bucket", F.explode(ancestors(F.col("key"))).alias("dir")).groupBy("bucket", "dir").agg(
        F.count(F.lit(1)).alias("n")
    )


def _folder_changes(resolved: DataFrame) -> DataFrame:
    """(bucket, dir, change, gone): what the moves add to each folder, and how many keys leave it."""
    moved = moves(resolved)
    ways = F.array(
        F.struct(F.col("key").alias("key"), F.lit(-1).alias("change")), F.struct(F.col("target").alias("key"), F.lit(1).alias("change"))
    )
    each = moved.select("bucket", F.explode(ways).alias("w")).select("bucket", "w.change", F.explode(ancestors(F.col("w.key"))).alias("dir"))
    return each.groupBy("bucket", "dir").agg(
        F.sum("change").cast("long").alias("change"), F.count_if(F.col("change") < 0).alias("gone")
    )


def folders_after_rename(counts: DataFrame, resolved: DataFrame) -> DataFrame:
    """``folder_counts`` after the moves of ``resolved``."""
    changed = _folder_changes(resolved).select("bucket", "dir", F.col("change").alias("n"))
    return union(counts.select("bucket", "dir", "n"), changed).groupBy("bucket", "dir").agg(F.sum("n").alias("n")).where("n > 0")


def emptied_by_counts(counts: DataFrame, resolved: DataFrame) -> DataFrame:
    """(bucket, dir, depth) of the folders above moved keys that nothing is left in, from kept ``folder_counts``.

    Only moved keys name their folders; the folders of all others are in the counts. Equals ``emptied_folders``.
    """
    return (
        _folder_changes(resolved).where("gone > 0").join(counts, ["bucket", "dir"], "left")
        .where("coalesce(n, 0) + change <= 0")
        .select("bucket", "dir", folder_depth(F.col("dir")).alias("depth"))
    )
