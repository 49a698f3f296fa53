"""Byte-identical objects: size, then ETag, then SHA-256."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakedupes.functions.text import wasted_bytes
from lakedupes.operators.groups import join_groups
from lakedupes.unions import union

GROUP_COLUMNS = ["kind", "fingerprint", "size", "n", "wasted_bytes"]
MEMBER_COLUMNS = ["kind", "fingerprint", "size", "bucket", "key", "last_modified", "n",
                  "wasted_bytes"]
_GROUP_KEY = ["kind", "fingerprint", "size"]


def _count() -> Column:
    return F.count(F.lit(1)).alias("n")


def size_duplicates(objects: DataFrame) -> DataFrame:
    """Pass 1: objects whose size occurs more than once."""
    sizes = objects.groupBy("size").agg(_count()).where("n > 1")
    return join_groups(objects, sizes, ["size"])


def etag_groups(objects: DataFrame) -> DataFrame:
    """Repeated (etag, size) pairs; an equal size is part of being identical."""
    return (
        objects.groupBy("etag", "size")
        .agg(_count(), F.bool_or("is_multipart").alias("any_multipart"))
        .where("n > 1")
    )


def etag_duplicates(objects: DataFrame) -> DataFrame:
    """Pass 2: members of repeated ETags among objects of equal size."""
    rows = join_groups(
        objects.select("bucket", "key", "size", "etag", "is_multipart"),
        etag_groups(objects).drop("any_multipart"),
        ["etag", "size"],
    )
    return rows.select(
        F.col("etag").alias("fingerprint"), "size", "bucket", "key", "is_multipart", "n",
        wasted_bytes(F.col("size"), F.col("n")).alias("wasted_bytes"),
    )


def multipart_candidates(objects: DataFrame) -> DataFrame:
    """Pass 3 input: every object of a repeated size that has an unhashed multipart object."""
    unhashed = F.col("is_multipart") & F.col("sha256").isNull()
    sizes = (
        objects.groupBy("size")
        .agg(_count(), F.bool_or(unhashed).alias("_ambiguous"))
        .where("n > 1")
    )
    return join_groups(objects, sizes, ["size"], keep="_ambiguous").drop("n", "_ambiguous")


def hash_groups(objects: DataFrame) -> DataFrame:
    """Repeated content hashes."""
    return (
        objects.where(F.col("sha256").isNotNull())
        .groupBy("sha256", "size")
        .agg(_count())
        .where("n > 1")
    )


def hash_duplicates(objects: DataFrame) -> DataFrame:
    """Pass 3: members of repeated content hashes."""
    rows = join_groups(
        objects.where(F.col("sha256").isNotNull()).select("bucket", "key", "size", "sha256"),
        hash_groups(objects),
        ["sha256", "size"],
    )
    return rows.select(
        F.col("sha256").alias("fingerprint"), "size", "bucket", "key", "n",
        wasted_bytes(F.col("size"), F.col("n")).alias("wasted_bytes"),
    )


def duplicate_groups(objects: DataFrame) -> DataFrame:
    """One row per group: ETag groups without multipart members, and hash groups.

    An object may be in a group of either kind; ``exclusive_groups`` avoids that.
    """
    waste = wasted_bytes(F.col("size"), F.col("n")).alias("wasted_bytes")
    by_etag = (
        etag_groups(objects)
        .where("not any_multipart")
        .select(F.lit("etag").alias("kind"), F.col("etag").alias("fingerprint"), "size", "n", waste)
    )
    by_hash = hash_groups(objects).select(
        F.lit("sha256").alias("kind"), F.col("sha256").alias("fingerprint"), "size", "n", waste
    )
    return union(by_etag, by_hash)


def all_duplicates(objects: DataFrame) -> DataFrame:
    """One row per group member, for the groups of ``duplicate_groups``."""
    member = ["size", "bucket", "key", "last_modified"]
    by_etag = join_groups(
        objects.select("etag", *member),
        etag_groups(objects),
        ["etag", "size"],
        keep="not any_multipart",
    ).withColumns({"kind": F.lit("etag"), "fingerprint": F.col("etag")})
    by_hash = join_groups(
        objects.where(F.col("sha256").isNotNull()).select("sha256", *member),
        hash_groups(objects),
        ["sha256", "size"],
    ).withColumns({"kind": F.lit("sha256"), "fingerprint": F.col("sha256")})
    waste = {"wasted_bytes": wasted_bytes(F.col("size"), F.col("n"))}
    return union(*[
        part.withColumns(waste).select(MEMBER_COLUMNS) for part in (by_etag, by_hash)
    ])


_EVIDENCE = ["size", "etag", "is_multipart", "_sha"]


def _evidence(objects: DataFrame) -> DataFrame:
    """Objects with their hash made joinable: '' stands for not hashed."""
    return objects.withColumn("_sha", F.coalesce("sha256", F.lit("")))


def _identities(objects: DataFrame) -> DataFrame:
    """One row per distinct evidence: (size, etag, is_multipart, hash) with its content identity.

    Identity is the own hash, else the hash known for an equal (size, etag, is_multipart), else
    the ETag where that is a content hash, else unknown: ``fingerprint`` is NULL. Evidence for which several
    hashes are known could be any of them, so it is unknown too.
    """
    listed = ["size", "etag", "is_multipart"]
    hashed = (
        objects.where(F.col("sha256").isNotNull())
        .groupBy(*listed, F.col("sha256").alias("_sha"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("fingerprint", F.col("_sha"))
    )
    # Hashes are compared among hashed evidence only; counting the rest needs no sort.
    known = hashed.groupBy(*listed).agg(F.min("_sha").alias("_known"), F.max("_sha").alias("_other"))
    plain_etag = F.when(~F.col("is_multipart"), F.col("etag"))
    bare = (
        objects.where(F.col("sha256").isNull())
        .groupBy(*listed)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .join(known, listed, "left")
        .select(
            *listed, F.lit("").alias("_sha"), "_rows",
            F.when(F.col("_known").isNull(), plain_etag)
            .when(F.col("_known") == F.col("_other"), F.col("_known")).alias("fingerprint"),
        )
    )
    return union(hashed, bare)


def _exclusive(identities: DataFrame) -> DataFrame:
    return (
        identities.where("fingerprint is not null").groupBy("fingerprint", "size")
        .agg(F.sum("_rows").alias("n"), F.count(F.lit(1)).alias("_pairs"))
        .where("n > 1")
    )


def content_identity(objects: DataFrame) -> DataFrame:
    """Objects with their content identity as ``fingerprint``, NULL where it is unknown."""
    rows = join_groups(
        _evidence(objects), _identities(objects), _EVIDENCE, weight="_rows", how="left"
    )
    return rows.select(*objects.columns, "fingerprint")


def exclusive_groups(objects: DataFrame) -> DataFrame:
    """One row per set of identical objects; no object is in two sets."""
    return _exclusive(_identities(objects)).select(
        F.lit("content").alias("kind"), "fingerprint", "size", "n",
        wasted_bytes(F.col("size"), F.col("n")).alias("wasted_bytes"),
    )


def exclusive_duplicates(objects: DataFrame) -> DataFrame:
    """Members of ``exclusive_groups``: every key at most once.

    Identity is worked out on distinct evidence, not on objects, so whole sets of copies travel as
    one row until the final join back.
    """
    identities = _identities(objects)
    found = join_groups(
        identities.where("fingerprint is not null"), _exclusive(identities), ["fingerprint", "size"],
        weight="_pairs", how="left", spread=["etag", "_sha"],
    ).drop("_pairs")
    # Evidence without a group stays: where it is hot, its rows must be known to be dropped.
    unknown = identities.where("fingerprint is null").withColumn("n", F.lit(None).cast("long"))
    lookup = union(found, unknown)
    member = ["bucket", "key", "last_modified"]
    rows = join_groups(
        _evidence(objects).select(*_EVIDENCE, *member), lookup, _EVIDENCE, weight="_rows",
        keep="n is not null",
    )
    return rows.withColumns({
        "kind": F.lit("content"),
        "wasted_bytes": wasted_bytes(F.col("size"), F.col("n")),
    }).select(MEMBER_COLUMNS)


def scan_stats(objects: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Five totals in one row. ``groups`` has one row per group, default ``duplicate_groups``."""
    if groups is None:
        groups = duplicate_groups(objects)
    zero = F.lit(0).cast("long")
    one = F.lit(1).cast("long")
    all_objects = objects.select(
        one.alias("total_objects"), F.col("size").alias("total_size"),
        zero.alias("duplicate_groups"), zero.alias("duplicate_objects"),
        zero.alias("wasted_bytes"),
    )
    all_groups = groups.select(
        zero.alias("total_objects"), zero.alias("total_size"),
        one.alias("duplicate_groups"), (F.col("n") - 1).alias("duplicate_objects"),
        "wasted_bytes",
    )
    parts = union(all_objects, all_groups)
    return parts.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in parts.columns])
