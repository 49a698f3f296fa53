"""Keeping the index: snapshot difference, upsert, delete, update."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakedupes.schema import BUCKET_CONFIG, MEDIA, OBJECTS, conform
from lakedupes.sources.listing import under_prefix
from lakedupes.unions import union

KEY = ["bucket", "key"]


def snapshot_diff(
    index: DataFrame, listing: DataFrame, prefix: str = "", bucket: str | None = None
) -> DataFrame:
    """(bucket, key, change, old_etag, new_etag) for every key of either side below the prefix.

    Keys that the index has and the listing lacks are deleted, but only where the listing looked:
    below ``prefix``, in ``bucket``. Of several listing rows of one key the last modified counts. A listing row
    without an ETag is an update: nothing shows that the object is the same.
    """
    old = under_prefix(index, prefix, bucket).select(
        *KEY, F.col("etag").alias("old_etag"), F.lit(True).alias("_known")
    )
    new = _once(under_prefix(listing, prefix, bucket)).select(
        *KEY, F.col("etag").alias("new_etag"), F.lit(True).alias("_listed")
    )
    change = (
        F.when(F.col("_known").isNull(), "new")
        .when(F.col("_listed").isNull(), "deleted")
        .when(F.col("old_etag") == F.col("new_etag"), "unchanged")
        .otherwise("updated")
    )
    return old.join(new, KEY, "full_outer").select(
        *KEY, change.alias("change"), "old_etag", "new_etag"
    )


def _once(listing: DataFrame) -> DataFrame:
    """One row per key: the last modified, then the greatest by ETag and size."""
    order = [c for c in ("last_modified", "etag", "size") if c in listing.columns]
    return latest(listing, KEY, order)


def scan_result(diff: DataFrame) -> DataFrame:
    """Counts of new, updated and deleted keys in one row."""
    return diff.agg(*[
        F.count_if(F.col("change") == change).alias(name)
        for name, change in (("new", "new"), ("updated", "updated"), ("deleted", "deleted"))
    ])


_STATE = ("size", "etag", "is_multipart", "last_modified")


def classified(
    index: DataFrame, listing: DataFrame, prefix: str = "", bucket: str | None = None
) -> DataFrame:
    """The index joined with a listing: bucket, key, ``change``, the index row, and the listed state as ``new_*``.

    ``change`` is null for index rows outside the prefix or bucket. One full outer join on the key tells the result of a
    scan, the new index and the keys that lose their media rows; on tables bucketed by key (``save_index``)
    the index side needs no shuffle.
    """
    unsure = F.col("etag").isNull()
    new = _once(under_prefix(listing, prefix, bucket)).select(
        *KEY, (~unsure).alias("_sure"), F.col("size").alias("new_size"), F.coalesce("etag", F.lit("")).alias("new_etag"),
        (F.col("is_multipart") | unsure).alias("new_is_multipart"), F.col("last_modified").alias("new_last_modified"),
    )
    old = conform(index, OBJECTS).withColumn("_known", F.lit(True))
    in_scope = F.col("key").startswith(prefix)
    if bucket is not None:
        in_scope = in_scope & (F.col("bucket") == bucket)
    change = (
        F.when(F.col("_sure").isNull(), F.when(in_scope, "deleted"))
        .when(F.col("_known").isNull(), "new")
        .when(F.col("_sure") & (F.col("etag") == F.col("new_etag")), "unchanged")
        .otherwise("updated")
    )
    return old.join(new, KEY, "full_outer").withColumn("change", change).drop("_sure", "_known")


def index_of(rows: DataFrame, scanned_at: Column | None = None) -> DataFrame:
    """The index after the scan that ``classified`` describes."""
    now = F.localtimestamp() if scanned_at is None else scanned_at
    fresh = F.coalesce(F.col("change").isin("new", "updated"), F.lit(False))
    state = {c: F.when(fresh, F.col(f"new_{c}")).otherwise(F.col(c)) for c in _STATE}
    return conform(rows.where("change IS NULL OR change <> 'deleted'").withColumns({
        **state, "sha256": F.when(~fresh, F.col("sha256")), "scanned_at": F.when(fresh, now).otherwise(F.col("scanned_at")),
    }), OBJECTS)


def media_of(media: DataFrame, rows: DataFrame) -> DataFrame:
    """The media rows that stay after the scan that ``classified`` describes."""
    gone = rows.where("change IN ('deleted', 'updated')").select(KEY)
    return media.join(gone, KEY, "left_anti")


def apply_listing(
    index: DataFrame,
    media: DataFrame,
    listing: DataFrame,
    prefix: str = "",
    bucket: str | None = None,
    scanned_at: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The index and media tables after a scan.

    Unchanged rows keep their hash. New and changed rows start without one. Deleted rows go, and
    the media rows of deleted and changed keys with them. Repeated listing rows and rows without an ETag
    are taken as in ``snapshot_diff``; an object whose ETag is unknown has an empty one and counts as multipart, so that only
    its content decides. ``classified`` joins index and listing; ``scan`` stages what it gives and uses it thrice.
    """
    rows = classified(index, listing, prefix, bucket)
    return index_of(rows, scanned_at), media_of(media, rows)


def latest(rows: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key, the last by ``order_by``. An aggregate, so a repeated key costs no task."""
    rest = [c for c in rows.columns if c not in (*keys, *order_by)]
    pick = F.max(F.struct(*order_by, *rest)).alias("_last")
    return rows.groupBy(*keys).agg(pick).select(
        *[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in rows.columns]
    )


def upsert(
    table: DataFrame, rows: DataFrame, keys: Sequence[str], order_by: Sequence[str] = ()
) -> DataFrame:
    """``table`` with ``rows`` added or replacing the rows of equal key.

    With ``order_by`` (columns of ``rows``, which ``table`` need not have) the last of several rows
    with one key wins; without it the keys of ``rows`` must be unique.
    """
    keys = list(keys)
    if order_by:
        rows = latest(rows, keys, order_by)
    return union(
        table.join(rows.select(keys), keys, "left_anti"), rows.select(table.columns)
    )


def upsert_objects(
    objects: DataFrame, rows: DataFrame, order_by: Sequence[str] = (),
    scanned_at: Column | None = None,
) -> DataFrame:
    """Upsert index rows. A row without a hash clears the stored one: the object is hashed again."""
    now = F.localtimestamp() if scanned_at is None else scanned_at
    rows = rows.withColumn("scanned_at", now)
    if "sha256" not in rows.columns:
        rows = rows.withColumn("sha256", F.lit(None).cast("string"))
    return upsert(conform(objects, OBJECTS), rows, KEY, order_by)


def upsert_media(media: DataFrame, rows: DataFrame, order_by: Sequence[str] = ()) -> DataFrame:
    """Upsert tag rows."""
    return upsert(conform(media, MEDIA), rows, KEY, order_by)


def upsert_config(
    config: DataFrame, rows: DataFrame, updated_at: Column | None = None
) -> DataFrame:
    """Upsert bucket endpoints, with the ``previous`` one where it was set and is now another."""
    now = F.localtimestamp() if updated_at is None else updated_at
    old = conform(config, BUCKET_CONFIG).select(
        "bucket", F.col("endpoint_url").alias("_old"), F.col("updated_at").alias("_at")
    )
    new = rows.select("bucket", "endpoint_url", F.lit(True).alias("_given"))
    changed = (
        F.col("_given") & F.col("_old").isNotNull()
        & ~F.col("_old").eqNullSafe(F.col("endpoint_url"))
    )
    return old.join(new, "bucket", "full_outer").select(
        "bucket",
        F.when(F.col("_given"), F.col("endpoint_url")).otherwise(F.col("_old"))
        .alias("endpoint_url"),
        F.when(F.col("_given"), now).otherwise(F.col("_at")).alias("updated_at"),
        F.when(changed, F.col("_old")).alias("previous"),
    )


def delete_objects(
    objects: DataFrame, media: DataFrame, keys: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given (bucket, key) rows."""
    gone = keys.select(KEY)
    return objects.join(gone, KEY, "left_anti"), media.join(gone, KEY, "left_anti")


def update_sha256(objects: DataFrame, hashes: DataFrame) -> DataFrame:
    """Store content hashes (bucket, key, sha256); a NULL hash changes nothing."""
    found = hashes.select(*KEY, F.col("sha256").alias("_sha"))
    return objects.join(found, KEY, "left").select([
        F.coalesce("_sha", "sha256").alias("sha256") if c == "sha256" else F.col(c)
        for c in objects.columns
    ])
