"""Listings and index reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakedupes.functions.text import is_multipart_etag
from lakedupes.operators.groups import shuffle_partitions
from lakedupes.schema import LISTING


def normalize_listing(listing: DataFrame, bucket: str | None = None, prefix: str = "") -> DataFrame:
    """Listing rows as index columns, without empty objects (folder markers).

    Takes the store's column names (Key, Size, ETag, LastModified), in any case. The bucket is the
    argument, or a column of the listing. A boolean column ``deleted`` (change events) is kept; such
    rows need no size and no ETag.
    """
    owner = F.col("bucket") if bucket is None else F.lit(bucket)
    modified = "LastModified" if "lastmodified" in map(str.lower, listing.columns) else (
        "last_modified"
    )
    present = F.col("size") > 0
    events = []
    if "deleted" in listing.columns:
        events = [F.coalesce("deleted", F.lit(False)).alias("deleted")]
        present = present | F.col("deleted")
    rows = listing.select(
        owner.alias("bucket"),
        F.col("Key").alias("key"),
        F.col("Size").cast("long").alias("size"),
        F.col("ETag").alias("etag"),
        is_multipart_etag(F.col("ETag")).alias("is_multipart"),
        F.col(modified).cast("timestamp_ntz").alias("last_modified"),
        *events,
    ).where(present)
    return rows.where(F.col("key").startswith(prefix)) if prefix else rows


def read_listing(
    spark: SparkSession,
    path: str | list[str],
    fmt: str = "parquet",
    bucket: str | None = None,
    prefix: str = "",
    **options: str,
) -> DataFrame:
    """Read a listing in any tabular format, with the declared schema.

    Formats other than Parquet and ORC need ``bucket``, because their listings have no such column.
    """
    reader = spark.read.format(fmt)
    if fmt not in ("parquet", "orc"):
        reader = reader.schema(LISTING)
    if fmt == "csv":
        options = {"header": "true", "escape": '"', "multiLine": "true", **options}
    return normalize_listing(reader.options(**options).load(path), bucket, prefix)


def read_files(spark: SparkSession, root: str, bucket: str, prefix: str = "") -> DataFrame:
    """List a folder of any file system as if it were a bucket. No content is read.

    File systems give no ETag. The one made here changes with the file and is marked multipart:
    it never matches another file, so only a content hash can prove two files equal.
    """
    base = root.rstrip("/") + "/"
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "length", "modificationTime")
        .where("length > 0")
    )
    # Paths come back as URIs: cut at the root, whatever scheme was added in front.
    plain = base.split("://", 1)[-1]
    key = F.substr(
        F.col("path"), F.locate(plain, F.col("path")) + F.lit(len(plain))
    )
    version = F.md5(F.concat_ws("|", "path", "length", "modificationTime"))
    rows = files.select(
        F.lit(bucket).alias("bucket"),
        key.alias("key"),
        F.col("length").alias("size"),
        F.concat(F.lit('"'), version, F.lit('-0"')).alias("etag"),
        F.lit(True).alias("is_multipart"),
        F.col("modificationTime").cast("timestamp_ntz").alias("last_modified"),
        "path",
    )
    return rows.where(F.col("key").startswith(prefix)) if prefix else rows


def under_prefix(objects: DataFrame, prefix: str = "", bucket: str | None = None) -> DataFrame:
    """Objects of a bucket below a literal prefix; both tests reach the Parquet scan."""
    if bucket is not None:
        objects = objects.where(F.col("bucket") == bucket)
    return objects.where(F.col("key").startswith(prefix)) if prefix else objects


def keys_with_etags(objects: DataFrame, prefix: str = "", bucket: str | None = None) -> DataFrame:
    """(bucket, key, etag) below a prefix."""
    return under_prefix(objects, prefix, bucket).select("bucket", "key", "etag")


def all_keys(objects: DataFrame, prefix: str = "", bucket: str | None = None) -> DataFrame:
    """(bucket, key) below a prefix."""
    return under_prefix(objects, prefix, bucket).select("bucket", "key")


def with_endpoint(df: DataFrame, config: DataFrame, given: str | None = None) -> DataFrame:
    """Add ``endpoint_url``: the given one, else the one stored for the row's bucket.

    One bucket may hold most rows, so the join must not gather rows by bucket: the config table is
    repeated, and the rows of a bucket are spread over its copies. Spark broadcasts it by itself where it
    sees at run time that it is small.
    """
    if given is not None:
        return df.withColumn("endpoint_url", F.lit(given))
    stored = config.select("bucket", "endpoint_url")
    parts = shuffle_partitions(df.sparkSession)
    copies = stored.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    spread = df.withColumn("_copy", F.pmod(F.xxhash64(*df.columns), F.lit(parts)).cast("int"))
    return spread.join(copies, ["bucket", "_copy"], "left").drop("_copy")
