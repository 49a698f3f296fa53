"""Index tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def save_index(df: DataFrame, name: str, buckets: int, path: str | None = None) -> None:
    """Save an index table bucketed by object key.

    Difference, upsert, delete and hash update all join on (bucket, key). With both sides bucketed
    alike, or with a small change set, the index itself is never shuffled again. ``buckets`` should
    give files of some hundred MB.
    """
    writer = (
        df.repartition(buckets, "bucket", "key")
        .write.bucketBy(buckets, "bucket", "key").sortBy("bucket", "key")
        .format("parquet").mode("overwrite")
    )
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def write_snapshot(df: DataFrame, base: str, version: int) -> str:
    """Write a version of a table beside the earlier ones; the version that was read stays whole."""
    path = f"{base.rstrip('/')}/version={version:08d}"
    df.write.mode("overwrite").parquet(path)
    return path


def read_snapshot(spark: SparkSession, base: str, version: int) -> DataFrame:
    """Read one version of a table."""
    return spark.read.parquet(f"{base.rstrip('/')}/version={version:08d}")
