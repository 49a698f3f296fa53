"""Listing changes as a stream.

A listing arrives page by page. Each page is appended to a change log by the exactly-once file sink,
which costs as much as the page; the log is folded into the index when it is worth a rewrite.
``follow`` folds every micro-batch at once, for small indexes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lakedupes.operators.index import KEY, latest, upsert_objects
from lakedupes.schema import LISTING
from lakedupes.sinks.tables import read_snapshot, write_snapshot
from lakedupes.sources.listing import normalize_listing
from lakedupes.unions import union


def listing_stream(
    spark: SparkSession, path: str, bucket: str | None = None, prefix: str = "",
    fmt: str = "parquet", schema: T.StructType = LISTING, **options: str,
) -> DataFrame:
    """Stream of listing rows from the files that appear in ``path``.

    A boolean column ``deleted`` in ``schema`` marks keys that are gone; without it a stream of
    pages only adds and changes, because a page cannot prove that a key is missing.
    """
    raw = spark.readStream.format(fmt).schema(schema).options(**options).load(path)
    return normalize_listing(raw, bucket, prefix)


def log_changes(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the stream to a change log; stops when all present files are read."""
    return (
        changes.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def fold_changes(
    index: DataFrame, media: DataFrame, changes: DataFrame,
    order_by: Sequence[str] = ("last_modified",),
) -> tuple[DataFrame, DataFrame]:
    """The index and media tables after ``changes``: the last change of each key counts.

    ``order_by`` should name a sequence or event time of the log. At equal order a deletion is later than a write, and so is
    a deletion without any order; a write without one is earlier than all others. A key seen again with its known
    ETag keeps its row and its hash.
    """
    if "deleted" not in changes.columns:
        changes = changes.withColumn("deleted", F.lit(False))
    unordered = reduce(or_, [F.col(c).isNull() for c in order_by], F.lit(False))
    marked = changes.withColumn("_open", F.col("deleted") & unordered)
    last = latest(marked, KEY, ["_open", *order_by, "deleted"]).drop("_open")
    known = index.select(*KEY, F.col("etag").alias("_etag"))
    fresh = (
        last.where(~F.col("deleted")).join(known, KEY, "left")
        .where(~F.col("etag").eqNullSafe(F.col("_etag"))).drop("_etag", "deleted")
    )
    removed = last.where("deleted").select(KEY)
    stay = index.join(removed, KEY, "left_anti")
    stale = union(removed, fresh.select(KEY))
    return upsert_objects(stay, fresh), media.join(stale, KEY, "left_anti")


def follow(
    changes: DataFrame, index_base: str, media_base: str, checkpoint: str,
    order_by: Sequence[str] = ("last_modified",),
) -> StreamingQuery:
    """Fold every micro-batch into the next version of both tables.

    Version 0 must be there. Batch b reads version b and writes version b + 1, so a batch that is
    run again after a failure writes the same version from the same input.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        index, media = fold_changes(
            read_snapshot(spark, index_base, number), read_snapshot(spark, media_base, number),
            batch, order_by,
        )
        write_snapshot(index, index_base, number + 1)
        write_snapshot(media, media_base, number + 1)

    return (
        changes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
