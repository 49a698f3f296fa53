"""An index that is read through a change log.

``base/seq=N`` holds index and media as of change N; ``log/seq=M`` the changes of one batch. A reader merges the newest
whole base with the log behind it, one join; a batch only writes its changes. When the log has grown to a share of the base,
``compact`` writes the merged tables as the next base. A folder counts once its ``_SUCCESS`` file is there, so a writer that
dies leaves nothing that is read, and a batch that runs again writes the same folder.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lakedupes.operators.index import KEY, latest
from lakedupes.schema import MEDIA, OBJECTS, conform

# A deletion needs no more than its key.
CHANGES = T.StructType([
    *[T.StructField(f.name, f.dataType, f.name not in ("bucket", "key")) for f in OBJECTS if f.name not in ("sha256", "scanned_at")],
    T.StructField("deleted", T.BooleanType()),
])


def last_changes(changes: DataFrame, order_by: Sequence[str] = ("last_modified",)) -> DataFrame:
    """One row per key, the last change by ``order_by``.

    A deletion is later than a write of equal order, and so is a deletion without any order; a write without one is
    earlier than all others.
    """
    if "deleted" not in changes.columns:
        changes = changes.withColumn("deleted", F.lit(False))
    changes = changes.withColumn("deleted", F.coalesce("deleted", F.lit(False)))
    unordered = reduce(or_, [F.col(c).isNull() for c in order_by], F.lit(False))
    marked = changes.withColumn("_open", F.col("deleted") & unordered)
    return latest(marked, KEY, ["_open", *order_by, "deleted"]).drop("_open")


def merge_log(
    index: DataFrame, media: DataFrame, log: DataFrame, scanned_at: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Index and media after ``log`` (``CHANGES`` and ``seq``; one row per key and seq): the last change of a key counts.

    Deleted keys go, with their media rows. A key written with the ETag it has in the index keeps its row, its hash and its
    media row; with another it starts anew. One join per table.
    """
    now = F.localtimestamp() if scanned_at is None else scanned_at
    state = [f.name for f in CHANGES if f.name not in KEY]
    last = latest(log.select(*KEY, *state, "seq"), KEY, ["seq"]).select(
        *KEY, *[F.col(c).alias(f"_{c}") for c in state], F.lit(True).alias("_changed")
    )
    joined = conform(index, OBJECTS).withColumn("_known", F.lit(True)).join(last, KEY, "full_outer")
    fresh = F.coalesce(F.col("_changed") & ~(F.col("_known").isNotNull() & F.col("_etag").eqNullSafe(F.col("etag"))), F.lit(False))
    merged = joined.where("NOT coalesce(_deleted, false)").select(
        *KEY, *[F.when(fresh, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("size", "etag", "is_multipart")],
        F.when(~fresh, F.col("sha256")).alias("sha256"),
        F.when(fresh, F.col("_last_modified")).otherwise(F.col("last_modified")).alias("last_modified"),
        F.when(fresh, now).otherwise(F.col("scanned_at")).alias("scanned_at"),
    )
    stale = joined.where(F.coalesce("_deleted", F.lit(False)) | fresh).select(KEY)
    return conform(merged, OBJECTS), conform(media, MEDIA).join(stale, KEY, "left_anti")


def _whole(spark: SparkSession, folder: str) -> list[int]:
    """Sequence numbers of the finished folders, rising."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = [s.getPath().getName() for s in files.listStatus(root)]
    done = [n for n in names if n.startswith("seq=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix("seq=")) for n in done)


def _write(table: DataFrame, path: str) -> None:
    """Rows sorted by key within files, so that a reader's filters on keys skip most of them."""
    table.sortWithinPartitions(*KEY).write.mode("overwrite").parquet(path)


def _write_base(index: DataFrame, media: DataFrame, path: str, seq: int) -> None:
    # The media table is whole before the base counts, which it does by the index table's file.
    _write(conform(media, MEDIA), f"{path}/media/seq={seq:012d}")
    _write(conform(index, OBJECTS), f"{path}/base/seq={seq:012d}")


def start_log(index: DataFrame, media: DataFrame, path: str) -> None:
    """The first base."""
    _write_base(index, media, path.rstrip("/"), 0)


def append_changes(changes: DataFrame, path: str, seq: int, order_by: Sequence[str] = ("last_modified",)) -> None:
    """Write the changes of batch ``seq`` (from 1), the last one of each key. Written again, it replaces itself."""
    _write(conform(last_changes(changes, order_by), CHANGES), f"{path.rstrip('/')}/log/seq={seq:012d}")


def _parts(spark: SparkSession, path: str) -> tuple[int, DataFrame, DataFrame, DataFrame, list[int]]:
    path = path.rstrip("/")
    bases = _whole(spark, f"{path}/base")
    if not bases:
        raise ValueError(f"no index at {path}: call start_log first")
    base = bases[-1]
    behind = [n for n in _whole(spark, f"{path}/log") if n > base]
    index = spark.read.schema(OBJECTS).parquet(f"{path}/base/seq={base:012d}")
    media = spark.read.schema(MEDIA).parquet(f"{path}/media/seq={base:012d}")
    schema = T.StructType([*CHANGES, T.StructField("seq", T.LongType())])
    if behind:
        log = spark.read.schema(schema).option("basePath", f"{path}/log").parquet(*[f"{path}/log/seq={n:012d}" for n in behind])
    else:
        log = spark.createDataFrame([], schema)
    return base, index, media, log, behind


def read_merged(spark: SparkSession, path: str, scanned_at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Index and media as of the last batch, merged on reading."""
    _, index, media, log, behind = _parts(spark, path)
    return merge_log(index, media, log, scanned_at) if behind else (index, media)


def compact(spark: SparkSession, path: str, share: float = 0.1) -> bool:
    """Write the merged tables as the next base if the log holds ``share`` of the base's rows; whether it did.

    Earlier bases and the log stay for readers that have begun with them; nothing is removed.
    """
    _, index, media, log, behind = _parts(spark, path)
    if not behind or log.count() < share * index.count():
        return False
    _write_base(*merge_log(index, media, log), path.rstrip("/"), behind[-1])
    return True


def follow_log(
    changes: DataFrame, path: str, checkpoint: str, order_by: Sequence[str] = ("last_modified",), share: float = 0.1
) -> StreamingQuery:
    """Append every micro-batch of a stream to the log, and compact it by ``share``.

    A batch costs its own size, not that of the index; run again after a failure it writes the same folder.
    """
    def append(batch: DataFrame, number: int) -> None:
        append_changes(batch, path, number + 1, order_by)
        compact(batch.sparkSession, path, share)

    return (
        changes.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
