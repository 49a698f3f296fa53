"""Bins of about equal size, in an order, over any number of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakedupes.operators.groups import shuffle_partitions
from lakedupes.staging import stage


def running_total(df: DataFrame, order: Sequence[str], weight: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``weight`` over all rows before each row by ``order`` (ascending, unique).

    Rows are range partitioned and staged with their piece, so that the cuts stay the same for both uses; each piece is
    summed alone and starts at the total of the earlier ones, one row per partition. A null weight counts as nothing.
    """
    order = list(order)
    parts = shuffle_partitions(df.sparkSession)
    weighed = df.withColumn("_weight", F.coalesce(weight.cast("long"), F.lit(0).cast("long")))
    cut, _ = stage(weighed.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("_part").agg(F.sum("_weight").alias("_sum")).select(
        "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    return (
        cut.withColumn("_inner", F.coalesce(F.sum("_weight").over(inside), zero))
        .join(F.broadcast(starts), "_part")  # one row per shuffle partition
        .withColumn(name, F.col("_start") + F.col("_inner"))
        .select(*df.columns, name)
    )


def content_bins(
    objects: DataFrame, target_bytes: int, open_bytes: int = 0, size: str = "size",
    order: Sequence[str] = ("bucket", "key"),
) -> DataFrame:
    """``objects`` with the ``bin`` (from 0) of each: runs of the order that hold ``target_bytes`` each.

    An object weighs its size and ``open_bytes``, what opening it costs. It lies in the bin in which it starts, so
    no bin holds more than the target and its last object, and a larger object is never cut. Bins in
    which no object starts are left out.
    """
    if target_bytes < 1:
        raise ValueError("target_bytes must be positive")
    placed = running_total(objects, order, F.col(size) + F.lit(open_bytes), "_before")
    return placed.select(*objects.columns, F.floor(F.col("_before") / F.lit(target_bytes)).cast("long").alias("bin"))


def spread_by_bin(binned: DataFrame) -> DataFrame:
    """One task per bin: rows go to the partition of their bin's number, and partitions are not merged again.

    The bins are staged, numbered without gaps (one row per bin), and dealt out by that number.
    """
    binned, n = stage(binned)
    if not n:
        return binned.drop("bin")
    numbers, bins = stage(running_total(binned.select("bin").distinct(), ["bin"], F.lit(1), "_task"))
    # One row per bin: as many as there will be tasks.
    placed = binned.join(F.broadcast(numbers), "bin")
    return placed.repartitionById(bins, F.col("_task").cast("int")).drop("bin", "_task")
