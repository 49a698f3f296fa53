"""Row numbers without gathering a group, or the whole table, in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakedupes.operators.groups import shuffle_partitions
from lakedupes.staging import stage


def spread_row_number(
    df: DataFrame, group: Sequence[str], order: Sequence[str], name: str
) -> DataFrame:
    """``row_number`` per ``group`` by ``order`` (ascending; the pair must be unique), spread out.

    Rows are range partitioned on (group, order), which cuts a huge group into consecutive pieces,
    and staged with their piece number, so that the cuts stay the same for both uses below and after
    an executor is lost. Each piece is numbered alone; a piece starts after the earlier pieces of its
    group. Only a group that crosses a cut has an offset, so at most one per partition is broadcast.
    """
    parts = shuffle_partitions(df.sparkSession)
    group, order = list(group), list(order)
    cut, _ = stage(
        df.repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id())
    )
    pieces = cut.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_rows"))
    # Null-safe join keys: one struct per group, comparable as a whole.
    label = F.struct(*group) if group else F.struct(F.lit(0))
    across = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    earlier = across.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        pieces.withColumn("_before", F.sum("_rows").over(earlier))
        .where(F.col("_before").isNotNull())
        .select(F.col("_part"), label.alias("_group"), "_before")
    )
    inside = Window.partitionBy("_part", *group).orderBy(*order)
    numbered = cut.withColumn("_at", F.row_number().over(inside)).withColumn("_group", label)
    return (
        numbered.join(F.broadcast(offsets), ["_part", "_group"], "left")
        .withColumn(name, F.col("_at") + F.coalesce("_before", F.lit(0)))
        .select(*df.columns, name)
    )


def _signed(order: Sequence[str]) -> list[Column]:
    return [F.col(o[1:]) * -1 if o.startswith("-") else F.col(o) for o in order]


def number_rows(df: DataFrame, order: Sequence[str], name: str = "group_no") -> DataFrame:
    """1..n over the whole table in ``order`` (column names, ``-`` in front for descending)."""
    keyed = df.withColumns({f"_o{i}": c for i, c in enumerate(_signed(order))})
    numbered = spread_row_number(keyed, [], [f"_o{i}" for i in range(len(order))], name)
    return numbered.select(name, *df.columns)


def ordered_rows(df: DataFrame, order: Sequence[str], group: int = 0) -> tuple[DataFrame, int]:
    """``df`` with ``position``, 1..n in ``order`` (as for ``number_rows``, unique), and ``first``: whether the row is the first one
    with its values of the first ``group`` columns of ``order``; and n.

    Rows are range partitioned on all of ``order``, so that a group of any size spans as many tasks as it needs. What a task must know
    of those before it, their number of rows and the last group, is one row per partition.
    """
    by = [f"_o{i}" for i in range(len(order))]
    keyed = df.withColumns(dict(zip(by, _signed(order), strict=True)))
    parts = shuffle_partitions(df.sparkSession)
    cut, total = stage(keyed.repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()))
    label = F.struct(F.lit(0), *by[:group])
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    edges = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), F.max(label).alias("_last")).select(
        "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"), F.max("_last").over(earlier).alias("_previous")
    )
    inside = Window.partitionBy("_part").orderBy(*by)
    numbered = cut.withColumns({"_at": F.row_number().over(inside), "_label": label, "_above": F.lag(label).over(inside)})
    return numbered.join(F.broadcast(edges), "_part").select(
        (F.col("_at") + F.col("_before")).alias("position"),
        (~F.col("_label").eqNullSafe(F.coalesce("_above", "_previous"))).alias("first"), *df.columns,
    ), total
