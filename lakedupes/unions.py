"""Unions that are safe under adaptive execution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

_SETTING = "spark.sql.unionOutputPartitioning"


def union(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union by name of frames with the same columns.

    Spark 4.1 plans as if a union kept the partitioning that its inputs share, and leaves out the
    shuffle above it. When adaptive execution then changes one input (a coalesced shuffle, a join
    turned into a broadcast), equal keys lie in different partitions, and a window, join or
    aggregate above the union gives wrong results without any error. That planning is switched off
    for the session; the price is the shuffle.
    """
    spark = first.sparkSession
    if spark.conf.get(_SETTING, "true") != "false":
        spark.conf.set(_SETTING, "false")
    return reduce(DataFrame.unionByName, others, first)
