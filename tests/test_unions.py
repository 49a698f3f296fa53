from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakedupes.unions import union
from tests.conftest import rows


def test_window_above_a_union_of_inputs_with_one_partitioning(spark):
    """Adaptive execution may change one input's partitions; numbering must not notice."""
    left = spark.range(60).selectExpr("id % 5 AS g", "id AS v").groupBy("g").agg(
        F.min("v").alias("v")
    )
    other = spark.range(40).selectExpr("id % 5 AS g", "id + 100 AS v")
    few = spark.range(5).selectExpr("id AS g")
    right = other.groupBy("g", "v").count().drop("count").join(few, "g", "left_semi")
    numbered = union(left, right).withColumn(
        "n", F.row_number().over(Window.partitionBy("g").orderBy("v"))
    )
    assert spark.conf.get("spark.sql.unionOutputPartitioning") == "false"
    assert rows(numbered.groupBy("g").agg(F.max("n"), F.count("n"))) == [
        (g, 9, 9) for g in range(5)
    ]
