"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakedupes.operators.groups import join_counted
from lakedupes.staging import stage
from lakedupes.unions import union


def components(links: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``links`` (a, b: long); root is the least vertex of its component.

    In each round every vertex points to its least neighbour, pointers are followed once more, and
    links are moved to the vertices pointed at. Links within one vertex go; the least vertex of a component never
    moves. Each round at least halves the vertices of a component that are not local minima, and each round's tables are
    written to the shared folder. Links and labels never leave the executors, and a vertex that a large share of the
    links or labels point to is split over tasks.
    """
    edges, n = stage(links.select("a", "b").where("a <> b").distinct())
    labels = None
    while n:
        both = union(edges, edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents, _ = stage(
            both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("p"))
        )
        further = parents.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        parents, _ = stage(join_counted(parents, further, ["p"], ["v"]).select("v", F.col("pp").alias("p")))
        if labels is None:
            labels = parents.select("v", F.col("p").alias("root"))
        else:
            moved = parents.select(F.col("v").alias("root"), "p")
            labels = join_counted(labels, moved, ["root"], ["v"], "left").select("v", F.coalesce("p", "root").alias("root"))
        labels, _ = stage(labels)
        ends = parents.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        others = parents.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        half, _ = stage(join_counted(edges, ends, ["a"], ["b"]))
        edges, n = stage(
            join_counted(half, others, ["b"], ["a"]).where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        )
    if labels is None:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return labels
