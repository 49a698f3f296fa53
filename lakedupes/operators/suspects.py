"""Equal names, different content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakedupes.functions.names import with_normalized_name
from lakedupes.operators.groups import join_groups


def suspect_names(objects: DataFrame, identity: str = "etag") -> DataFrame:
    """Objects that share a normalised name with an object of another ``identity``.

    ``identity`` is the column that tells contents apart: ``etag``, or any column of content
    fingerprints. That a group holds two different values is seen from its least and greatest.
    """
    columns = list(dict.fromkeys(["bucket", "key", "size", "etag", identity]))
    named = with_normalized_name(objects.select(columns))
    names = (
        named.groupBy("normalized")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(identity).alias("_least"),
            F.max(identity).alias("_greatest"),
        )
        .where("n > 1")
    )
    return join_groups(named, names, ["normalized"], keep="_least <> _greatest").select("normalized", *columns, "n")
