"""The same work in different encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakedupes.operators.groups import join_groups


def same_work_groups(objects: DataFrame, media: DataFrame) -> DataFrame:
    """Objects whose (artist, title) tags occur on more than one media row.

    Repetition counts media rows, also those whose object is gone.
    """
    tagged = media.where("artist is not null and title is not null")
    pairs = tagged.groupBy("artist", "title").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = tagged.select("bucket", "key", "artist", "title", "codec", "bitrate").join(
        objects.select("bucket", "key", "size"), ["bucket", "key"]
    )
    return join_groups(rows, pairs, ["artist", "title"]).select(
        "artist", "title", "bucket", "key", "codec", "bitrate", "size", "n"
    )
