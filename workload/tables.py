"""Index tables derived from the ``documents`` table: each document stands for a stored object."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakedupes.operators.groups import join_groups
from lakedupes.staging import stage

_KEY = r"""
'Music/'||lang||'/'||source
 ||CASE doc_id%3 WHEN 1 THEN ' ['||CAST(1000+doc_id%2 AS STRING)||'] [2020]'
                 WHEN 2 THEN ' ['||CAST(2000+doc_id%2 AS STRING)||']' ELSE '' END
 ||'/d'||CAST(doc_id AS STRING)||'/'||CASE WHEN doc_id%13=0 THEN ' ' ELSE '' END
 ||'track'||CAST(doc_id%40 AS STRING)
 ||CASE doc_id%6 WHEN 1 THEN ' (1)' WHEN 2 THEN '_copy' WHEN 3 THEN ' - Copie'
                 WHEN 4 THEN '_2' WHEN 5 THEN '  été' ELSE '' END
 ||CASE WHEN doc_id%3=0 THEN '.jpg' WHEN doc_id%5=0 THEN '.flac' WHEN doc_id%5=1 THEN '.MP3'
        WHEN doc_id%5=2 THEN '.mkv' ELSE '' END
"""

_MODIFIED = """
TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, CAST((doc_id*37)%1000 AS INT), 0, 0)
"""

_RENAME_KEY = r"""
'dir'||CAST((doc_id div 5)%10 AS STRING)||CASE WHEN (doc_id div 5)%3=0 THEN ' ' ELSE '' END||'/'
 ||CASE doc_id%5 WHEN 1 THEN ' ' ELSE '' END||'item'||CAST((doc_id div 5) AS STRING)
 ||CASE doc_id%5 WHEN 2 THEN '.txt ' WHEN 3 THEN char(92)||'.txt' WHEN 4 THEN '_2.txt'
                 ELSE '.txt' END
"""


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def build_objects(spark: SparkSession, folder: str) -> DataFrame:
    """The object index of ``documents``, in the state after the content pass.

    Hashes are taken where the text lies; no text is shuffled.
    """
    multipart = F.col("doc_id") % 4 == 0
    parts = F.when(multipart, F.concat(F.lit("-"), (2 + F.col("doc_id") % 8).cast("string")))
    rows = documents(spark, folder).select(
        "doc_id",
        F.lit("main").alias("bucket"),
        F.expr(_KEY).alias("key"),
        F.octet_length("text").cast("long").alias("size"),
        F.concat(F.lit('"'), F.md5("text"), F.coalesce(parts, F.lit("")), F.lit('"')).alias("etag"),
        multipart.alias("is_multipart"),
        F.sha2("text", 256).alias("sha256"),
        F.expr(_MODIFIED).alias("last_modified"),
    )
    sizes = (
        rows.groupBy("size")
        .agg(F.count(F.lit(1)).alias("n"), F.bool_or("is_multipart").alias("_hash"))
        .where("n > 1")
    )
    marked = join_groups(rows, sizes, ["size"], how="left", spread=["doc_id"])
    return marked.withColumn("sha256", F.when(F.col("_hash"), F.col("sha256"))).select(rows.columns)


_stored: dict[tuple[str, str], DataFrame] = {}
_lock = threading.Lock()


def objects(spark: SparkSession, folder: str, hashed: bool = False) -> DataFrame:
    """The stored object index; with ``hashed`` in the state after the content pass, else before it.

    The index is built from the whole ``documents`` table by the first query of a session that
    needs it, and read from the shared folder by the others, as an index is meant to be.
    """
    at = (spark.sparkContext.applicationId, folder)
    with _lock:
        if at not in _stored:
            _stored[at] = stage(build_objects(spark, folder))[0]
    rows = _stored[at]
    return rows if hashed else rows.withColumn("sha256", F.lit(None).cast("string"))


def media(objects: DataFrame) -> DataFrame:
    """Tag rows of the media objects."""
    i = F.col("doc_id")
    return objects.where("doc_id % 3 <> 0 and doc_id % 5 in (0, 1, 2)").select(
        "doc_id", "bucket", "key",
        F.regexp_extract("key", r"^Music/[^/]*/(src[0-9]+)", 1).alias("artist"),
        F.concat(F.lit("Album "), (i % 7).cast("string")).alias("album"),
        F.when(i % 17 != 0, F.concat(F.lit("Title "), (i % 60).cast("string"))).alias("title"),
        (i % 300).cast("double").alias("duration_s"),
        F.when(i % 5 == 0, "flac").when(i % 5 == 1, "mp3").alias("codec"),
        (128 + 64 * (i % 4)).alias("bitrate"),
    )


def rename_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that need cleaning, five per target family."""
    return documents(spark, folder).select(
        "doc_id", F.lit("main").alias("bucket"), F.expr(_RENAME_KEY).alias("key")
    )


def previous_index(objects: DataFrame) -> DataFrame:
    """The index before the scan: some keys missing, some with another ETag."""
    old = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("old-"), F.col("etag")))
    return objects.where("doc_id % 10 <> 2").withColumn("etag", F.coalesce(old, "etag"))


def current_listing(objects: DataFrame) -> DataFrame:
    """The listing of the scan: some known keys missing."""
    return objects.where("doc_id % 10 <> 1").select(
        "bucket", "key", "size", "etag", "is_multipart", "last_modified"
    )


def content(spark: SparkSession, folder: str) -> DataFrame:
    """The content of every object."""
    return documents(spark, folder).select(
        "doc_id", F.lit("main").alias("bucket"), F.expr(_KEY).alias("key"),
        F.encode("text", "UTF-8").alias("content"),
    )
