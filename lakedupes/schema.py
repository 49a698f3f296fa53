"""The three index tables and the cast onto them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OBJECTS = T.StructType([
    T.StructField("bucket", T.StringType(), False),
    T.StructField("key", T.StringType(), False),
    T.StructField("size", T.LongType(), False),
    T.StructField("etag", T.StringType(), False),
    T.StructField("is_multipart", T.BooleanType(), False),
    T.StructField("sha256", T.StringType()),
    T.StructField("last_modified", T.TimestampNTZType(), False),
    T.StructField("scanned_at", T.TimestampNTZType()),
])

MEDIA = T.StructType([
    T.StructField("bucket", T.StringType(), False),
    T.StructField("key", T.StringType(), False),
    T.StructField("artist", T.StringType()),
    T.StructField("album", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("duration_s", T.DoubleType()),
    T.StructField("codec", T.StringType()),
    T.StructField("bitrate", T.LongType()),
])

BUCKET_CONFIG = T.StructType([
    T.StructField("bucket", T.StringType(), False),
    T.StructField("endpoint_url", T.StringType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])

# Objects whose content could not be read, and must not be opened again as long as their ETag is the same.
FAILURES = T.StructType([
    T.StructField("bucket", T.StringType(), False),
    T.StructField("key", T.StringType(), False),
    T.StructField("etag", T.StringType(), False),
    T.StructField("error", T.StringType()),
    T.StructField("failed_at", T.TimestampNTZType()),
])

# A listing as stores and inventory reports write it.
LISTING = T.StructType([
    T.StructField("Key", T.StringType()),
    T.StructField("Size", T.LongType()),
    T.StructField("ETag", T.StringType()),
    T.StructField("LastModified", T.TimestampNTZType()),
])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast ``df`` onto ``schema``: extra columns go, missing nullable ones become typed NULLs."""
    missing = [f.name for f in schema if f.name not in df.columns and not f.nullable]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select([
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema
    ])
