"""Jobs that look into objects, for as few of them as possible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakedupes.fixed import HEAD_BYTES
from lakedupes.functions.paths import is_media_file
from lakedupes.operators.exact import multipart_candidates
from lakedupes.operators.groups import join_groups
from lakedupes.operators.index import KEY, upsert
from lakedupes.schema import FAILURES, conform
from lakedupes.sources.content import Extractor, Opener, extract_tags, hash_paths, open_uri, tags_of_content


def hash_candidates(
    objects: DataFrame,
    content: DataFrame | None = None,
    opener: Opener = open_uri,
    bucket: str | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Hashes (bucket, key, sha256, error) of the objects that only their content can tell apart.

    With ``content`` (bucket, key, content) the hash is taken where the content lies and only the
    digest is shuffled. Without it ``objects`` has a ``path`` column, and just the candidates are
    opened, each by one task.
    """
    wanted = multipart_candidates(objects)
    if bucket is not None:
        wanted = wanted.where(F.col("bucket") == bucket)
    if content is None:
        return hash_paths(wanted, opener, tasks)
    digests = content.select(
        *KEY, F.sha2(F.col("content"), 256).alias("sha256"),
    )
    return wanted.select(KEY).join(digests, KEY, "left").select(
        *KEY, "sha256",
        F.when(F.col("sha256").isNull(), "content not found").alias("error"),
    )


def hash_pending(objects: DataFrame, failures: DataFrame | None = None, bucket: str | None = None) -> DataFrame:
    """The objects whose content is still to be hashed.

    These are the unhashed objects of a repeated size that a multipart object has, so that one listed later still meets the
    hashes of earlier scans; less those that are known to fail: a row of ``failures`` (``FAILURES``) stands for
    one state of an object, its bucket, key and ETag. With another ETag it is tried again, and so it is once its
    row is taken out.
    """
    sizes = objects.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.bool_or("is_multipart").alias("_ambiguous")).where("n > 1")
    wanted = join_groups(objects, sizes, ["size"], keep="_ambiguous").where("sha256 IS NULL").drop("n", "_ambiguous")
    if bucket is not None:
        wanted = wanted.where(F.col("bucket") == bucket)
    if failures is None:
        return wanted
    known = failures.select(*KEY, "etag").distinct()
    return wanted.join(known, [*KEY, "etag"], "left_anti").select(wanted.columns)


def remember_failures(
    failures: DataFrame, objects: DataFrame, found: DataFrame, failed_at: Column | None = None
) -> DataFrame:
    """``failures`` after a content pass that gave ``found`` (bucket, key, error) for rows of ``objects``.

    A row with an error is kept under the ETag the object has in ``objects``; one without takes the object's
    earlier failures out. Failures of objects that are gone or have another ETag go too.
    """
    now = F.localtimestamp() if failed_at is None else failed_at
    state = objects.select(*KEY, "etag")
    told = found.select(*KEY, "error").join(state, KEY).withColumn("failed_at", now)
    kept = conform(failures, FAILURES).join(state, [*KEY, "etag"], "left_semi")
    return upsert(kept, told, KEY).where("error IS NOT NULL").select(FAILURES.names)


def media_pending(objects: DataFrame, media: DataFrame, bucket: str | None = None) -> DataFrame:
    """Media objects without a media row."""
    files = objects.where(is_media_file(F.col("key")))
    if bucket is not None:
        files = files.where(F.col("bucket") == bucket)
    return files.join(media.select(KEY), KEY, "left_anti")


def enrich_media(
    pending: DataFrame,
    extractor: Extractor,
    opener: Opener = open_uri,
    tasks: int | None = None,
    head: int = HEAD_BYTES,
    content: DataFrame | None = None,
) -> DataFrame:
    """Media rows, and an ``error`` column, for pending objects (bucket, key, path).

    With ``content`` (bucket, key, content) heads come from that table and need no path: they are cut
    in the scan, so no more than ``head`` bytes of an object are shuffled.
    """
    if content is None:
        return extract_tags(pending, extractor, opener, tasks, head)
    heads = content.select(*KEY, F.substring(F.col("content").cast("binary"), 1, head).alias("content"))
    return tags_of_content(pending.select(KEY).join(heads, KEY, "left"), extractor, head)
