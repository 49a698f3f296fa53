"""A whole scan: listing in, index out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakedupes.operators.content import enrich_media, hash_pending, media_pending, remember_failures
from lakedupes.operators.exact import scan_stats
from lakedupes.operators.index import (
    KEY,
    classified,
    index_of,
    media_of,
    scan_result,
    update_sha256,
    upsert_config,
    upsert_media,
)
from lakedupes.schema import BUCKET_CONFIG, FAILURES
from lakedupes.sources.content import Extractor, Opener, hash_paths, open_uri, with_path
from lakedupes.staging import stage
from lakedupes.unions import union


@dataclass
class Scan:
    """The tables after a scan, what changed, and what could not be read.

    ``hashed`` and ``enriched`` count the objects whose content was asked for. ``failures`` goes into the next scan;
    ``config`` has the endpoint of the bucket and, as ``previous``, the one it had before if that was another.
    """

    objects: DataFrame
    media: DataFrame
    result: DataFrame
    stats: DataFrame
    errors: DataFrame
    hashed: int
    enriched: int
    failures: DataFrame
    config: DataFrame


def scan(
    objects: DataFrame,
    media: DataFrame,
    listing: DataFrame,
    prefix: str = "",
    bucket: str | None = None,
    extractor: Extractor | None = None,
    opener: Opener = open_uri,
    scheme: str = "s3",
    failures: DataFrame | None = None,
    config: DataFrame | None = None,
    endpoint_url: str | None = None,
) -> Scan:
    """Bring the index up to date with a listing.

    New and changed objects are indexed and missing ones dropped; then the content of ambiguous
    objects is hashed, and with ``extractor`` the tags of new media objects are read. ``listing``
    may have a ``path`` per object; otherwise it is made of ``scheme``, bucket and key. Content is
    read once: what is read is staged before it is used, objects that have a hash are not opened again, nor are those
    that ``failures`` of an earlier scan knows to fail in their present state. With a ``bucket`` its
    ``endpoint_url`` is stored in ``config``.
    """
    spark = objects.sparkSession
    listing, _ = stage(listing)
    rows, _ = stage(classified(objects, listing, prefix, bucket))
    result, _ = stage(scan_result(rows))
    index, _ = stage(index_of(rows))
    tags = media_of(media, rows)
    addressed = with_path(index, scheme)
    if "path" in listing.columns:
        listed = listing.selectExpr(*KEY, "path AS _listed")
        addressed = addressed.join(listed, KEY, "left").selectExpr(
            *index.columns, "coalesce(_listed, path) AS path"
        )
    if failures is None:
        failures = spark.createDataFrame([], FAILURES)
    hashes, hashed = stage(hash_paths(hash_pending(addressed, failures, bucket), opener))
    failures, _ = stage(remember_failures(failures, index, hashes))
    index, _ = stage(update_sha256(index, hashes))
    errors = hashes.where("error is not null").select(*KEY, "error")
    enriched = 0
    if extractor is not None:
        found, enriched = stage(
            enrich_media(media_pending(addressed, tags, bucket), extractor, opener)
        )
        tags, _ = stage(upsert_media(tags, found))
        errors = union(errors, found.where("error is not null").select(*KEY, "error"))
    config = spark.createDataFrame([], BUCKET_CONFIG) if config is None else config
    given = spark.range(1 if bucket is not None else 0).select(
        F.lit(bucket).cast("string").alias("bucket"), F.lit(endpoint_url).cast("string").alias("endpoint_url")
    )
    config, _ = stage(upsert_config(config, given))
    return Scan(index, tags, result, scan_stats(index), errors, hashed, enriched, failures, config)
