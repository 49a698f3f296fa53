"""One query per operator. Each reads the whole tables of ``folder``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import lakedupes as ld
from lakedupes.functions import names, paths, rules, text
from lakedupes.operators import counts, folders, index, rename
from lakedupes.operators.ranking import ordered_rows
from lakedupes.plans import actions, report
from lakedupes.sinks import changelog, reports
from lakedupes.sources import listing
from lakedupes.unions import union
from workload import tables

RULES = ("strip-spaces", "strip-backslashes")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _scanned() -> Column:
    return F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")


def _resolved(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    keys = tables.rename_keys(spark, folder)
    return ld.plan_renames(keys, RULES), keys


# Names and paths

@query
def multipart_flag(spark, folder):
    return tables.objects(spark, folder).select(
        "key", "etag", text.is_multipart_etag(F.col("etag")).alias("multipart")
    )


@query
def split_ext(spark, folder):
    key = F.col("key")
    return tables.objects(spark, folder).select(
        "key", paths.basename(key).alias("base"), paths.without_extension(key).alias("root"),
        paths.extension(key).alias("ext"),
    )


@query
def normalize_name(spark, folder):
    return tables.objects(spark, folder).select(
        "key", names.normalize_name(F.col("key")).alias("normalized")
    )


@query
def name_quality_score(spark, folder):
    return tables.objects(spark, folder).select(
        "key", names.name_quality_score(F.col("key")).alias("score")
    )


@query
def media_files(spark, folder):
    rows = tables.objects(spark, folder).where(paths.is_media_file(F.col("key")))
    return rows.select("key", paths.file_class(F.col("key")).alias("class"))


@query
def human_size(spark, folder):
    return tables.objects(spark, folder).select(
        "key", "size", text.human_size(F.col("size") * F.lit(97)).alias("size_text"),
        text.whole_units(F.col("size"), 1).alias("kib"),
    )


@query
def iso_times(spark, folder):
    return spark.read.parquet(f"{folder}/events.parquet").select(
        "event_id", text.iso_time(F.col("ts").cast("timestamp_ntz")).alias("iso")
    )


@query
def shell_words(spark, folder):
    return tables.documents(spark, folder).select("doc_id", text.shell_quote(F.col("text")).alias("word"))


@query
def key_ancestors(spark, folder):
    rows = tables.objects(spark, folder).select(
        "key", F.explode(paths.ancestors(F.col("key"))).alias("dir")
    )
    return rows.select("key", "dir", paths.folder_depth(F.col("dir")).alias("depth"))


@query
def folders_at_depth(spark, folder):
    rows = listing.under_prefix(tables.objects(spark, folder), "Music/")
    at = rows.select(paths.folder_at(F.col("key"), 3).alias("folder"))
    return at.where("folder is not null").distinct()


@query
def folder_base_name(spark, folder):
    return folders_at_depth(spark, folder).select(
        "folder", paths.folder_base_name(F.col("folder"), 3).alias("base_name")
    )


@query
def rule_strip_spaces(spark, folder):
    return tables.rename_keys(spark, folder).select(
        "key", rules.strip_spaces(F.col("key")).alias("cleaned")
    )


@query
def rule_strip_backslashes(spark, folder):
    return tables.rename_keys(spark, folder).select(
        "key", rules.strip_backslashes(F.col("key")).alias("cleaned")
    )


@query
def first_tags(spark, folder):
    tags = tables.documents(spark, folder).select(
        "doc_id",
        F.when(F.col("doc_id") % 3 == 0, F.array("lang")).alias("artist"),
        F.when(F.col("doc_id") % 2 == 0, F.array("source", "lang")).alias("albumartist"),
    )
    return tags.select("doc_id", text.first_tag(F.col("artist"), F.col("albumartist")).alias("tag"))


# Index

@query
def object_index(spark, folder):
    return tables.build_objects(spark, folder).drop("doc_id")


@query
def keys_with_prefix(spark, folder):
    return listing.keys_with_etags(tables.objects(spark, folder), "Music/en/")


@query
def all_keys(spark, folder):
    return listing.all_keys(tables.objects(spark, folder), "Music/fr/src1")


@query
def listing_rows(spark, folder):
    raw = tables.objects(spark, folder).select(
        F.col("key").alias("Key"),
        F.when(F.col("doc_id") % 7 == 0, 0).otherwise(F.col("size")).alias("Size"),
        F.col("etag").alias("ETag"), F.col("last_modified").alias("LastModified"),
    )
    return listing.normalize_listing(raw, "main", "Music/")


@query
def snapshot_diff(spark, folder):
    objects = tables.objects(spark, folder)
    return ld.snapshot_diff(
        tables.previous_index(objects), tables.current_listing(objects), "Music/"
    )


@query
def scan_result(spark, folder):
    return index.scan_result(snapshot_diff(spark, folder))


def _scan(spark, folder):
    objects = tables.objects(spark, folder, hashed=True)
    return ld.apply_listing(
        tables.previous_index(objects).withColumn("scanned_at", F.col("last_modified")),
        tables.media(objects), tables.current_listing(objects), "Music/en/", scanned_at=_scanned(),
    )


@query
def apply_listing_objects(spark, folder):
    return _scan(spark, folder)[0]


@query
def apply_listing_media(spark, folder):
    return _scan(spark, folder)[1].drop("doc_id")


@query
def stats_after_scan(spark, folder):
    """The totals after a scan, from the counts before it and what the scan changed."""
    objects = tables.objects(spark, folder, hashed=True)
    old = tables.previous_index(objects).withColumn("scanned_at", F.col("last_modified"))
    changes = index.classified(old, tables.current_listing(objects), "Music/en/")
    return counts.stats_of_counts(counts.counts_after_scan(counts.group_counts(old), changes))


def _change_log(objects):
    """Three batches: new and changed keys, then deletions, then keys that come back or are listed again."""
    first = objects.where("doc_id % 10 = 2 OR doc_id % 9 = 0").selectExpr("*", "1L AS seq", "false AS deleted")
    gone = objects.where("doc_id % 6 = 1").selectExpr("*", "2L AS seq", "true AS deleted")
    again = objects.where("doc_id % 7 = 3").selectExpr("* EXCEPT (size)", "size + 1 AS size", "3L AS seq", "false AS deleted")
    return union(first, gone, again.select(first.columns))


@query
def index_after_changes(spark, folder):
    """The index merged with a change log on reading."""
    objects = tables.objects(spark, folder, hashed=True)
    old = tables.previous_index(objects).withColumn("scanned_at", F.col("last_modified"))
    return changelog.merge_log(old, tables.media(objects), _change_log(objects), _scanned())[0]


@query
def media_after_changes(spark, folder):
    objects = tables.objects(spark, folder, hashed=True)
    return changelog.merge_log(tables.previous_index(objects), tables.media(objects), _change_log(objects), _scanned())[1]


@query
def upsert_objects(spark, folder):
    objects = tables.objects(spark, folder, hashed=True)
    again = objects.where("doc_id % 10 in (1, 2)").drop("sha256")
    rows = union(
        again.withColumn("turn", F.lit(1)),
        again.where("doc_id % 10 = 2").withColumns({"turn": F.lit(2), "size": F.col("size") + 1}),
    )
    old = objects.where("doc_id % 10 <> 1").withColumn("scanned_at", F.col("last_modified"))
    return ld.upsert_objects(old, rows, ["turn"], _scanned())


@query
def upsert_media(spark, folder):
    media = tables.media(tables.objects(spark, folder))
    rows = media.where("doc_id % 3 = 1").withColumn("codec", F.lit("opus"))
    return ld.upsert_media(media.where("doc_id % 5 <> 1"), rows)


@query
def config_upsert_previous(spark, folder):
    sources = tables.documents(spark, folder).groupBy(F.col("source").alias("bucket")).agg(
        F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")
    )
    url = F.concat(F.lit("https://"), "bucket")
    old = sources.where("last % 3 <> 0").select(
        "bucket", F.when(F.col("last") % 5 != 0, url).alias("endpoint_url"),
        _scanned().alias("updated_at"),
    )
    new = sources.where("n % 4 <> 0").select(
        "bucket", F.when(F.col("n") % 2 == 0, url)
        .when(F.col("n") % 3 == 0, F.concat(url, F.lit(":9000"))).alias("endpoint_url"),
    )
    return ld.upsert_config(old, new, _scanned())


@query
def endpoint_lookup(spark, folder):
    config = config_upsert_previous(spark, folder)
    rows = tables.documents(spark, folder).select("doc_id", F.col("source").alias("bucket"))
    return listing.with_endpoint(rows, config)


def _deleted(spark, folder):
    objects = tables.objects(spark, folder)
    gone = objects.where("doc_id % 6 = 1").select("bucket", "key")
    return ld.delete_objects(objects, tables.media(objects), gone)


@query
def delete_cascade(spark, folder):
    kept, media = _deleted(spark, folder)
    return union(
        kept.select(F.lit("objects").alias("tab"), "bucket", "key"),
        media.select(F.lit("media").alias("tab"), "bucket", "key"),
    )


@query
def update_sha256(spark, folder):
    """Partial hashes are the case shown here: hashes come for documents with even doc_id, and the others keep what they have."""
    objects = tables.objects(spark, folder)
    hashes = tables.content(spark, folder).where("doc_id % 2 = 0").select(
        "bucket", "key", F.sha2("content", 256).alias("sha256")
    )
    return ld.update_sha256(objects, hashes).select("bucket", "key", "sha256")


# Content

@query
def content_sha256(spark, folder):
    return tables.documents(spark, folder).select("doc_id", F.sha2("text", 256).alias("sha256"))


@query
def hash_candidates(spark, folder):
    objects = tables.objects(spark, folder)
    content = tables.content(spark, folder)
    return ld.hash_candidates(objects, content)


@query
def content_bins(spark, folder):
    """The candidates of the content pass in bins of a megabyte."""
    wanted = ld.multipart_candidates(tables.objects(spark, folder))
    return ld.content_bins(wanted, 1_000_000, 100).select("bucket", "key", "size", "bin")


def _failures(objects):
    """Earlier failures: some of the objects as they are, some of a state that has passed."""
    etag = F.when(F.col("doc_id") % 5 == 0, F.col("etag")).otherwise(F.concat(F.lit("old-"), "etag"))
    return objects.where("doc_id % 5 < 2").select(
        "bucket", "key", etag.alias("etag"), F.lit("timeout").alias("error"), F.col("last_modified").alias("failed_at")
    )


@query
def hash_pending(spark, folder):
    objects = tables.objects(spark, folder)
    content_known = F.when(F.col("doc_id") % 3 == 0, F.md5("key"))
    return ld.hash_pending(objects.withColumn("sha256", content_known), _failures(objects)).select("bucket", "key", "etag")


@query
def remember_failures(spark, folder):
    objects = tables.objects(spark, folder)
    found = objects.where("doc_id % 4 = 1").select(
        "bucket", "key", F.when(F.col("doc_id") % 3 == 0, "denied").alias("error")
    )
    return ld.remember_failures(_failures(objects), objects, found, _scanned())


@query
def chunked_sha256(spark, folder):
    """Hashes of the whole content of every object from its chunks of 4,096 bytes."""
    last = F.greatest(F.octet_length("content") - 1, F.lit(0))
    chunks = tables.content(spark, folder).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.floor(last / 4096).cast("int")))
    ).select("bucket", "key", "chunk", F.substring("content", F.col("chunk") * 4096 + 1, F.lit(4096)).alias("content"))
    return ld.hash_chunks(chunks)


def _head_tags(data: bytes, ext: str) -> dict:
    """Stands for a tag parser: everything comes from the head alone."""
    import hashlib

    return {"artist": hashlib.md5(data).hexdigest(), "title": ext, "bitrate": len(data), "duration_s": len(data) / 2}


@query
def enrich_media(spark, folder):
    """Tags of the media objects that have none, from the first 64 bytes of their content."""
    objects = tables.objects(spark, folder)
    pending = ld.media_pending(objects, tables.media(objects).where("doc_id % 2 = 0"))
    return ld.enrich_media(pending, _head_tags, content=tables.content(spark, folder), head=64)


@query
def media_pending(spark, folder):
    objects = tables.objects(spark, folder)
    media = tables.media(objects).where("doc_id % 2 = 0")
    return ld.media_pending(objects, media).select("bucket", "key")


# Duplicates

@query
def size_duplicates(spark, folder):
    return ld.size_duplicates(tables.objects(spark, folder)).select(
        "bucket", "key", "size", "etag", "is_multipart", "last_modified", "n"
    )


@query
def etag_duplicates(spark, folder):
    return ld.etag_duplicates(tables.objects(spark, folder))


@query
def multipart_candidates(spark, folder):
    return ld.multipart_candidates(tables.objects(spark, folder)).select(
        "bucket", "key", "size", "etag", "is_multipart"
    )


@query
def hash_duplicates(spark, folder):
    return ld.hash_duplicates(tables.objects(spark, folder, hashed=True))


@query
def duplicate_groups(spark, folder):
    return ld.duplicate_groups(tables.objects(spark, folder, hashed=True))


@query
def all_duplicates(spark, folder):
    return ld.all_duplicates(tables.objects(spark, folder, hashed=True))


@query
def exclusive_duplicates(spark, folder):
    return ld.exclusive_duplicates(_partly_hashed(spark, folder))


def _partly_hashed(spark, folder):
    lost = F.when(F.col("doc_id") % 9 != 0, F.col("sha256"))
    return tables.objects(spark, folder, hashed=True).withColumn("sha256", lost)


@query
def exclusive_groups(spark, folder):
    return ld.exclusive_groups(_partly_hashed(spark, folder))


@query
def content_identity(spark, folder):
    return ld.content_identity(_partly_hashed(spark, folder)).select("bucket", "key", "fingerprint")


@query
def scan_stats(spark, folder):
    return ld.scan_stats(tables.objects(spark, folder, hashed=True))


@query
def scan_stats_text(spark, folder):
    return report.summary_text(scan_stats(spark, folder))


@query
def same_work_groups(spark, folder):
    objects = tables.objects(spark, folder)
    return ld.same_work_groups(objects, tables.media(objects))


@query
def same_work_rows(spark, folder):
    return report.same_work_rows(same_work_groups(spark, folder))


@query
def suspect_names(spark, folder):
    return ld.suspect_names(tables.objects(spark, folder))


@query
def suspect_names_by_content(spark, folder):
    identified = ld.content_identity(tables.objects(spark, folder, hashed=True))
    return ld.suspect_names(identified, "fingerprint")


# Choices and plans

@query
def retention_keepers(spark, folder):
    members = ld.all_duplicates(tables.objects(spark, folder, hashed=True))
    return ld.retention(members).where("is_keeper").select(
        "kind", "fingerprint", "size", "n", "keeper"
    )


@query
def retention_newest(spark, folder):
    members = ld.all_duplicates(tables.objects(spark, folder, hashed=True))
    return ld.retention(members, "newest,shortest").select(
        "kind", "fingerprint", "key", "keeper", "is_keeper"
    )


@query
def delete_plan(spark, folder):
    return ld.delete_plan(_partly_hashed(spark, folder), endpoint_url="https://store.example")


@query
def ranked_groups(spark, folder):
    return ld.ranked_groups(ld.duplicate_groups(tables.objects(spark, folder, hashed=True)))


@query
def top_groups(spark, folder):
    return ld.ranked_groups(ld.duplicate_groups(tables.objects(spark, folder, hashed=True)), k=10)


@query
def report_rows(spark, folder):
    objects = tables.objects(spark, folder, hashed=True)
    return ld.report(objects, tables.media(objects))


@query
def report_documents(spark, folder):
    members = ld.all_duplicates(tables.objects(spark, folder, hashed=True))
    return reports.duplicate_documents(members).select("fingerprint", "size", "wasted_bytes", "object.*")


@query
def group_documents(spark, folder):
    return reports.duplicate_lines(ld.all_duplicates(tables.objects(spark, folder, hashed=True)))


@query
def folder_group_documents(spark, folder):
    return reports.folder_lines(duplicate_folders(spark, folder))


def _ordered(df: DataFrame, order: list[str]) -> DataFrame:
    return ordered_rows(df, order)[0].drop("first")


@query
def ordered_duplicates(spark, folder):
    members = ld.all_duplicates(tables.objects(spark, folder, hashed=True)).select("wasted_bytes", "fingerprint", "size", "key")
    return _ordered(members, ["-wasted_bytes", "fingerprint", "size", "key"])


@query
def ordered_suspects(spark, folder):
    return _ordered(suspect_names(spark, folder).select("normalized", "key"), ["normalized", "key"])


@query
def ordered_works(spark, folder):
    works = same_work_groups(spark, folder).select("artist", "title", "size", "key")
    return _ordered(works, ["artist", "title", "-size", "key"])


@query
def ordered_folders(spark, folder):
    found = folders.with_category(duplicate_folders(spark, folder), "both_music")
    return _ordered(found.select("base_name", "media_count", "folder"), ["base_name", "-media_count", "folder"])


# Folders

@query
def folder_stats(spark, folder):
    return ld.folder_stats(tables.objects(spark, folder))


@query
def folder_category(spark, folder):
    return folders.folder_groups(folder_stats(spark, folder))


@query
def duplicate_folders(spark, folder):
    return ld.duplicate_folders(folder_stats(spark, folder))


@query
def folder_documents(spark, folder):
    found = reports.folder_documents(duplicate_folders(spark, folder))
    return found.select("bucket", "base_name", "category", "folder.*")


@query
def orphan_folders(spark, folder):
    return folders.with_category(duplicate_folders(spark, folder), "orphan").select(
        "base_name", "folder", "role"
    )


@query
def diagnosis_summary(spark, folder):
    return ld.diagnosis_summary(folder_stats(spark, folder))


@query
def folder_report_rows(spark, folder):
    return report.folder_report_rows(duplicate_folders(spark, folder))


@query
def orphan_plan(spark, folder):
    return ld.orphan_plan(folder_stats(spark, folder))


@query
def orphan_totals(spark, folder):
    return ld.orphan_totals(orphan_plan(spark, folder))


# Renames

@query
def clean_keys(spark, folder):
    cleaned = ld.clean_keys(tables.rename_keys(spark, folder), RULES)
    return cleaned.select("key", "wanted", F.array_join("rules_fired", ",").alias("fired"))


@query
def rename_stats(spark, folder):
    return ld.rename_stats(ld.clean_keys(tables.rename_keys(spark, folder), RULES))


@query
def rename_rule_counts(spark, folder):
    return ld.rule_counts(ld.clean_keys(tables.rename_keys(spark, folder), RULES))


@query
def resolve_conflicts(spark, folder):
    return _resolved(spark, folder)[0]


@query
def keys_after_rename(spark, folder):
    return rename.keys_after_rename(*_resolved(spark, folder))


@query
def emptied_folders(spark, folder):
    return rename.emptied_folders(*_resolved(spark, folder))


@query
def emptied_by_counts(spark, folder):
    """The emptied folders from kept folder counts and the moves alone."""
    resolved, keys = _resolved(spark, folder)
    return counts.emptied_by_counts(counts.folder_counts(keys), resolved)


@query
def rename_plan(spark, folder):
    resolved, keys = _resolved(spark, folder)
    return actions.rename_plan(keys, resolved=resolved)
