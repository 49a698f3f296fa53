"""Redundancy in large object inventories, found with Spark.

Every operator takes and returns DataFrames over three index tables: ``objects`` (bucket, key, size,
etag, is_multipart, sha256, last_modified, scanned_at), ``media_metadata`` and ``bucket_config``.
"""

import sys

from pyspark import cloudpickle

from lakedupes.operators.bins import content_bins
from lakedupes.operators.content import (
    enrich_media,
    hash_candidates,
    hash_pending,
    media_pending,
    remember_failures,
)
from lakedupes.operators.exact import (
    all_duplicates,
    content_identity,
    duplicate_groups,
    etag_duplicates,
    exclusive_duplicates,
    exclusive_groups,
    hash_duplicates,
    multipart_candidates,
    scan_stats,
    size_duplicates,
)
from lakedupes.operators.folders import (
    diagnosis_summary,
    duplicate_folders,
    folder_groups,
    folder_stats,
)
from lakedupes.operators.index import (
    apply_listing,
    delete_objects,
    scan_result,
    snapshot_diff,
    update_sha256,
    upsert_config,
    upsert_media,
    upsert_objects,
)
from lakedupes.operators.rename import (
    clean_keys,
    emptied_folders,
    keys_after_rename,
    plan_renames,
    rename_stats,
    resolve_conflicts,
    rule_counts,
)
from lakedupes.operators.retention import retention, to_delete
from lakedupes.operators.suspects import suspect_names
from lakedupes.operators.works import same_work_groups
from lakedupes.plans.actions import delete_plan, orphan_plan, orphan_totals, rename_plan
from lakedupes.plans.report import ranked_groups, report, report_rows
from lakedupes.plans.scan import Scan, scan
from lakedupes.schema import BUCKET_CONFIG, FAILURES, MEDIA, OBJECTS, conform
from lakedupes.sinks.reports import write_json_report, write_report
from lakedupes.sources.content import hash_chunks
from lakedupes.sources.listing import normalize_listing, read_files, read_listing

__all__ = [
    "BUCKET_CONFIG", "FAILURES", "MEDIA", "OBJECTS", "Scan", "all_duplicates", "apply_listing", "clean_keys",
    "conform", "content_bins", "content_identity", "delete_objects", "delete_plan", "diagnosis_summary",
    "duplicate_folders", "duplicate_groups", "emptied_folders", "enrich_media",
    "etag_duplicates", "exclusive_duplicates", "exclusive_groups", "folder_groups",
    "folder_stats", "hash_candidates", "hash_chunks", "hash_duplicates", "hash_pending", "keys_after_rename",
    "media_pending", "multipart_candidates", "normalize_listing", "orphan_plan",
    "orphan_totals", "plan_renames", "ranked_groups", "read_files", "read_listing",
    "remember_failures", "rename_plan", "rename_stats", "report", "report_rows", "resolve_conflicts", "retention",
    "rule_counts", "same_work_groups", "scan", "scan_result", "scan_stats", "size_duplicates",
    "snapshot_diff", "suspect_names", "to_delete", "update_sha256", "upsert_config",
    "upsert_media", "upsert_objects", "write_json_report", "write_report",
]

# The few functions that run in Python workers travel by value: executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
