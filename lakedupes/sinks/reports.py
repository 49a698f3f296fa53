"""Reports on disk: nested JSON documents, and flat rows in any tabular format."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakedupes.functions.text import iso_time
from lakedupes.operators.ranking import ordered_rows

FORMATS = ("csv", "json", "orc", "parquet")


def nest(rows: DataFrame, group: Sequence[str], member: Sequence[Column], name: str) -> DataFrame:
    """One document per member: the columns of its group, and the member as ``name``.

    A group of any size has this form, so nothing is gathered; ``write_report`` with ``order_by`` the group's columns
    and ``name`` puts the members of a group side by side, in the order of the member's fields.
    """
    return rows.select(*group, F.struct(*member).alias(name))


def duplicate_documents(members: DataFrame) -> DataFrame:
    """Group documents of the duplicate section."""
    return nest(
        members, ["fingerprint", "size", "wasted_bytes"],
        [F.col("bucket"), F.col("key"), iso_time(F.col("last_modified")).alias("last_modified")], "object",
    )


def suspect_documents(suspects: DataFrame) -> DataFrame:
    """Group documents of the suspect-name section."""
    return nest(
        suspects, ["normalized"], [F.col("bucket"), F.col("key"), F.col("size"), F.col("etag")], "file",
    )


def work_documents(works: DataFrame) -> DataFrame:
    """Group documents of the same-work section."""
    return nest(
        works, ["artist", "title"],
        [F.col("bucket"), F.col("key"), F.col("codec"), F.col("bitrate"), F.col("size")], "file",
    )


def folder_documents(folders: DataFrame) -> DataFrame:
    """Group documents of the folder diagnosis. ``folders``: rows of ``duplicate_folders``."""
    return nest(
        folders,
        ["bucket", "base_name", "category"],
        [F.col("folder").alias("path"), F.col("file_count"), F.col("media_count"),
         F.col("image_count"), F.col("total_size")],
        "folder",
    )


def document_lines(rows: DataFrame, group: Sequence[str], member: Sequence[Column], name: str, order: Sequence[str]) -> DataFrame:
    """(position, text): a JSON array with one document per group, which holds its members as the array ``name``.

    The texts, one per member, make up the array when they follow each other by ``position``; no rows, no text. A
    document is never in one place before it is on disk, so a group may have any size. ``order``: the columns of ``group`` first, then
    those that order members, ``-`` in front for descending; unique. Null fields are kept as ``null``.
    """
    by = [f"by{i}" for i in range(len(order))]
    keep = {"ignoreNullFields": "false"}
    parts = rows.select(
        *[F.col(o.removeprefix("-")).alias(b) for o, b in zip(order, by, strict=True)],
        F.to_json(F.struct(*group), keep).alias("head"), F.to_json(F.struct(*member), keep).alias("body"),
    )
    signed = ["-" * o.startswith("-") + b for o, b in zip(order, by, strict=True)]
    placed, total = ordered_rows(parts, signed, len(group))
    opened = F.concat(
        F.when(F.col("position") > 1, "]},").otherwise("["),
        F.substring("head", F.lit(1), F.char_length("head") - 1), F.lit(f',"{name}":['),
    )
    closed = F.when(F.col("position") == total, "]}]").otherwise("")
    return placed.select("position", F.concat(F.when(F.col("first"), opened).otherwise(","), "body", closed).alias("text"))


def duplicate_lines(members: DataFrame) -> DataFrame:
    """One document per duplicate group, by waste; members by bucket and key."""
    return document_lines(
        members, ["fingerprint", "size", "wasted_bytes"],
        [F.col("bucket"), F.col("key"), iso_time(F.col("last_modified")).alias("last_modified")], "objects",
        ["-wasted_bytes", "fingerprint", "size", "bucket", "key"],
    )


def suspect_lines(suspects: DataFrame) -> DataFrame:
    """One document per suspect name; members by bucket and key."""
    member = [F.col(c) for c in ("bucket", "key", "size", "etag")]
    return document_lines(suspects, ["normalized"], member, "files", ["normalized", "bucket", "key"])


def work_lines(works: DataFrame) -> DataFrame:
    """One document per artist and title; larger files first."""
    member = [F.col(c) for c in ("bucket", "key", "codec", "bitrate", "size")]
    return document_lines(works, ["artist", "title"], member, "files", ["artist", "title", "-size", "bucket", "key"])


def folder_lines(folders: DataFrame) -> DataFrame:
    """One document per base name of the folder diagnosis; folders with more audio first. ``folders``: rows of ``duplicate_folders``."""
    member = [F.col("folder").alias("path"), *[F.col(c) for c in ("file_count", "media_count", "image_count", "total_size")]]
    return document_lines(
        folders, ["bucket", "base_name", "category"], member, "folders", ["bucket", "base_name", "category", "-media_count", "folder"]
    )


def write_lines(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write the texts of ``document_lines``; the files, one after the other by name, are one JSON array."""
    lines.orderBy("position").select("text").write.mode(mode).text(path)


def write_report(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                 order_by: Sequence[str | Column] = (), **options: str) -> None:
    """Write rows or documents. CSV is quoted, with a header; nested columns need another format.

    ``order_by`` sorts the whole report; its files follow each other by name.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}; known: {', '.join(FORMATS)}")
    if fmt == "csv":
        options = {"header": "true", "escape": '"', **options}
    if order_by:
        df = df.orderBy(*order_by)
    df.write.format(fmt).mode(mode).options(**options).save(path)


def write_json_report(
    path: str, stats: DataFrame, members: DataFrame, suspects: DataFrame | None = None,
    works: DataFrame | None = None, mode: str = "errorifexists",
) -> None:
    """The whole report as JSON: one folder per section, sections without rows left out.

    Each section but ``stats`` is one array with one document per group. Groups come by waste, then name; names and works in
    order; members by bucket and key, files of a work by size.
    """
    write_report(stats, f"{path}/stats", "json", mode)
    write_lines(duplicate_lines(members), f"{path}/groups", mode)
    if suspects is not None and not suspects.isEmpty():
        write_lines(suspect_lines(suspects), f"{path}/suspect_names", mode)
    if works is not None and not works.isEmpty():
        write_lines(work_lines(works), f"{path}/same_work", mode)
