"""Object keys as paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakedupes.fixed import (
    ALBUM_ID_SUFFIX,
    AUDIO_EXTENSIONS,
    IMAGE_EXTENSIONS,
    SPACE,
    VIDEO_EXTENSIONS,
)


def basename(key: Column) -> Column:
    """Text after the last ``/``."""
    return F.substring_index(key, "/", -1)


def extension(key: Column) -> Column:
    """Extension with its dot, or ''. Leading dots of a name do not start an extension."""
    return F.regexp_extract(basename(key), r"(?s)^\.*[^.].*(\.[^.]*)\z", 1)


def without_extension(key: Column) -> Column:
    """The key up to its extension."""
    return F.left(key, F.length(key) - F.length(extension(key)))


def stem(key: Column) -> Column:
    """Basename without its extension."""
    return without_extension(basename(key))


def is_media_file(key: Column) -> Column:
    """Audio or video by extension."""
    return F.lower(extension(key)).isin(*AUDIO_EXTENSIONS, *VIDEO_EXTENSIONS)


def _ends_with_any(key: Column, extensions: tuple[str, ...]) -> Column:
    names = "|".join(e[1:] for e in extensions)
    return F.lower(key).rlike(rf"\.(?:{names})\z")


def is_audio(key: Column) -> Column:
    """The key ends like an audio file. A bare ``.mp3`` counts, a video does not."""
    return _ends_with_any(key, AUDIO_EXTENSIONS)


def is_image(key: Column) -> Column:
    """The key ends like a cover image."""
    return _ends_with_any(key, IMAGE_EXTENSIONS)


def file_class(key: Column) -> Column:
    """``media``, ``image`` or ``other``."""
    return (
        F.when(is_audio(key), "media").when(is_image(key), "image").otherwise("other")
    )


def folder_at(key: Column, depth: int) -> Column:
    """First ``depth`` segments of the key; NULL where segment ``depth`` is empty or absent."""
    if depth < 1:
        raise ValueError("depth must be at least 1")
    present = F.split_part(key, F.lit("/"), F.lit(depth)) != ""
    return F.when(present, F.substring_index(key, "/", depth))


def folder_base_name(folder: Column, depth: int) -> Column:
    """Folder path without the album ID and year that importers append to its last segment."""
    album = F.split_part(folder, F.lit("/"), F.lit(depth))
    parent = F.substring_index(folder, "/", depth - 1) if depth > 1 else F.lit("")
    name = F.regexp_replace(
        F.regexp_extract(album, ALBUM_ID_SUFFIX, 1), rf"(?U)[{SPACE}]+\z", ""
    )
    return F.when(album.rlike(ALBUM_ID_SUFFIX), F.concat(parent, F.lit("/"), name)).otherwise(
        folder
    )


def ancestors(key: Column) -> Column:
    """Every folder above the key, shallowest first; empty array for a key without ``/``."""
    parts = F.split(key, "/")
    return F.when(
        key.contains("/"),
        F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1),
            lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
        ),
    ).otherwise(F.array().cast("array<string>"))


def folder_depth(folder: Column) -> Column:
    """Number of ``/`` in the path."""
    return F.length(folder) - F.length(F.replace(folder, F.lit("/"), F.lit("")))
