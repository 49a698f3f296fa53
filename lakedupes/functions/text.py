"""Sizes, times, shell words and tags as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakedupes.fixed import SIZE_UNITS


def human_size(size: Column) -> Column:
    """Bytes with one decimal and a unit; halves round to even."""
    size = size.cast("double")
    text = None
    for power, unit in enumerate(SIZE_UNITS):
        scaled = F.concat(
            F.call_function("format_number", size / F.lit(float(1024**power)), F.lit("0.0")),
            F.lit(" " + unit),
        )
        if power == len(SIZE_UNITS) - 1:
            return text.otherwise(scaled)
        fits = F.abs(size) < F.lit(float(1024 ** (power + 1)))
        text = F.when(fits, scaled) if text is None else text.when(fits, scaled)


def whole_units(size: Column, power: int) -> Column:
    """Bytes in whole units of 1024**power, rounded down."""
    return F.shiftright(size, 10 * power)


def iso_time(ts: Column) -> Column:
    """ISO text of a timestamp; the fraction is written only where there is one."""
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)),
    )


def shell_quote(text: Column) -> Column:
    """Single-quoted shell word."""
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def store_uri(bucket: Column, key: Column) -> Column:
    """Quoted ``s3://`` address of an object."""
    return shell_quote(F.concat(F.lit("s3://"), bucket, F.lit("/"), key))


def codec_label(codec: Column, default: str = "?") -> Column:
    """Codec name, or ``default`` where it is missing or empty."""
    return F.coalesce(F.nullif(codec, F.lit("")), F.lit(default))


def work_label(artist: Column, title: Column) -> Column:
    """``artist - title``."""
    return F.concat_ws(" - ", artist, title)


def first_tag(*tags: Column) -> Column:
    """First element of the first tag that has any; each tag is an array of strings."""
    return F.coalesce(*[F.get(tag, F.lit(0)) for tag in tags])


def is_multipart_etag(etag: Column) -> Column:
    """An ETag of the form ``hash-N``: it is not a hash of the content."""
    return etag.rlike(r'-[0-9]+"*\z')


def wasted_bytes(size: Column, copies: Column) -> Column:
    """Bytes taken by all copies but one."""
    return size * (copies - 1)
