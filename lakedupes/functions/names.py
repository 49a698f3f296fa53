"""File names: normal form and quality score."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakedupes.fixed import (
    COPY_SUFFIXES,
    MOJIBAKE,
    PENALTY_COPY_SUFFIX,
    PENALTY_MOJIBAKE,
    PENALTY_OUTER_SPACE,
    PENALTY_SPACE_RUN,
    SPACE,
)
from lakedupes.functions.paths import basename, extension, stem

def trim_unicode(text: Column) -> Column:
    """Drop Unicode white space at both ends."""
    return F.regexp_replace(text, rf"(?U)^[{SPACE}]+|[{SPACE}]+\z", "")


def collapse_spaces(text: Column) -> Column:
    """Every run of white space becomes one space."""
    return F.regexp_replace(text, rf"(?U)[{SPACE}]+", " ")


def strip_copy_suffixes(text: Column) -> Column:
    """Remove each copy marker once, in their fixed order."""
    for pattern in COPY_SUFFIXES:
        text = F.regexp_replace(text, pattern, "")
    return text


def has_copy_suffix(text: Column) -> Column:
    """Any copy marker ends the text."""
    found = F.lit(False)
    for pattern in COPY_SUFFIXES:
        found = found | text.rlike(pattern)
    return found


def has_mojibake(text: Column) -> Column:
    """The text holds UTF-8 read as Latin-1."""
    return text.rlike(MOJIBAKE)


def name_quality_score(key: Column) -> Column:
    """0 for a clean name; higher is worse."""
    name = stem(key)

    def penalty(test: Column, points: int) -> Column:
        return F.when(test, points).otherwise(0)

    return (
        penalty(has_mojibake(name), PENALTY_MOJIBAKE)
        + penalty(has_copy_suffix(name), PENALTY_COPY_SUFFIX)
        + penalty(name != trim_unicode(name), PENALTY_OUTER_SPACE)
        + penalty(name.contains("  "), PENALTY_SPACE_RUN)
    )


def plain_form(text: str) -> str:
    """Compatibility decomposition without combining marks, the definition of accent stripping."""
    return "".join(
        c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) != "Mn"
    )


# Hangul syllables are laid out by their letters, so they are taken apart by arithmetic.
_HANGUL = range(0xAC00, 0xD7A4)
_LEAD = "".join(map(chr, range(0x1100, 0x1113)))
_VOWEL = "".join(map(chr, range(0x1161, 0x1176)))
_TAIL = "".join(map(chr, range(0x11A8, 0x11C3)))

# Separators of the map literal: control characters, which no plain form holds.
_PAIR, _VALUE = "\x01", "\x02"


def _ranges(points: Iterable[int]) -> str:
    """Regex class body for sorted code points."""
    runs: list[list[int]] = []
    for p in points:
        if runs and p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs)


@cache
def _accent_tables() -> tuple[str, str, str, str]:
    """(from, to) for ``translate``, the class of expanding characters, and their map as text.

    Built from the Unicode database. Decomposition works on one character at a time, so the tables
    give the same as ``plain_form``, but for the order of two spacing marks that follow each other.
    """
    single, dropped, expanding, pairs = [], [], [], []
    # Planes 4 to 13 are unassigned, 15 and 16 private: nothing there has another form.
    for point in [*range(0x80, 0x40000), *range(0xE0000, 0xF0000)]:
        char = chr(point)
        if point in _HANGUL:
            expanding.append(point)
            continue
        plain = plain_form(char)
        if plain == char:
            continue
        if not plain:
            dropped.append(char)
        elif len(plain) == 1:
            single.append((char, plain))
        else:
            expanding.append(point)
            pairs.append(char + _VALUE + plain)
    return (
        "".join(c for c, _ in single) + "".join(dropped),
        "".join(p for _, p in single),
        f"[{_ranges(expanding)}]",
        _PAIR.join(pairs),
    )


def _expand(char: Column, table: Column) -> Column:
    """Plain form of one character that becomes several."""
    index = F.ascii(char) - _HANGUL.start
    vowels, tails = len(_VOWEL), len(_TAIL) + 1

    def letter(alphabet: str, at: Column) -> Column:
        return F.substring(F.lit(alphabet), at + 1, F.lit(1))

    tail = index % tails
    syllable = F.concat(
        letter(_LEAD, F.floor(index / F.lit(vowels * tails)).cast("int")),
        letter(_VOWEL, F.floor(index % F.lit(vowels * tails) / F.lit(tails)).cast("int")),
        F.when(tail > 0, letter(_TAIL, tail - 1)).otherwise(""),
    )
    hangul = char.between(chr(_HANGUL[0]), chr(_HANGUL[-1]))
    return F.when(hangul, syllable).otherwise(F.try_element_at(table, char))


def strip_accents(text: Column) -> Column:
    """Plain letters of ``text``. Stays in the JVM.

    ASCII text is left alone, most other text needs one ``translate``, and only text with a
    ligature, a fraction, Hangul or the like is taken apart character by character.
    """
    source, target, expanding, pairs = _accent_tables()
    table = F.str_to_map(F.lit(pairs), F.lit(_PAIR), F.lit(_VALUE))
    single = F.translate(text, source, target)
    several = F.array_join(
        F.transform(
            F.split(single, ""),
            lambda c: F.when(c.rlike(expanding), _expand(c, table)).otherwise(c),
        ),
        "",
    )
    return (
        F.when(~text.rlike(r"[^\x00-\x7f]"), text)
        .when(~text.rlike(expanding), single)
        .otherwise(several)
    )


def normalize_name(key: Column) -> Column:
    """Normal form of the key's file name, equal for names that differ only in ornament."""
    plain = strip_copy_suffixes(strip_accents(F.lower(stem(key))))
    return F.concat(collapse_spaces(trim_unicode(plain)), F.lower(extension(key)))


def with_normalized_name(df: DataFrame, key: str = "key", name: str = "normalized") -> DataFrame:
    """``df`` with the normal form of each key's file name.

    The same as ``normalize_name``, in steps: each step is used more than once by the next, and as
    columns of their own the steps are evaluated once per row.
    """
    return (
        df.withColumn("_base", basename(F.col(key)))
        .withColumn("_ext", extension(F.col("_base")))
        .withColumn("_stem", F.expr("lower(left(_base, length(_base) - length(_ext)))"))
        .withColumn("_plain", strip_accents(F.col("_stem")))
        .withColumn("_bare", trim_unicode(strip_copy_suffixes(F.col("_plain"))))
        .withColumn(name, F.concat(collapse_spaces(F.col("_bare")), F.lower("_ext")))
        .select(*df.columns, name)
    )
