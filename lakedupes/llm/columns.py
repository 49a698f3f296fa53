"""Columns of the caller, whatever their names, beside those an operator makes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakedupes.llm.batches import slices


def quoted(name: str) -> Column:
    """The column of exactly this name: dots and back quotes in it mean nothing."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_names(taken: Sequence[str], *wanted: str) -> list[str]:
    """Names like ``wanted`` that are not ``taken``, compared as Spark does, without regard to case."""
    used = {t.lower() for t in taken}
    out = []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def with_made(
    docs: DataFrame, column: str, made: Mapping[str, str], make: Callable[[], Callable[[pa.Array], list[pa.Array]]]
) -> DataFrame:
    """``docs`` with the columns ``made`` (name: type), computed from slices of the texts in ``column``.

    ``make()`` is called once per task and gives the function from a slice to its new columns. Columns that have
    the names of ``made`` are replaced, all others pass through under their own names.
    """
    names = {m.lower() for m in made}
    keep = [c for c in docs.columns if c.lower() not in names]
    # Inside, columns go by number: names with dots would be read as fields.
    numbered = [quoted(c).alias(f"c{i}") for i, c in enumerate(keep)]
    if column in keep and docs.schema[column].dataType == T.StringType():
        text, first = f"c{keep.index(column)}", 0
    else:
        text, first = "text", 1
        numbered.insert(0, quoted(column).cast("string").alias(text))
    inner = docs.select(*numbered)
    schema = inner.select(
        *inner.columns[first:], *[F.lit(None).cast(t).alias(f"m{i}") for i, t in enumerate(made.values())]
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for part in slices(batches, text):
            new = function(part.column(text))
            yield pa.RecordBatch.from_arrays([*part.columns[first:], *new], schema.names)

    done = inner.mapInArrow(run, schema)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"m{i}").alias(c) for i, c in enumerate(made)])
