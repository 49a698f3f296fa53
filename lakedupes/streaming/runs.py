"""The end of a listing: what a complete run did not list is gone.

A page cannot prove that a key is missing, a whole run can. Pages carry the run they belong to, their number and
whether they are the last one; they may come late, repeated and in any order. Keyed state holds the page numbers seen
of each run as intervals, which are few where pages come nearly in order, and tells once when none is missing. The
keys that a complete run lacks then become deletions for the change log.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lakedupes.operators.groups import join_counted
from lakedupes.operators.index import KEY
from lakedupes.schema import LISTING
from lakedupes.sinks.tables import write_snapshot
from lakedupes.sources.listing import under_prefix

# A listing page: every row tells the page. A page without objects has one row without a key.
PAGES = T.StructType([
    T.StructField("bucket", T.StringType()), *LISTING,
    T.StructField("run", T.StringType()),
    T.StructField("started", T.TimestampNTZType()),
    T.StructField("page", T.LongType()),
    T.StructField("last", T.BooleanType()),
])
_RUN = ["bucket", "run"]
_MARK = ["bucket", "run", "started", "page", "last"]


def _marks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per page and batch, so that a run's state is not asked once per object."""
    for batch in batches:
        yield from pa.Table.from_batches([batch]).group_by(_MARK).aggregate([]).select(_MARK).to_batches()


def with_pages(starts: list[int], ends: list[int], pages: Iterable[int]) -> tuple[list[int], list[int]]:
    """Sorted intervals (both ends included) after ``pages`` were added to them."""
    spans = sorted([*zip(starts, ends, strict=True), *((p, p) for p in pages)])
    merged: list[list[int]] = []
    for start, end in spans:
        if merged and start <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [s for s, _ in merged], [e for _, e in merged]


def _seen(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    starts, ends, last, started, done = state.get if state.exists else ([], [], -1, None, False)
    starts, ends = list(starts), list(ends)
    for part in parts:
        starts, ends = with_pages(starts, ends, {int(p) for p in part["page"]})
        last = max(last, *(int(p) for p in part.loc[part["last"].fillna(False).astype(bool), "page"]), -1)
        first = part["started"].min()
        started = first if started is None else min(started, first)
    complete = last >= 0 and len(starts) > 0 and starts[0] <= 0 and ends[0] >= last
    state.update(([], [], last, started, True) if complete or done else (starts, ends, last, started, False))
    if complete and not done:
        yield pd.DataFrame({"bucket": [key[0]], "run": [key[1]], "started": [started], "pages": [last + 1]})


def complete_runs(pages: DataFrame) -> DataFrame:
    """(bucket, run, started, pages) of each run, once, when all of its pages have come.

    ``pages`` is a stream with the columns of ``PAGES``; pages are numbered from 0. Rows without bucket, run, started or page
    belong to no run. A run stays in the state as one small row, so that pages repeated later do not end it again.
    """
    whole = pages.select(*_MARK).dropna(subset=["bucket", "run", "started", "page"])
    kind = T.StructType([PAGES[name] for name in _MARK])
    return whole.mapInArrow(_marks, kind).groupBy(*_RUN).applyInPandasWithState(
        _seen, "bucket string, run string, started timestamp_ntz, pages long",
        "starts array<bigint>, ends array<bigint>, last bigint, started timestamp_ntz, done boolean",
        "append", GroupStateTimeout.NoTimeout,
    )


def missing_keys(index: DataFrame, pages: DataFrame, runs: DataFrame, prefix: str = "") -> DataFrame:
    """Deletions: keys below ``prefix`` in the bucket of a complete run that none of its pages lists.

    An object modified after the run started may have come behind it, and stays. The rows are changes as
    ``fold_changes`` takes them, dated at the start of the run; of several runs the last one counts.
    """
    held = under_prefix(index, prefix).select(*KEY, "last_modified")
    asked = join_counted(held, runs.groupBy("bucket").agg(F.max_by("run", F.struct("started", "run")).alias("run"),
                                                          F.max("started").alias("started")), ["bucket"], spread=["key"])
    listed = pages.select(*_RUN, F.col("Key").alias("key"))
    return (
        asked.where(F.col("last_modified") <= F.col("started")).join(listed, [*_RUN, "key"], "left_anti")
        .select(*KEY, F.lit(None).cast("long").alias("size"), F.lit(None).cast("string").alias("etag"),
                F.lit(False).alias("is_multipart"), F.col("started").alias("last_modified"), F.lit(True).alias("deleted"))
    )


def log_missing(
    spark: SparkSession, path: str, read_index: Callable[[], DataFrame], out: str, checkpoint: str,
    prefix: str = "", fmt: str = "parquet", **options: str,
) -> StreamingQuery:
    """Follow the page files in ``path``; the deletions of the runs that micro-batch b completes are version b in ``out``.

    The files hold whole runs below ``prefix``. A batch that is run again writes its version again. Stops when
    all present files are read.
    """
    pages = spark.readStream.format(fmt).schema(PAGES).options(**options).load(path)

    def write(runs: DataFrame, number: int) -> None:
        session = runs.sparkSession
        runs = session.createDataFrame(runs.collect(), runs.schema)  # one row per listing of a whole bucket
        listed = session.read.format(fmt).schema(PAGES).load(path)
        write_snapshot(missing_keys(read_index(), listed, runs, prefix), out, number)

    return (
        complete_runs(pages).writeStream.outputMode("append").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
