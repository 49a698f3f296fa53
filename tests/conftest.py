from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lakedupes.schema import MEDIA, OBJECTS  # noqa: E402

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    """A local session in which three rows are already a hot group."""
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.lakedupes.pieceRows", "3")
        # Small data: compiling the plans would take longer than running them.
        .config("spark.sql.codegen.wholeStage", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def make(spark):
    return Make(spark)


class Make:
    """Small index tables from short row notes."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def objects(self, *rows) -> DataFrame:
        """Rows (key, size, etag, multipart=False, sha=None, modified=DAY, bucket='b')."""
        full = []
        for row in rows:
            defaults = (None, None, None, False, None, DAY, "b")
            key, size, etag, multipart, sha, modified, bucket = (*row, *defaults[len(row):])
            full.append((bucket, key, size, etag, multipart, sha, modified, DAY))
        return self.spark.createDataFrame(full, OBJECTS)

    def media(self, *rows) -> DataFrame:
        """Rows (key, artist, title, codec=None, bucket='b')."""
        full = []
        for row in rows:
            key, artist, title, codec, bucket = (*row, *(None, "b")[len(row) - 3:])
            full.append((bucket, key, artist, None, title, None, codec, None))
        return self.spark.createDataFrame(full, MEDIA)

    def keys(self, *keys: str) -> DataFrame:
        return self.spark.createDataFrame([("b", k) for k in keys], "bucket string, key string")

    def texts(self, *texts: str) -> DataFrame:
        return self.spark.createDataFrame([(t,) for t in texts], "t string")


class Bag(list):
    """A list that equals any other order of itself."""

    def __eq__(self, other):
        return sorted(map(repr, self)) == sorted(map(repr, other))

    __hash__ = None


def rows(df: DataFrame, *columns: str) -> Bag:
    """Rows as tuples, or values where there is one column, in no order."""
    df = df.select(*columns) if columns else df
    out = [tuple(r) for r in df.collect()]
    return Bag(r[0] for r in out) if len(df.columns) == 1 else Bag(out)
