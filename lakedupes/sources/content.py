"""Object content, read inside tasks, only for the rows that need it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping
from typing import Any, BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakedupes.fixed import CHUNK_BYTES, HEAD_BYTES
from lakedupes.functions.paths import extension
from lakedupes.operators.bins import content_bins, spread_by_bin
from lakedupes.operators.groups import shuffle_partitions

Opener = Callable[[str], BinaryIO]
Extractor = Callable[[bytes, str], Mapping[str, Any] | None]

_TAGS = ["artist", "album", "title", "duration_s", "codec", "bitrate"]
_TAG_TYPES = "artist string, album string, title string, duration_s double, codec string, bitrate long"

# Bytes that one task reads, and what opening an object counts besides its bytes.
BIN_BYTES = 4 << 30
OPEN_BYTES = 4 << 20


def open_uri(path: str) -> BinaryIO:
    """Open a local path, or an address of a store that Arrow knows (s3, gs, hdfs).

    The path is taken as it is, not as an encoded URI: keys may hold spaces, ``%`` and ``#``.
    """
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return open(path, "rb")
    if scheme == "file":
        return open("/" + rest.lstrip("/"), "rb")
    authority, _, name = rest.removeprefix("//").partition("/")
    store, base = fs.FileSystem.from_uri(f"{scheme}://{authority}")
    return store.open_input_file(f"{base.rstrip('/')}/{name}")


def with_path(objects: DataFrame, scheme: str = "s3") -> DataFrame:
    """Add the ``path`` of each object in its store."""
    return objects.withColumn("path", F.concat(F.lit(f"{scheme}://"), "bucket", F.lit("/"), "key"))


def sha256_stream(stream: BinaryIO, chunk: int = CHUNK_BYTES) -> str:
    """SHA-256 of a stream in constant memory."""
    digest = hashlib.sha256()
    while block := stream.read(chunk):
        digest.update(block)
    return digest.hexdigest()


def _spread(paths: DataFrame, tasks: int | None, head: int | None = None) -> DataFrame:
    """Deal out objects so that no task reads much more than the others.

    With a ``size`` column, and no number of ``tasks`` given, tasks are bins of about equal bytes (``content_bins``), at most
    ``BIN_BYTES`` and one object each, and small enough to keep all cores busy; with ``head`` an object counts no more than
    that. Otherwise objects are spread by a hash of the key. Tasks are not merged again.
    """
    partitions = 4 * shuffle_partitions(paths.sparkSession)
    if "size" not in paths.columns or tasks is not None:
        return paths.repartition(tasks or partitions, "bucket", "key")
    cost = F.col("size") if head is None else F.least("size", F.lit(head))
    weighed = paths.withColumn("_cost", F.coalesce(cost, F.lit(0)))
    total = weighed.agg(F.sum(F.col("_cost") + OPEN_BYTES)).first()[0] or 0
    target = max(1, min(BIN_BYTES, -(-total // partitions)))
    return spread_by_bin(content_bins(weighed, target, OPEN_BYTES, "_cost")).drop("_cost")


def hash_paths(paths: DataFrame, opener: Opener = open_uri, tasks: int | None = None) -> DataFrame:
    """(bucket, key, sha256, error) of the objects at ``paths`` (bucket, key, path).

    Each object is streamed by the task that holds its row, so its size does not matter; with a ``size`` column
    tasks are bins of about equal bytes. An object that cannot be read yields its error instead of stopping the job.
    """
    sizes = ["size"] if "size" in paths.columns else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                digest, error = None, None
                try:
                    with opener(row.path) as stream:
                        digest = sha256_stream(stream)
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                out.append((row.bucket, row.key, digest, error))
            yield pd.DataFrame(out, columns=["bucket", "key", "sha256", "error"])

    return _spread(paths.select("bucket", "key", "path", *sizes), tasks).select("bucket", "key", "path").mapInPandas(
        run, "bucket string, key string, sha256 string, error string"
    )


def hash_chunks(chunks: DataFrame) -> DataFrame:
    """(bucket, key, sha256, size, chunks, error) of objects that are stored as rows (bucket, key, chunk, content).

    For objects beyond the 2 GiB that one row can hold. Chunks count from 0. The rows of an object come to one task in
    order, and its hash is carried from row to row and from batch to batch, so memory holds one batch of chunks. A
    chunk given twice counts once where both are equal; a chunk that is missing, null or has two contents yields an error and no hash.
    """
    schema = "bucket string, key string, sha256 string, size long, chunks long, error string"
    text, number = pa.string(), pa.int64()
    arrow = pa.schema(zip(("bucket", "key", "sha256", "size", "chunks", "error"), (text, text, text, number, number, text), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest, size, count, last, error = None, hashlib.sha256(), 0, 0, None, None
        done: list[dict] = []

        def close() -> None:
            if name is not None:
                found = None if error else digest.hexdigest()
                done.append(dict(zip(arrow.names, (*name, found, size, count, error), strict=True)))

        for batch in batches:
            for bucket, key, chunk, content in zip(*[batch.column(i) for i in range(4)], strict=True):
                if (bucket.as_py(), key.as_py()) != name:
                    close()
                    name, digest, size, count, last, error = (bucket.as_py(), key.as_py()), hashlib.sha256(), 0, 0, None, None
                place = chunk.as_py()
                data = content.as_buffer() if content.is_valid else None
                if error:
                    continue
                if data is None or place not in (count, count - 1) or place == -1:
                    error = f"chunk {count} is missing"
                elif place == count - 1:
                    error = None if last == hashlib.md5(data).digest() else f"chunk {place} has several contents"
                else:
                    digest.update(data)
                    size += len(data)
                    count += 1
                    last = hashlib.md5(data).digest()
            if done:
                yield pa.RecordBatch.from_pylist(done, arrow)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done, arrow)

    rows = chunks.select("bucket", "key", F.col("chunk").cast("long").alias("chunk"), F.col("content").cast("binary").alias("content"))
    return rows.repartition("bucket", "key").sortWithinPartitions("bucket", "key", "chunk").mapInArrow(run, schema)


def extract_tags(
    paths: DataFrame,
    extractor: Extractor,
    opener: Opener = open_uri,
    tasks: int | None = None,
    head: int = HEAD_BYTES,
) -> DataFrame:
    """Tags of the media objects at ``paths`` (bucket, key, path), from their first ``head`` bytes.

    ``extractor(data, extension)`` returns a mapping with any of artist, album, title, duration_s,
    codec, bitrate. Unreadable objects get a row of NULLs and an error, so they are not retried.
    """

    def read(row: Any) -> bytes:
        with opener(row.path) as stream:
            return stream.read(head)

    sizes = ["size"] if "size" in paths.columns else []
    rows = paths.select("bucket", "key", "path", F.lower(extension(F.col("key"))).alias("ext"), *sizes)
    return _spread(rows, tasks, head).select("bucket", "key", "path", "ext").mapInPandas(
        _extracting(extractor, read), f"bucket string, key string, {_TAG_TYPES}, error string"
    )


def tags_of_content(content: DataFrame, extractor: Extractor, head: int = HEAD_BYTES) -> DataFrame:
    """Tags of the rows (bucket, key, content), as ``extract_tags`` gives them; only the first ``head`` bytes leave the scan.

    Content that is null gives a row of NULLs and an error.
    """
    def read(row: Any) -> bytes:
        if row.head is None:
            raise FileNotFoundError("content not found")
        return bytes(row.head)

    rows = content.select(
        "bucket", "key", F.lower(extension(F.col("key"))).alias("ext"),
        F.substring(F.col("content").cast("binary"), 1, head).alias("head"),
    )
    return rows.mapInPandas(_extracting(extractor, read), f"bucket string, key string, {_TAG_TYPES}, error string")


def _extracting(
    extractor: Extractor, read: Callable[[Any], bytes]
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A task that reads the head of each row and extracts its tags; what fails is told in the row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                tags, error = None, None
                try:
                    tags = extractor(read(row), row.ext)
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                tags = tags or {}
                out.append((row.bucket, row.key, *[tags.get(t) for t in _TAGS], error))
            frame = pd.DataFrame(out, columns=["bucket", "key", *_TAGS, "error"], dtype=object)
            yield frame.astype({"duration_s": "Float64", "bitrate": "Int64"})

    return run
