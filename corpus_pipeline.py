"""A training corpus from raw documents: five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakedupes.llm.decontaminate import drop_contaminated
from lakedupes.llm.minhash_forest import keep_one
from lakedupes.llm.piece_tokens import encode_decode
from lakedupes.llm.quality import keep_good
from lakedupes.llm.queries import documents, tokenizer_path
from lakedupes.llm.secrets import redact
from lakedupes.staging import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every document stays."""
    return redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of each text, and their number."""
    encoded = encode_decode(docs, tokenizer_path())
    return encoded.selectExpr("doc_id", "lang", "source", "ids", "cast(size(ids) AS bigint) AS n_tokens")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]

# Cosine features, MinHash and piece segmentation have no SQL form; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again by the next."""
    docs = documents(spark, sf_dir)
    for _, step in STAGES[:-1]:
        docs, _ = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
