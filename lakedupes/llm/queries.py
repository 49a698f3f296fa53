"""One query per operator over the given tables, and its DuckDB counterpart where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakedupes.llm.alignment import align
from lakedupes.llm.decontaminate import contamination_report
from lakedupes.llm.language import identify
from lakedupes.llm.licenses import find_licenses
from lakedupes.llm.minhash_forest import near_duplicates
from lakedupes.llm.neighbours import nearest
from lakedupes.llm.paragraphs import repeated_paragraphs
from lakedupes.llm.piece_tokens import encode_decode
from lakedupes.llm.quality import scores
from lakedupes.llm.secrets import KINDS, find_secrets
from lakedupes.llm.shards import shard_rows
from lakedupes.llm.spellings import variants
from lakedupes.llm.substrings import repeated_bytes


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_piece_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of ids and decoded texts of all documents."""
    done = encode_decode(documents(spark, folder).select("doc_id", "text"), tokenizer_path())
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality scores of all documents."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return scores(documents(spark, folder).select("doc_id", "text"), labels)


def op3_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated paragraphs of all documents, and the documents that keep them."""
    found = repeated_paragraphs(documents(spark, folder).select("doc_id", "text"))
    span = lambda r: F.concat_ws(":", r["begin"].cast("string"), r["end"].cast("string"))
    return found.select(
        "doc_id", "n_paragraphs", F.size("removed").cast("long").alias("n_removed"), "copies_of",
        F.array_join(F.transform("removed", span), ",").alias("removed"),
    )


def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in all documents."""
    found = find_secrets(documents(spark, folder).select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] != "random")
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
    )


def op5_substrings(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated strings of 50 bytes cut out of all documents."""
    done = repeated_bytes(documents(spark, folder).select("doc_id", "text"), length=50)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["begin"])
    return done.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op6_minhash_forest(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all documents: three-word shingles, similarity 0.85."""
    return near_duplicates(documents(spark, folder).select("doc_id", "text"), size=3, percent=85)


def op7_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors of every 20th vector."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % 20 == 0, k=20)


def op8_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 24 shards of equal numbers of rows, copies together where there is room."""
    return shard_rows(documents(spark, folder).select("doc_id", "text"), shards=24)


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of all documents."""
    return identify(documents(spark, folder).select("doc_id", "lang", "text"))


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Which words of all documents lie in windows of all benchmark items."""
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    return contamination_report(documents(spark, folder), benchmark).select(
        "doc_id", F.col("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op11_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and identifiers in all documents; the score says how far the licences found restrict use (0: none found)."""
    found = find_licenses(documents(spark, folder).select("doc_id", "text"))
    base = F.filter("findings", lambda f: f["kind"] == "base")
    label = lambda rows: F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda f: f["label"]))), ",")
    place = F.transform(base, lambda f: f["word"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(place).alias("first_word"), F.array_max(place).alias("last_word"),
        label(base).alias("base_labels"), label(F.col("findings")).alias("labels"),
        (1 - F.coalesce("freedom", F.lit(1.0))).alias("score"),
    )


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """All documents by two tokenizers: groups, links, and how many documents share the linked pairs."""
    return align(documents(spark, folder), tokenizer_path("byte_bpe_50k.json"), tokenizer_path()).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


def op13_spellings(spark: SparkSession, folder: str) -> DataFrame:
    """The words of all documents, their near words, and the commoner form of each."""
    return variants(documents(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_piece_tokens": op1_piece_tokens,
    "op2_quality": op2_quality,
    "op3_paragraphs": op3_paragraphs,
    "op4_secrets": op4_secrets,
    "op5_substrings": op5_substrings,
    "op6_minhash_forest": op6_minhash_forest,
    "op7_neighbours": op7_neighbours,
    "op8_shards": op8_shards,
    "op9_language": op9_language,
    "op10_decontaminate": op10_decontaminate,
    "op11_licenses": op11_licenses,
    "op12_alignment": op12_alignment,
    "op13_spellings": op13_spellings,
}

_ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op10_decontaminate": f"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
                {_ASCII_LOWER.format("coalesce(text, '')")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w
            FROM documents),
        b AS (
            SELECT item_id, regexp_extract_all(
                {_ASCII_LOWER.format("coalesce(text, '')")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w
            FROM benchmark),
        bw AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n,
                array_to_string(w[i + 1:i + least(len(w), 10)], ' ') AS g
            FROM (SELECT *, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
        m AS (SELECT DISTINCT n FROM bw),
        dw AS (
            SELECT r, n, i, array_to_string(w[i + 1:i + n], ' ') AS g
            FROM (SELECT r, w, n, unnest(range(0, greatest(len(w) - n, -1) + 1)) AS i FROM d, m)),
        o AS (SELECT r, dw.n, i, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
        h AS (SELECT r, count(DISTINCT p) AS n_hit
              FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM o)) GROUP BY r),
        t AS (SELECT r, count(DISTINCT item_id) AS n_items,
                  string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
              FROM o GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
            coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
            n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)""",
}
