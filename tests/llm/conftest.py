from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import SparkSession

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, key string, a long"


def sentence(random_: random.Random, n: int, syllables: tuple[str, ...]) -> str:
    return " ".join("".join(random_.choices(syllables, k=random_.randint(1, 3))) for _ in range(n))


LANGUAGES = {
    "en": ("the", "and", "ing", "tion", "er", "ow", "sh"),
    "de": ("sch", "ung", "ein", "für", "ß", "keit", "ä"),
}


def build_documents() -> list[tuple]:
    """Texts with everything that may be odd; ``key`` and ``a`` clash with names used inside."""
    r = random.Random(4)
    rows: list[tuple[int | None, str | None, str | None]] = []
    passage = sentence(r, 60, LANGUAGES["en"])
    for i in range(40):
        lang = "en" if i % 3 else "de"
        lines = [sentence(r, r.randint(5, 60), LANGUAGES[lang]) for _ in range(r.randint(1, 4))]
        if i % 7 == 0:
            lines.insert(r.randint(0, len(lines)), passage)
        rows.append((100 + i, "\n".join(lines), lang))
    base = sentence(r, 120, LANGUAGES["en"])
    for i in range(12):  # near copies around a base, at distances on both sides of the threshold
        words = base.split()
        for _ in range(i // 2):
            words[r.randrange(len(words))] = f"edit{r.randrange(3)}x{i}"
        rows.append((200 + i, " ".join(words), "en"))
    rows += [(300 + i, rows[3][1], "en") for i in range(6)]
    for i in range(30):
        junk = " ".join(f"{w}!!".upper() for w in sentence(r, 30, LANGUAGES["en"]).split())
        rows.append((400 + i, junk, "en"))
    rows += [
        (1, None, "en"), (2, "", None), (3, " \n\t ", "de"), (4, "one", "en"), (5, "Two WORDS", "de"), (6, "12 34", None),
        (7, 'password: "abcDEF123456789" and token=short AKIA' + "Z9" * 10 + " " + "0123456789abcdef" * 2 + " é token = x/y.z_w-1234567", "en"),
        (8, sentence(r, 9000, LANGUAGES["en"]) + ' secret = "abcDEF123456789" end', "en"),
        (9, "window " * 30 + "Alpha BETA gamma delta, epsilon zeta eta theta iota kappa lambda mu.", "en"),
        (10, "odd ▁ marks  and\r\n\x00 bytes 日本 😀 " + "é" * 60, "en"),
        (11, "short item here: Uno DOS tres. x", "en"), (4, "one", "en"),
    ]
    return [(i, t, lang, f"src{k % 3}", None if t is None else len(t), "k", k) for k, (i, t, lang) in enumerate(rows)] + [
        (None, "no id at all but some words here", "en", "src0", 5, None, None)
    ]


BENCHMARK = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "uno dos TRES"), (3, "two words"),
    (4, None), (5, "  ,. "), (6, "never seen words at all in any text of these documents here anywhere"), (7, "one"), (None, "alpha beta gamma"),
]


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    return build_documents()


@pytest.fixture(scope="session")
def folder(spark: SparkSession, tmp_path_factory, rows) -> str:
    """All tables that the queries read, small."""
    path = str(tmp_path_factory.mktemp("llm"))
    save(spark, path, rows)
    return path


@pytest.fixture(scope="session")
def empty_folder(spark: SparkSession, tmp_path_factory) -> str:
    path = str(tmp_path_factory.mktemp("empty"))
    save(spark, path, [], empty=True)
    return path


def save(spark: SparkSession, path: str, rows: list[tuple], empty: bool = False) -> None:
    def write(name: str, data: list, schema: str) -> None:
        spark.createDataFrame(data, schema).coalesce(2).write.parquet(f"{path}/{name}.parquet")

    r = random.Random(9)
    write("documents", rows, DOCUMENTS)
    write("benchmark", [] if empty else BENCHMARK, "item_id long, text string")
    marks = [(i, 0 if 400 <= i < 500 else 1, 0) for i, *_ in rows if i is not None and i >= 100]
    write("labels", marks + ([] if empty else [(100, 1, None), (9999, None, 0), (None, 1, 0)]), "doc_id long, quality int, toxic int")
    vectors = [(i, [r.gauss(0, 1) for _ in range(16)], 1) for i in range(300)]
    vectors += [(300 + i, vectors[7][1], 1) for i in range(30)]  # ties
    vectors += [
        (400, None, 1), (420, [0.0] * 16, 1), (440, [float("nan")] * 16, 1), (460, [1.0] * 15, 1), (480, [None, *[1.0] * 15], 1),
        (500, [float("inf"), *[1.0] * 15], 1), (None, [1.0] * 16, 1), vectors[20],
    ]
    write("embeddings", [] if empty else vectors, "vec_id long, embedding array<float>, label int")


def crc(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())
