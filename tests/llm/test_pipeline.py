from __future__ import annotations

import collections

import pytest

import corpus_pipeline
from lakedupes.llm.components import components
from lakedupes.llm.queries import documents
from lakedupes.llm.secrets import redact


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """What each stage returned, written and read again."""
    docs, out = documents(spark, folder), {"": documents(spark, folder)}
    for name, step in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        step(spark, docs, folder).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def ids(df) -> collections.Counter:
    return collections.Counter(r.doc_id for r in df.select("doc_id").collect())


def test_columns(stages):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].schema == stages[""].schema


def test_decisions(stages):
    start, good, single, clean, masked = (ids(stages[n]) for n in ("", "quality", "near_duplicates", "decontamination", "secrets"))
    junk = {i for i in start if i and 400 <= i < 500}
    assert not junk & set(good) and good[100] == 1
    assert good <= start and single <= good and clean <= single and masked == clean
    assert len([i for i in single if i and 300 <= i < 400]) == 0  # copies of document 103
    assert 9 not in clean and 8 in clean
    texts = {r.doc_id: r for r in stages["secrets"].collect()}
    assert "abcDEF123456789" not in texts[8].text and texts[8].text.endswith('[secret]" end')
    assert texts[8].n_chars == len(texts[8].text)
    before = {r.doc_id: r.text for r in stages["decontamination"].collect()}
    assert 7 not in texts or "abcDEF123456789" not in texts[7].text and "Z9Z9" not in texts[7].text
    assert all(texts[i].text == before[i] for i in texts if i not in (7, 8))  # no other text holds a secret


def test_run(spark, stages, folder):
    got = {(r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == {(r.doc_id, tuple(r.ids)) for r in stages["tokens"].collect()}


def test_redaction_keeps_rows(spark):
    docs = spark.createDataFrame(
        [(1, 'x token: "abcdefghijklmnop" y', 7, 1), (2, None, 0, 2), (3, "plain", 5, 3)], "doc_id long, text string, n_chars long, _spans long"
    )
    assert sorted(map(tuple, redact(docs).collect())) == [(1, 'x [secret]" y', 13, 1), (2, None, 0, 2), (3, "plain", 5, 3)]


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (300, 300)]
    found = {r.v: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
