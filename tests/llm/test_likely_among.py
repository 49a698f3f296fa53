from __future__ import annotations

from pyspark.sql import functions as F

from lakedupes.llm import paragraphs
from lakedupes.llm.minhash_forest import bits_for, likely_among
from lakedupes.llm.paragraphs import repeated_paragraphs


def test_only_rows_of_members_pass(spark):
    """Every member passes and few others do, by two keys; with a name all rows come back, marked."""
    rows = spark.range(4000).select((F.col("id") % 7).alias("tree"), F.col("id").alias("hi"), F.lit("x").alias("page"))
    members = rows.where("hi < 100").select("tree", "hi")
    got = {r.hi for r in likely_among(rows, members, ["tree", "hi"], bits_for(100)).collect()}
    assert set(range(100)) <= got and len(got) < 1000
    marked = likely_among(rows, members, ["tree", "hi"], bits_for(100), "among").collect()
    assert len(marked) == 4000 and {r.hi for r in marked if r.among} == got and marked[0].page == "x"
    none = likely_among(rows, members.where("false"), ["tree", "hi"], bits_for(0), "among")
    assert none.where("among").count() == 0 and none.count() == 4000
    assert bits_for(10**12) == 1 << 27


def test_paragraphs_without_copies_stay_where_they_are(spark, monkeypatch):
    """Of 600 paragraphs two are alike: only labels and rows of few others than these are joined."""
    sizes = {}

    def watch(name):
        inner = getattr(paragraphs, name)

        def run(rows, *more, **others):
            sizes.setdefault(name, []).append(rows.count())
            return inner(rows, *more, **others)

        monkeypatch.setattr(paragraphs, name, run)

    watch("join_groups")
    watch("join_counted")
    words = lambda i: " ".join(f"w{i}n{k}" for k in range(30))
    rows = [(i, words(i)) for i in range(599)] + [(900, words(5) + " more")]
    found = {r.doc_id: r for r in repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found) == 600 and all(r.n_paragraphs == 1 for r in found.values())
    assert [i for i, r in found.items() if r.removed] == [900] and found[900].copies_of == [5]
    # 6,600 labels and 600 paragraphs in all.
    assert sizes["join_groups"][0] < 700 and sizes["join_counted"][0] < 60
