"""License scan against plain Python: phrase places by list comparison, expressions by a recursive parser."""

from __future__ import annotations

import itertools
import random
import re

import pytest

from lakedupes.llm.licenses import BASE, FAMILIES, LOOSER, NOTICES, find_licenses, freedom_of, parse
from lakedupes.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    None, "", "  \n", "no notice here, only prose", "Released under the MIT License.",
    "under the mit license under the MIT license, cc-by-nc; CC BY NC 4.0 é cc by ncé",
    "Licensed under the Apache License, Version 2.0 (the 'License')\nAll rights reserved.",
    "permit license is not mit licensex", "x" * 50_000 + " GNU General Public License version 3 " + "y " * 30_000,
    "GNU Lesser General Public License, version 2.1 or the GNU General Public License",
    "# SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Foo-1.0\nmore words and so on",
    'license = "MIT OR CC0-1.0"\nlicense: see file\nLicense-Expression: LicenseRef-own-2',
    "SPDX-License-Identifier: ((MIT AND\nBSD-3-Clause)", "SPDX-License-Identifier: MIT with", "the mit", "license under the mit",
    "apache license version 2\x00apache license version 2", "SPDX-License-Identifier:" + " MIT OR" * 5_000 + " ISC",
]


def words_of(text: str | None) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base_places(text: str | None) -> list[tuple[int, str]]:
    words = words_of(text)
    return sorted(
        (i, label) for phrase, label in BASE.items() for i in range(len(words))
        if words[i:i + len(phrase.split())] == phrase.split()
    )


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, t, 1, "a") for i, t in enumerate([*TEXTS, TEXTS[5]])], "doc_id long, text string, findings int, `a.b` string")
    return {r.doc_id: r for r in find_licenses(docs).collect()}


def test_base(found):
    assert len(found) == len(TEXTS) + 1
    for i, text in enumerate([*TEXTS, TEXTS[5]]):
        assert [(f.word, f.label) for f in found[i].findings if f.kind == "base"] == base_places(text), text
        assert found[i].n_words == len(words_of(text))
        assert found[i]["a.b"] == "a"


def labels(row, kind: str) -> list[str]:
    return [f.label for f in row.findings if f.kind == kind]


def test_notices_and_tags(found):
    at = dict(enumerate(TEXTS))
    by = {t: found[i] for i, t in at.items()}
    assert labels(by[TEXTS[6]], "notice") == ["apache-2.0", "all-rights-reserved"] and by[TEXTS[6]].freedom == 0.0
    assert by[TEXTS[7]].findings == [] and by[TEXTS[7]].freedom is None
    assert labels(by[TEXTS[8]], "notice") == ["gpl-3.0"]
    assert labels(by[TEXTS[9]], "notice") == ["lgpl-2.1", "gpl"]
    tags = [f for f in by[TEXTS[10]].findings if f.kind == "tag"]
    assert [f.label for f in tags] == ["foo-1.0", "gpl-2.0-only", "mit"]
    assert {f.expression.text for f in tags} == {"(mit or gpl-2.0-only with classpath-exception-2.0) and foo-1.0"}
    assert by[TEXTS[10]].freedom == 0.5
    assert labels(by[TEXTS[11]], "tag") == ["cc0-1.0", "mit", "licenseref-own-2"]
    broken = [f.expression for f in by[TEXTS[12]].findings if f.kind == "tag"]
    assert broken[0].valid is False and broken[0].text == "( ( mit"
    assert labels(by[TEXTS[13]], "tag") == ["mit"]
    assert labels(by[TEXTS[17]], "tag") == ["isc", "mit"] and by[TEXTS[17]].freedom == 1.0


def value(tokens: list[str]) -> float:
    """Recursive descent over the same grammar."""
    def terms(level: int) -> float:
        if level == 3:
            token = tokens.pop(0)
            if token == "(":
                inner = terms(1)
                tokens.pop(0)
                return inner
            base = freedom_of(token)
            base = 0.5 if base is None else base
            if tokens[:1] == ["with"]:
                del tokens[:2]
                base = max(base, min(0.9, base + LOOSER))
            return base
        name, pick = [(), ("or", max), ("and", min)][level]
        out = terms(level + 1)
        while tokens[:1] == [name]:
            tokens.pop(0)
            out = pick(out, terms(level + 1))
        return out

    return terms(1)


def test_expressions():
    r = random.Random(3)

    def make(depth: int) -> str:
        if depth == 0 or r.random() < 0.3:
            name = r.choice([*FAMILIES, "gpl-2.0+", "new-1.0", "lgpl-2.1-or-later"])
            return name + (" with some-exception" if r.random() < 0.2 else "")
        inner = f" {r.choice(('or', 'and'))} ".join(make(depth - 1) for _ in range(r.randint(1, 3)))
        return f"({inner})" if r.random() < 0.5 else inner

    for _ in range(300):
        text = make(3)
        done = parse(text)
        assert done.valid and done.freedom == value(re.findall(r"[()]|[^ ()]+", text))
        again = parse(done.text)
        assert (again.text, again.freedom, again.ids) == (done.text, done.freedom, done.ids)


def test_expression_ends():
    assert parse("mit is free").text == "mit"
    assert parse("or mit") is None and parse("") is None and parse("word") is None
    assert parse("word", any_id=False) is None and parse("word-1 or mit", any_id=False) is None
    assert parse("xx mit\nor isc", True, 3).ids == ("mit",)
    assert parse("mit or isc", True, 0, 5).ids == ("mit",)


def test_query(spark, folder, rows):
    done = QUERIES["op11_licenses"](spark, folder).collect()
    want = []
    for i, text, *_ in rows:
        places = base_places(text)
        at = [p for p, _ in places]
        want.append((i, len(words_of(text)), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
    key = lambda t: repr(t)
    assert sorted((tuple(r)[:6] for r in done), key=key) == sorted(want, key=key)
    for r in done:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_phrases_are_words():
    for phrase in itertools.chain(BASE, NOTICES):
        assert WORD.findall(phrase) == phrase.split(" ")
