"""License notices and identifier tags in texts, and the licence expressions behind the tags.

The words of a slice of texts are laid out as one string, and one Aho-Corasick automaton finds every notice
phrase and identifier tag in it in a single pass. Behind a tag the raw line is read as a licence
expression, which a shunting-yard parser brings into postfix order and evaluates: each licence has a
freedom between 0 and 1, OR takes the greater, AND the lesser, and an exception after WITH
loosens the licence before it.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lakedupes.llm.batches import byte_set, lower_ascii, text_buffer, words
from lakedupes.llm.columns import with_made

# Phrases whose places are counted as they stand, and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Other notices, and the identifiers that they stand for. Inside a longer notice a shorter one does not count.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "apache license version 2 0": "apache-2.0",
    "apache license 2 0": "apache-2.0",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "version 2 of the gnu general public license": "gpl-2.0",
    "version 3 of the gnu general public license": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu lesser general public license version 2 1": "lgpl-2.1",
    "gnu lesser general public license version 3": "lgpl-3.0",
    "gnu affero general public license": "agpl",
    "gnu affero general public license version 3": "agpl-3.0",
    "mozilla public license": "mpl",
    "mozilla public license version 2 0": "mpl-2.0",
    "mozilla public license v 2 0": "mpl-2.0",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 2 clause license": "bsd-2-clause",
    "bsd 3 clause license": "bsd-3-clause",
    "isc license": "isc",
    "boost software license": "bsl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "cc by": "cc-by",
    "cc by 4 0": "cc-by-4.0",
    "cc by sa": "cc-by-sa",
    "cc by sa 4 0": "cc-by-sa-4.0",
    "cc by nc": "cc-by-nc",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0 1 0 universal": "cc0-1.0",
    "creative commons attribution": "cc-by",
    "creative commons attribution 4 0": "cc-by-4.0",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons zero": "cc0",
    "all rights reserved": "all-rights-reserved",
}

# Words of an identifier tag; an expression follows. True: any identifier may follow, else only a known one.
TAGS = {"spdx license identifier": True, "license expression": True, "license": False, "licence": False}

# Freedom of the licences whose identifiers start like this; the longest start decides.
FAMILIES = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "0bsd": 1.0, "isc": 1.0, "zlib": 1.0, "bsl": 1.0, "unlicense": 1.0,
    "cc0": 1.0, "wtfpl": 1.0, "ncsa": 1.0, "postgresql": 1.0, "psf": 1.0, "cc-by": 0.9, "artistic": 0.9, "odc-by": 0.9,
    "mpl": 0.7, "epl": 0.7, "lgpl": 0.7, "cddl": 0.7, "eupl": 0.6, "cc-by-sa": 0.6, "odbl": 0.6, "gpl": 0.4, "agpl": 0.3,
    "cc-by-nc": 0.2, "cc-by-nd": 0.2, "proprietary": 0.0, "all-rights-reserved": 0.0,
}
UNKNOWN = 0.5  # freedom of an identifier of no known family
LOOSER = 0.2  # what an exception adds, up to 0.9

_SEPARATORS = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
_TOKEN = re.compile(r"[ \t]*([()]|[a-z0-9][a-z0-9.+-]*)")
_LEAD = re.compile(r"[\"']?[ \t]*[:=][ \t\"'\[]*")
_ID = re.compile(r"(?=.*[0-9-])[a-z][a-z0-9.-]*[a-z0-9]\+?")
_OPERATORS = {"or": 1, "and": 2, "with": 3}


def freedom_of(identifier: str) -> float | None:
    """Freedom of a licence by the family of its identifier; None where the family is unknown."""
    parts = identifier.rstrip("+").split("-")
    for n in range(len(parts), 0, -1):
        if (start := "-".join(parts[:n])) in FAMILIES:
            return FAMILIES[start]
    return None


@dataclass(frozen=True)
class Expression:
    """A licence expression: its identifiers, its normal form, and the freedom it leaves.

    ``valid`` is false where a parenthesis is missing; then the least free identifier counts.
    """

    ids: tuple[str, ...]
    text: str
    freedom: float
    valid: bool


def _tokens(text: str, any_id: bool, at: int, close: int) -> list[str]:
    """The tokens of the expression at ``at``, up to the first that cannot follow; none crosses a line."""
    found: list[str] = []
    depth, operand = 0, True  # operand: an identifier or ( comes next
    while match := _TOKEN.match(text, at, close):
        token = match[1]
        if token == "(" and operand and not (found and found[-1] == "with"):
            depth += 1
        elif token == ")" and not operand and depth:
            depth -= 1
        elif not operand and token in _OPERATORS:
            if token == "with" and (found[-1] == ")" or found[-2:-1] == ["with"]):
                break
            operand = True
        elif operand and token not in _OPERATORS and token not in "()":
            token = token.rstrip(".-")
            exception = bool(found) and found[-1] == "with"
            if not (exception or freedom_of(token) is not None or any_id and _ID.fullmatch(token)):
                break
            operand = False
        else:
            break
        found.append(token)
        at = match.end()
    while found and (found[-1] in _OPERATORS or found[-1] == "("):
        depth -= found.pop() == "("
    return found


def _postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: operators leave the stack before weaker ones come; None where a parenthesis is open."""
    out: list[str] = []
    waiting: list[str] = []
    for token in tokens:
        if token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        elif token in _OPERATORS:
            while waiting and waiting[-1] != "(" and _OPERATORS[waiting[-1]] >= _OPERATORS[token]:
                out.append(waiting.pop())
            waiting.append(token)
        else:
            out.append(token)
    if "(" in waiting:
        return None
    return out + waiting[::-1]


def _joined(operator: str, left: tuple, right: tuple) -> tuple[float, str, str]:
    """Freedom, text and operator of two joined values; a weaker operator inside gets parentheses."""
    def inside(value: tuple) -> str:
        return f"({value[1]})" if value[2] and _OPERATORS[value[2]] < _OPERATORS[operator] else value[1]

    if operator == "with":
        freedom = max(left[0], min(0.9, left[0] + LOOSER))
    else:
        freedom = max(left[0], right[0]) if operator == "or" else min(left[0], right[0])
    return freedom, f"{inside(left)} {operator} {inside(right)}", operator


def parse(text: str, any_id: bool = True, at: int = 0, close: int | None = None) -> Expression | None:
    """The licence expression at ``at`` in ``text`` (lower case), before ``close``, or None.

    It is as long as tokens can follow each other on its line: an operator at the end, and what cannot belong to it,
    are left out. With ``any_id`` its identifiers may be of no known family.
    """
    tokens = _tokens(text, any_id, at, len(text) if close is None else close)
    names = [t for i, t in enumerate(tokens) if t not in _OPERATORS and t not in "()" and tokens[i - 1:i] != ["with"]]
    if not names:
        return None
    values = {n: UNKNOWN if (known := freedom_of(n)) is None else known for n in names}
    ids = tuple(sorted(set(names)))
    order = _postfix(tokens)
    if order is None:
        return Expression(ids, " ".join(tokens), min(values.values()), False)
    stack: list[tuple[float, str, str]] = []
    for token in order:
        if token in _OPERATORS:
            right = stack.pop()
            stack.append(_joined(token, stack.pop(), right))
        else:
            stack.append((values.get(token, UNKNOWN), token, ""))
    return Expression(ids, stack[0][1], stack[0][0], True)


@functools.lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for phrase in {**BASE, **NOTICES, **TAGS}:
        automaton.add_word(phrase, phrase)
    automaton.make_automaton()
    return automaton


def _outermost(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The (first word, number of words, label) that lie in no other one, in order."""
    kept: list[tuple[int, int, str]] = []
    for first, n, label in sorted(found, key=lambda f: (f[0], -f[1])):
        if not kept or first + n > kept[-1][0] + kept[-1][1]:
            kept.append((first, n, label))
    return kept


def _scan(texts: pa.Array) -> tuple[np.ndarray, list[list[dict]]]:
    """Number of words, and findings, of each text."""
    raw, offsets = text_buffer(texts)
    raw = lower_ascii(raw)
    plain = raw.tobytes().decode("latin-1")  # a character per byte
    starts, ends, owner = words(raw, offsets, _SEPARATORS)
    count = np.bincount(owner, minlength=len(texts))
    sizes = ends - starts
    # All words with one separator behind each; a line feed after the last of a text, so no phrase crosses texts.
    inside = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    line = np.insert(raw[inside], np.cumsum(sizes), 32)
    word_ends = np.cumsum(sizes + 1) - 1
    last = np.ones(len(owner), bool)
    last[:-1] = owner[1:] != owner[:-1]
    line[word_ends[last]] = 10
    word_starts = word_ends - sizes
    first_of = np.cumsum(count) - count
    found: list[list[dict]] = [[] for _ in range(len(texts))]
    notices: dict[int, list[tuple[int, int, str]]] = {}
    for end, phrase in _automaton().iter(line.tobytes().decode("latin-1")):
        begin = end + 1 - len(phrase)
        if line[end + 1] > 32 or begin and line[begin - 1] > 32:
            continue
        at = int(np.searchsorted(word_starts, begin))
        n = phrase.count(" ") + 1
        text = int(owner[at])
        word = at - int(first_of[text])
        if phrase in BASE:
            found[text].append({"kind": "base", "word": word, "n_words": n, "label": BASE[phrase], "expression": None})
        if phrase in NOTICES:
            notices.setdefault(text, []).append((word, n, NOTICES[phrase]))
        if phrase in TAGS:
            close = int(offsets[text + 1])
            lead = _LEAD.match(plain, int(ends[at + n - 1]), close)
            expression = parse(plain, TAGS[phrase], lead.end(), close) if lead else None
            for label in expression.ids if expression else ():
                found[text].append({
                    "kind": "tag", "word": word, "n_words": n, "label": label,
                    "expression": {"text": expression.text, "freedom": expression.freedom, "valid": expression.valid},
                })
    for text, spans in notices.items():
        found[text] += [
            {"kind": "notice", "word": word, "n_words": n, "label": label, "expression": None}
            for word, n, label in _outermost(spans)
        ]
    for rows in found:
        rows.sort(key=lambda r: (r["word"], r["kind"], r["n_words"], r["label"]))
    return count, found


FINDING = "struct<kind: string, word: bigint, n_words: int, label: string, expression: struct<text: string, freedom: double, valid: boolean>>"


def find_licenses(docs: DataFrame, column: str = "text") -> DataFrame:
    """``n_words``, ``findings`` and ``freedom`` of every row's text, beside the other columns.

    A finding has its kind (``base``: a phrase of ``BASE``, every place of it; ``notice``: a phrase of ``NOTICES`` that lies in
    no longer one; ``tag``: an identifier of the expression behind a tag), its first word (from 0), its number of words and its
    label, for tags also the evaluated expression; findings come by word, kind, length and label. ``freedom`` is the
    least that a notice or expression leaves, null without any. Columns of these names are replaced; a null
    text counts as empty, has no words and no findings. Rows are independent: repeated rows give repeated results.
    """
    kind = pa.list_(pa.struct([
        ("kind", pa.string()), ("word", pa.int64()), ("n_words", pa.int32()), ("label", pa.string()),
        ("expression", pa.struct([("text", pa.string()), ("freedom", pa.float64()), ("valid", pa.bool_())])),
    ]))

    def freedom(rows: list[dict]) -> float | None:
        each = [
            r["expression"]["freedom"] if r["expression"] else UNKNOWN if (f := freedom_of(r["label"])) is None else f
            for r in rows
        ]
        return min(each, default=None)

    def scan(texts: pa.Array) -> list[pa.Array]:
        count, found = _scan(texts)
        return [pa.array(count, pa.int64()), pa.array(found, kind), pa.array(map(freedom, found), pa.float64())]

    made = {"n_words": "bigint", "findings": f"array<{FINDING}>", "freedom": "double"}
    return with_made(docs, column, made, lambda: scan)
