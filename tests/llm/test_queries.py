"""Every registered query of the package, on whole small tables, against plain Python."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import pytest
import sentencepiece

import __spark_entry__ as contract
from lakedupes.llm.queries import ORACLES, QUERIES, tokenizer_path
from tests.llm.conftest import BENCHMARK, crc
from workload.check import canonical, duck

sha = lambda data: hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()
lower = lambda text: re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def run(spark, folder):
    done = {}

    def result(name: str) -> list:
        if name not in done:
            done[name] = QUERIES[name](spark, folder).collect()
        return done[name]

    return result


def same(found, expected) -> None:
    assert sorted(map(repr, found)) == sorted(map(repr, expected))


def test_registered():
    assert set(QUERIES) <= set(contract.queries())
    assert len([q for q in QUERIES if q.startswith("op")]) == 13


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_folder, name):
    assert QUERIES[name](spark, empty_folder).collect() == []


def test_piece_tokens(run, rows):
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    want = []
    for i, text, *_ in rows:
        ids = model.encode(text or "", add_eos=True)
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(model.decode(ids))))
    same([tuple(r) for r in run("op1_piece_tokens")], want)


def test_quality(run, rows):
    found = run("op2_quality")
    same([r.doc_id for r in found], [r[0] for r in rows])
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert all(r.held_out == (r.doc_id is not None and crc(r.doc_id) % 3 == 1) for r in found)
    held = [r for r in found if r.held_out and r.doc_id >= 100]
    right = sum(r.predicted == (not 400 <= r.doc_id < 500) for r in held)
    assert right / len(held) >= 0.9


def jaccard_components(sets: list[frozenset], percent: int) -> list[int]:
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x and 100 * both >= percent * len(x | sets[j]) and find(i) != find(j):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def word_set(text: str, size: int) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def test_paragraphs(run, rows):
    places, sets = [], []
    for i, text in sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=lambda r: r[0]):
        at = 0
        for line in (text or "").split("\n"):
            size = len(line.encode())
            if len(re.findall(r"[^\x20\x09-\x0D]+", line)) >= 20:
                places.append((i, at, at + size))
                sets.append(word_set(line, 5))
            at += size + 1
    groups = collections.defaultdict(list)
    for k, root in enumerate(jaccard_components(sets, 80)):
        groups[root].append(places[k])
    gone, heads = collections.defaultdict(list), collections.defaultdict(set)
    for members in groups.values():
        head, *others = sorted(members)
        for i, a, b in others:
            gone[i].append((a, b))
            heads[i].add(head[0])
    count = collections.Counter(p[0] for p in places)
    want = [
        (r[0], count[r[0]], len(gone[r[0]]), sorted(heads[r[0]]), ",".join(f"{a}:{b}" for a, b in sorted(gone[r[0]]))) for r in rows
    ]
    same([tuple(r) for r in run("op3_paragraphs")], want)
    assert any(w[2] for w in want)


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def test_secrets(run, rows):
    want = []
    for i, text, *_ in rows:
        text = text or ""
        found = [
            [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12],
            [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18],
            [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16],
        ]
        spans = sorted((a, k, f"{kind}:{a}:{b}") for k, part in enumerate(found) for kind, a, b in part)
        want.append((i, *map(len, found), sha(",".join(s[2] for s in spans))))
    got = run("op4_secrets")
    same([tuple(r)[:5] for r in got], want)
    for r in got:
        base = [s for s in r.spans.split(",") if s and not s.startswith("random")]
        assert sha(",".join(base)) == r.base_sha256


def test_substrings(run, rows):
    seen: dict[bytes, int] = {}
    for i, text, *_ in rows:
        data = (text or "").encode()
        for k in range(len(data) - 49 if i is not None else 0):
            seen[data[k:k + 50]] = min(i, seen.get(data[k:k + 50], i))
    want = []
    for i, text, *_ in rows:
        data = (text or "").encode()
        hit = bytearray(len(data))
        for k in range(len(data) - 49 if i is not None else 0):
            if seen[data[k:k + 50]] < i:
                hit[k:k + 50] = b"\1" * 50
        runs = len(re.findall(b"\1+", bytes(hit)))
        kept = bytes(b for b, h in zip(data, hit, strict=True) if not h)
        want.append((i, len(data), sum(hit), runs, sha(kept)))
    same([tuple(r) for r in run("op5_substrings")], want)
    assert sum(w[2] for w in want) > 1000


def test_minhash_forest(run, rows):
    sets = [word_set(r[1] or "", 3) for r in rows]
    groups = collections.defaultdict(list)
    for k, root in enumerate(jaccard_components(sets, 85)):
        groups[root].append(rows[k][0])
    want = []
    for k, root in enumerate(jaccard_components(sets, 85)):
        ids = [i for i in groups[root] if i is not None] if sets[k] else [rows[k][0]]
        least = min(ids) if ids else None
        want.append((rows[k][0], len(sets[k]), least, rows[k][0] == least))
    same([tuple(r) for r in run("op6_minhash_forest")], want)
    assert any(len(g) > 5 for g in groups.values())


def test_neighbours(spark, run, folder):
    proper = {}
    for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect():
        v = r.embedding
        if r.vec_id is not None and v and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v):
            proper[r.vec_id] = v
    got = collections.defaultdict(list)
    for r in sorted(run("op7_neighbours"), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    queries = [q for q in proper if q % 20 == 0]
    assert sorted(got) == sorted(queries)
    hits = total = 0
    for q in queries:
        exact = {i: math.fsum(a * b for a, b in zip(proper[q], v, strict=True)) for i, v in proper.items() if i != q}
        best = sorted(exact, key=lambda i: (-round(exact[i], 9), i))[:20]
        assert [n for n, _, _ in got[q]] == list(range(1, len(got[q]) + 1))
        assert all(abs(s - exact[i]) < 1e-9 for _, i, s in got[q])
        order = [(-round(s, 9), i) for _, i, s in got[q]]
        assert order == sorted(order)
        hits, total = hits + len(set(best) & {i for _, i, _ in got[q]}), total + len(best)
    assert hits / total >= 0.9


def test_shards(run, rows):
    got = run("op8_shards")
    want = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows]
    same([(r.doc_id, r.size, r.text_crc32) for r in got], want)
    slots = collections.defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(24))
    assert max(map(len, slots.values())) - min(len(slots[i]) for i in range(24)) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_language(run, rows):
    got = run("op9_language")
    same([r.doc_id for r in got], [r[0] for r in rows])
    text = {r[0]: r[1] for r in rows}
    lang = {r[0]: r[2] for r in rows}
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text[r.doc_id] or ""))
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and crc(r.doc_id) % 4 == 2)
    # Every seventh text holds an English passage, whatever its language.
    held = [r for r in got if r.held_out and 100 <= r.doc_id < 300 and (r.doc_id >= 200 or r.doc_id % 7 != 2)]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) >= 0.95


def test_decontaminate(run, rows):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = collections.defaultdict(set)
    for item, text in BENCHMARK:
        words = cut(text)
        for k in range(max(1, len(words) - 9) if words else 0):
            windows[tuple(words[k:k + 10])].add(item)
    sizes = {len(w) for w in windows}
    want = []
    for i, text, *_ in rows:
        words, hit, items = cut(text), set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if found := windows.get(tuple(words[k:k + n])):
                    hit |= set(range(k, k + n))
                    items |= found
        ids = sorted(str(x) for x in items if x is not None)
        want.append((i, len(words), len(hit), len(ids), sha(",".join(ids)), bool(hit)))
    same([tuple(r) for r in run("op10_decontaminate")], want)
    assert sum(w[5] for w in want) >= 4


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    data = "/root/testdata/sf0.001"
    got, want = QUERIES[name](spark, data).toPandas(), duck(data).execute(ORACLES[name]).df()
    assert canonical(got).equals(canonical(want))
