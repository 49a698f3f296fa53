from __future__ import annotations

import posixpath
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lakedupes.functions import names, paths, rules, text

ALPHABET = "aB1._-/ ()é \\"


def apply(make, fn, values):
    df = make.texts(*values).select("t", fn(F.col("t")).alias("out"))
    got = {r.t: r.out for r in df.collect()}
    return [got[v] for v in values]


def random_texts(n, alphabet=ALPHABET, seed=1, longest=14):
    rng = random.Random(seed)
    return sorted({
        "".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)
    })


def test_paths_agree_with_posix(make):
    values = random_texts(1500, "ab._/") + [".mp3", "a/.mp3", "a/b.", "..a.b", "x/..", "n\n.a"]
    assert apply(make, paths.basename, values) == [posixpath.basename(v) for v in values]
    assert apply(make, paths.extension, values) == [posixpath.splitext(v)[1] for v in values]
    assert apply(make, paths.without_extension, values) == [
        posixpath.splitext(v)[0] for v in values
    ]


def test_media_and_class(make):
    values = ["a.mp3", "a.flac", "a.mp4", "a.mkv", "Song.MP3", "a.pdf", "a.jpg", "a.txt", "a",
              "x/.mp3"]
    assert apply(make, paths.is_media_file, values) == [True] * 5 + [False] * 5
    assert apply(make, paths.file_class, ["a.MP3", "x/.mp3", "c.JPG", "v.mkv", "mp3"]) == [
        "media", "media", "image", "other", "other"
    ]


def test_folder_at_and_base(make):
    def at(k):
        return paths.folder_at(k, 3)

    assert apply(make, at, ["m/a/b/c.mp3", "m/a/b", "m/a", "m/a/", "m//x/c"]) == [
        "m/a/b", "m/a/b", None, None, "m//x"
    ]
    base = apply(make, lambda k: paths.folder_base_name(k, 2), [
        "m/Album", "m/Album [123] [2020]", "m/Album [999]", "m/Album [2020]", "m/Album [x]",
        "m/[12]",
    ])
    assert base == ["m/Album", "m/Album", "m/Album", "m/Album", "m/Album [x]", "m/"]
    assert apply(make, lambda k: paths.folder_base_name(k, 1), ["Al [1]", "Al"]) == ["/Al", "Al"]
    with pytest.raises(ValueError):
        paths.folder_at(F.col("t"), 0)


def test_ancestors_and_depth(make):
    assert apply(make, paths.ancestors, ["a/b/c.x", "a", "/a", "a//b"]) == [
        ["a", "a/b"], [], [""], ["a", "a/"]
    ]
    assert apply(make, paths.folder_depth, ["a", "a/b", ""]) == [0, 1, 0]


def test_multipart_etag(make):
    values = ['"d41d8cd98f00b204e9800998ecf8427e"', '"d41d8cd98f00b204e9800998ecf8427e-3"',
              "abc123-5", '"my-file-name"', "-5", "a-"]
    assert apply(make, text.is_multipart_etag, values) == [False, True, True, False, True, False]


def test_normalize_name(make):
    cases = {
        "d/Photo été (1).jpg": "photo ete.jpg", " photo .jpg": "photo.jpg",
        "photo  été  2024.jpg": "photo ete 2024.jpg", "photo - Copie.jpg": "photo.jpg",
        "photo - COPY.jpg": "photo.jpg", "photo_copy.jpg": "photo.jpg", "photo_1.JPG": "photo.jpg",
        "README": "readme", "a - Copie (1).txt": "a.txt", "a (1) - Copie.txt": "a (1).txt",
        "ﬁn².txt": "fin2.txt", "한글.txt": unicodedata.normalize("NFKD", "한글") + ".txt",
        "d/": "", "x 　y.txt": "x y.txt", "½.txt": "1⁄2.txt",
    }
    assert apply(make, names.normalize_name, list(cases)) == list(cases.values())
    stepped = names.with_normalized_name(make.texts(*cases), "t", "out").collect()
    assert {r.t: r.out for r in stepped} == cases


def test_accents_agree_with_unicode(make):
    rng = random.Random(3)
    points = [p for p in range(0x20, 0x30000) if unicodedata.category(chr(p)) not in ("Cs", "Cn")]
    values = sorted({"".join(map(chr, rng.choices(points, k=4))) for _ in range(4000)})
    values += [chr(p) for p in range(0xA0, 0x600)]
    got = apply(make, names.strip_accents, values)
    wrong = [(v, g) for v, g in zip(values, got, strict=True) if g != names.plain_form(v)]
    # Two spacing marks in a row may keep their order; nothing else may differ.
    assert all(sorted(g) == sorted(names.plain_form(v)) for v, g in wrong)
    assert len(wrong) <= 2


def test_name_quality_score(make):
    cases = {"photo.jpg": 0, "photo Ã©tÃ©.jpg": 10, "photo (1).jpg": 5, " photo.jpg": 2,
             "pho  to.jpg": 1, "x/ a  b (1).jpg": 8, "photo Ã t.jpg": 10, "photo_3.jpg": 5,
             "photo Copie.jpg": 0, "photo COPY.jpg": 5}
    assert apply(make, names.name_quality_score, list(cases)) == list(cases.values())


def test_strip_spaces_rule(make):
    values = random_texts(1500, "ab /  \x1c") + [" dir / photo.jpg ", "dir/ /photo.jpg"]
    expected = ["/".join(filter(None, (s.strip() for s in v.split("/")))) for v in values]
    assert apply(make, rules.strip_spaces, values) == expected


def test_strip_backslashes_rule(make):
    values = random_texts(800, "a\\ /b") + ["a\\b.txt", "Miracle \\\\ Miss"]
    expected = [
        re.sub(" {2,}", " ", v.replace("\\", "")) if "\\" in v else v for v in values
    ]
    assert apply(make, rules.strip_backslashes, values) == expected


def test_unknown_rule():
    with pytest.raises(ValueError, match="strip-backslashes"):
        rules.rules_named(["strip-spaces", "nope"])


def test_human_size(spark):
    cases = {0: "0.0 o", 500: "500.0 o", 1023: "1023.0 o", 1024: "1.0 Ko", 2048: "2.0 Ko",
             1280: "1.2 Ko", 1408: "1.4 Ko", 5 * 1024**2: "5.0 Mo", 3 * 1024**3: "3.0 Go",
             9 * 1024**4: "9.0 To", 2 * 1024**5: "2.0 Po", 3000 * 1024**5: "3000.0 Po",
             -2048: "-2.0 Ko"}
    rng = random.Random(5)
    for _ in range(800):
        size = rng.randrange(1024 ** rng.randint(1, 5))
        scaled, unit = float(size), 0
        while scaled >= 1024:
            scaled, unit = scaled / 1024, unit + 1
        cases[size] = f"{scaled:.1f} {('o', 'Ko', 'Mo', 'Go', 'To', 'Po')[unit]}"
    df = spark.createDataFrame([(s,) for s in cases], "s long")
    got = {r.s: r.h for r in df.select("s", text.human_size(F.col("s")).alias("h")).collect()}
    assert got == cases


def test_small_texts(spark):
    row = spark.range(1).select(
        text.shell_quote(F.lit("it's")).alias("q"),
        text.codec_label(F.lit("")).alias("c"),
        text.codec_label(F.lit(None).cast("string"), "").alias("n"),
        text.work_label(F.lit("A"), F.lit("S")).alias("w"),
        text.first_tag(F.array().cast("array<string>"), F.array(F.lit("x"))).alias("t"),
        text.iso_time(F.lit("2024-01-01 10:00:00.5").cast("timestamp_ntz")).alias("i"),
        text.iso_time(F.lit("2024-01-01 10:00:00").cast("timestamp_ntz")).alias("j"),
        text.whole_units(F.lit(5 * 1024 * 1024 - 1), 2).alias("u"),
    ).first()
    assert tuple(row) == ("'it'\\''s'", "?", "", "A - S", "x", "2024-01-01T10:00:00.500000",
                          "2024-01-01T10:00:00", 4)
