"""Secrets in texts: three patterns, and a battery of randomness tests; SQL functions only.

Base patterns find assignments, access keys and hexadecimal runs. Beyond them, each long token is
tested for being a uniform random string over the alphabet of its inferred encoding: a chi-squared test
of its letter counts, a runs test (upper and lower half of the alphabet) and lag-one serial correlation,
joined by Fisher's rule into one p-value. Random tokens have uniform p-values, other tokens small ones.
Over the whole corpus, and for each alphabet and class of lengths on its own, the p-values above one
half tell how many tokens are random; the cut is the lowest p at which tokens that are not random are
estimated to be at most ``RATE`` of those accepted. Classes with few tokens lean on their alphabet and on all tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds and patterns of the base scan, in the order of ties.
KINDS = ("assign", "access", "hex")
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN_PATTERN = rf"""(?i:{"|".join(KEYWORDS)})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LETTERS = 12
ACCESS_PATTERN = "AKIA[A-Z0-9]{14,}"
HEX_PATTERN = "[0-9a-f]{16,}"

TOKEN_PATTERN = "[A-Za-z0-9+/_-]{20,}"
RATE = 0.05
_LONGER = (28, 40, 64)  # length classes begin at 20 and here
_BINS = 100
# Tokens that a class borrows from its alphabet, and an alphabet from all.
_SHRINK = 200

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Pattern of the whole token, and its alphabet in order; the first that fits is inferred.
ENCODINGS = (
    ("[0-9a-f]+", _DIGITS + "abcdef"),
    ("[0-9A-F]+", _DIGITS + "ABCDEF"),
    ("[A-Z2-7]+", _UPPER + "234567"),
    ("[0-9a-z]+", _DIGITS + _LOWER),
    ("[0-9A-Z]+", _DIGITS + _UPPER),
    ("[0-9A-Za-z]+", _DIGITS + _UPPER + _LOWER),
    ("[0-9A-Za-z+/]+", _UPPER + _LOWER + _DIGITS + "+/"),
    ("[0-9A-Za-z_-]+", _UPPER + _LOWER + _DIGITS + "-_"),
)

# Abramowitz and Stegun 26.2.17, the normal tail.
_TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
_TAIL_STEP = 0.2316419


_NO_SPANS = "array<struct<start:int,end:int,byte:int,token:string,value:string>>"
_WIDTHS = [2**i for i in range(31)]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once wherever it stands."""
    return F.transform(F.array(value), use)[0]


def _running(values: Column, n: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running ``join`` of an array of ``n`` values from its front. Each step doubles what a place has taken in, so the work is
    n log n, and no array grows value by value; ``join`` gets null before the front."""
    return F.aggregate(
        F.filter(F.array(*map(F.lit, _WIDTHS)), lambda width: width < n), values,
        lambda done, width: F.transform(done, lambda x, i: join(x, F.get(done, i - width))),
    )


def _sums(values: Column, n: Column) -> Column:
    return _running(values, n, lambda x, earlier: x + F.coalesce(earlier, F.lit(0)))


def _located(text: Column, found: Column, pattern: str, group: int = 0) -> Column:
    """Spans (start, end, byte, token, value) of the matches ``found``: code points, the byte where it starts, and the group's
    text. Matches are ASCII. Texts without a match, nearly all, are searched no further."""
    n = F.size(found)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found

    def spans(gaps: Column) -> Column:
        lengths = lambda measure: F.zip_with(gaps, found, lambda gap, token: measure(gap) + F.char_length(token))
        zipped = F.arrays_zip(
            _sums(lengths(F.char_length), n).alias("end"), _sums(lengths(F.octet_length), n).alias("last"),
            found.alias("token"), values.alias("value"),
        )
        return F.transform(zipped, lambda x: F.struct(
            (x["end"] - F.char_length(x["token"])).alias("start"), x["end"].alias("end"),
            (x["last"] - F.char_length(x["token"])).alias("byte"), x["token"].alias("token"), x["value"].alias("value"),
        ))

    return F.when(n > 0, _let(F.slice(F.split(text, pattern, -1), 1, n), spans)).otherwise(F.array().cast(_NO_SPANS))


def _tail(z: Column) -> Column:
    """The chance of a normal value above z."""
    a = F.abs(z)
    t = 1 / (1 + F.lit(_TAIL_STEP) * a)
    poly = F.lit(0.0)
    for c in reversed(_TAIL):
        poly = (poly + c) * t
    upper = F.exp(-a * a / 2) * F.lit(0.3989422804014327) * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _alphabet(token: Column) -> Column:
    """The alphabet of the inferred encoding; null for words (letters only) and numbers."""
    chosen = F.when(token.rlike("^([A-Za-z]+|[0-9]+)$"), F.lit(None).cast("string"))
    for pattern, letters in ENCODINGS:
        chosen = chosen.when(token.rlike(f"^{pattern}$"), F.lit(letters))
    return chosen


def _length_class(n: Column) -> Column:
    return sum(((n >= at).cast("int") for at in _LONGER), F.lit(0))


def _battery(tokens: Column) -> Column:
    """For tokens (start, end, byte, token): start, end, byte, alphabet size k, length class and joint p-value under a uniform random
    source; tokens without an encoding are left out.

    Each step names what the next one uses, so that the plan stays small; a token goes through all of them before the next one.
    """
    place = lambda s: (s["start"].alias("start"), s["end"].alias("end"), s["byte"].alias("byte"))
    sized = lambda s: (*place(s), s["k"].alias("k"), s["n"].alias("n"))
    log = lambda p: F.ln(F.greatest(p, F.lit(1e-300)))

    def indexed(s: Column) -> Column:
        return F.struct(
            *place(s), F.char_length(s["letters"]).cast("double").alias("k"), F.char_length(s["token"]).cast("double").alias("n"),
            F.transform(F.split(s["token"], ""), lambda c: F.instr(s["letters"], c) - 1).alias("x"),
        )

    def paired(s: Column) -> Column:
        earlier, later = F.slice(s["x"], 1, F.size(s["x"]) - 1), F.slice(s["x"], 2, F.size(s["x"]) - 1)
        return F.struct(*sized(s), s["x"].alias("x"), F.arrays_zip(earlier.alias("a"), later.alias("b")).alias("pairs"))

    def counted(s: Column) -> Column:
        return F.struct(
            *sized(s),
            F.aggregate(
                F.array_distinct(s["x"]), F.lit(0.0),
                lambda total, v: total + F.pow(F.size(F.filter(s["x"], lambda y: y == v)).cast("double"), F.lit(2.0)),
            ).alias("squares"),
            F.size(F.filter(s["pairs"], lambda p: (p["a"] * 2 >= s["k"]) != (p["b"] * 2 >= s["k"]))).alias("turns"),
            F.aggregate(s["pairs"], F.lit(0.0), lambda t, p: t + (p["a"] - (s["k"] - 1) / 2) * (p["b"] - (s["k"] - 1) / 2)).alias("product"),
        )

    def normal(s: Column) -> Column:
        # Wilson and Hilferty: the cube root of chi-squared is nearly normal.
        ratio = (s["squares"] * s["k"] / s["n"] - s["n"]) / (s["k"] - 1)
        return F.struct(
            *sized(s),
            ((F.pow(ratio, F.lit(1 / 3)) - (1 - 2 / (9 * (s["k"] - 1)))) / F.sqrt(2 / (9 * (s["k"] - 1)))).alias("chi"),
            F.abs((s["turns"] - (s["n"] - 1) / 2) / F.sqrt((s["n"] - 1) / 4)).alias("runs"),
            F.abs(s["product"] / ((s["k"] * s["k"] - 1) / 12 * F.sqrt(s["n"] - 1))).alias("serial"),
        )

    def halved(s: Column) -> Column:
        # Fisher: minus twice the sum of logarithms is chi-squared with six degrees of freedom.
        return F.struct(
            *place(s), s["k"].cast("int").alias("k"), _length_class(s["n"]).alias("longer"),
            (-(log(_tail(s["chi"])) + log(2 * _tail(s["runs"])) + log(2 * _tail(s["serial"])))).alias("half"),
        )

    def joint(s: Column) -> Column:
        return F.struct(
            *place(s), s["k"].alias("k"), s["longer"].alias("longer"),
            (F.exp(-s["half"]) * (1 + s["half"] + s["half"] * s["half"] / 2)).alias("p"),
        )

    def through(s: Column, steps: Sequence[Callable[[Column], Column]]) -> Column:
        return _let(steps[0](s), lambda t: through(t, steps[1:])) if len(steps) > 1 else steps[0](s)

    encoded = F.filter(
        F.transform(tokens, lambda s: F.struct(*place(s), s["token"].alias("token"), _alphabet(s["token"]).alias("letters"))),
        lambda s: s["letters"].isNotNull(),
    )
    return F.transform(encoded, lambda s: through(s, (indexed, paired, counted, normal, halved, joint)))


def _tested(docs: DataFrame) -> DataFrame:
    """(k, longer, p) of every token with an encoding."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tokens = docs.select(F.explode(F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))).alias("token"))
    one = F.array(F.struct(*[F.lit(0).alias(c) for c in ("start", "end", "byte")], F.col("token")))
    return tokens.select(F.explode(_battery(one)).alias("t")).select("t.k", "t.longer", "t.p")


def cuts(docs: DataFrame, rate: float = RATE) -> dict[tuple[int, int], float]:
    """The least accepted p for each (alphabet size, length class) that occurs; one pass over the whole corpus.

    Counts in ``_BINS`` bins of p are all that leaves the tasks: at most 100 rows per class.
    """
    bins = (
        _tested(docs)
        .groupBy("k", "longer", F.least(F.floor(F.col("p") * _BINS), F.lit(_BINS - 1)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counts: dict[tuple[int, int], np.ndarray] = {}
    for r in bins.collect():
        counts.setdefault((r.k, r.longer), np.zeros(_BINS))[r.bin] = r.n
    return class_cuts(counts, rate)


def class_cuts(counts: dict[tuple[int, int], np.ndarray], rate: float = RATE) -> dict[tuple[int, int], float]:
    """The cut of each class from its counts by bin of p.

    Each class is joined by ``_SHRINK`` tokens spread like the others of its alphabet, these by as many spread like
    the tokens of other alphabets, and these by as many of which half are random. So few tokens are judged by what
    is known of others, and many by themselves. Every bin edge from 0 to one half is tried, whether tokens lie there or not.
    """
    def shrunk(own: list[np.ndarray], wider: np.ndarray) -> np.ndarray:
        return sum(own, _SHRINK * wider / wider.sum())

    start = np.full(_BINS, 0.5 / _BINS)
    start[0] += 0.5
    edges = np.arange(_BINS // 2 + 1)
    out = {}
    for k, longer in counts:
        elsewhere = shrunk([n for c, n in counts.items() if c[0] != k], start)
        alphabet = shrunk([n for c, n in counts.items() if c[0] == k and c[1] != longer], elsewhere)
        n = shrunk([counts[k, longer]], alphabet)
        above = np.cumsum(n[::-1])[::-1][edges]
        wrong = 1 - 2 * n[_BINS // 2:].sum() * (1 - edges / _BINS) / above
        out[k, longer] = float(edges[wrong <= rate + 1e-9].min() / _BINS)
    return out


def _with_spans(docs: DataFrame, cut: dict[tuple[int, int], float], name: str) -> DataFrame:
    """``docs`` with column ``name``: all spans (start, rank, end, byte, kind) by start, then kind; code points, end exclusive, and the
    byte where the span starts. The time for a text grows as its length and n log n of its n matches.

    A random token that overlaps a base span is not added.
    """
    # Columns for the steps, with names that no column of ``docs`` has: expressions used twice are not repeated in the plan.
    tag = "_step"
    while any(c.startswith(tag) for c in docs.columns):
        tag += "_"
    columns = [F.col(f"`{c}`") for c in docs.columns if c != name]
    patterns = {KINDS[0]: ASSIGN_PATTERN, KINDS[1]: ACCESS_PATTERN, KINDS[2]: HEX_PATTERN, "random": TOKEN_PATTERN}
    kinds = [k for k in patterns if k != "random" or cut]
    text = F.col(f"{tag}text")
    # After a fold to one column per step the JVM keeps each search apart.
    step = docs.select(*columns, F.coalesce(F.col("text").cast("string"), F.lit("")).alias(f"{tag}text"))
    step = step.select("*", *[F.regexp_extract_all(text, F.lit(patterns[k]), F.lit(0)).alias(f"{tag}{k}") for k in kinds])
    step = step.select(
        *columns, *[_located(text, F.col(f"{tag}{k}"), patterns[k], int(k == KINDS[0])).alias(f"{tag}{k}") for k in kinds]
    )
    order = {kind: i for i, kind in enumerate(patterns)}

    def ranked(spans: Column, kind: str) -> Column:
        return F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.lit(order[kind]).alias("rank"), s["end"].alias("end"), s["byte"].alias("byte"), F.lit(kind).alias("kind")
        ))

    assigned = F.filter(F.col(f"{tag}{KINDS[0]}"), lambda s: F.char_length(s["value"]) >= ASSIGN_LETTERS)
    base = F.concat(ranked(assigned, KINDS[0]), *[ranked(F.col(f"{tag}{k}"), k) for k in KINDS[1:]])
    step = step.select(*columns, *[F.col(f"{tag}random")] * bool(cut), F.array_sort(base).alias(f"{tag}base"))
    spans = F.col(f"{tag}base")
    if cut:
        limit = F.create_map(*[F.lit(x) for (k, c), p in sorted(cut.items()) for x in (k * 10 + c, p)])
        step = step.select(*columns, spans, _apart(F.col(f"{tag}random"), spans).alias(f"{tag}alone"))
        random = F.filter(
            _battery(F.col(f"{tag}alone")), lambda s: s["p"] >= F.coalesce(limit[s["k"] * 10 + s["longer"]], F.lit(2.0))
        )
        spans = F.when(F.size(f"{tag}alone") > 0, F.array_sort(F.concat(spans, ranked(random, "random")))).otherwise(spans)
    return step.select(*columns, spans.alias(name))


def _apart(tokens: Column, base: Column) -> Column:
    """The ``tokens`` that overlap no span of ``base``; both in order of start. One sorted list of both tells each token how far the spans
    before it reach and where the next one starts."""
    side = lambda of, own: F.transform(of, lambda s: F.struct(
        s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), s["byte"].alias("byte"),
        (s["token"] if own else F.lit(None).cast("string")).alias("token"),
    ))

    def alone(both: Column) -> Column:
        n = F.size(both)
        reach = _running(F.transform(both, lambda s: F.when(s["own"] == 0, s["end"])), n, F.greatest)
        following = F.reverse(_running(F.reverse(F.transform(both, lambda s: F.when(s["own"] == 0, s["start"]))), n, F.least))
        zipped = F.arrays_zip(both.alias("s"), reach.alias("reach"), following.alias("next"))
        kept = F.filter(zipped, lambda x: (
            (x["s"]["own"] == 1) & (F.coalesce(x["reach"], F.lit(0)) <= x["s"]["start"]) & (F.coalesce(x["next"], x["s"]["end"]) >= x["s"]["end"])
        ))
        return F.transform(kept, lambda x: F.struct(*[x["s"][c].alias(c) for c in ("start", "end", "byte", "token")]))

    plain = F.transform(tokens, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "end", "byte", "token")]))
    mixed = _let(F.array_sort(F.concat(side(base, 0), side(tokens, 1))), alone)
    return F.when((F.size(tokens) > 0) & (F.size(base) > 0), mixed).otherwise(plain)


def find_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """``docs`` with ``spans``: array<struct<start, end, kind>>, kinds as listed and ``random``.

    A null text counts as empty and has no spans, as any text without a match. Repeated rows get equal
    spans; an empty table stays empty. A column named ``spans`` is replaced.
    """
    found = _with_spans(docs, cuts(docs, rate), "spans")
    return found.withColumn("spans", F.transform("spans", lambda s: F.struct(*[s[c].alias(c) for c in ("start", "end", "kind")])))


def redact(docs: DataFrame, mark: str = "[secret]", rate: float = RATE) -> DataFrame:
    """``docs``, all rows and columns, with each secret replaced by ``mark``; ``n_chars`` follows the text."""
    name = "_spans"
    while any(c.startswith(name) for c in docs.columns):
        name += "_"
    changed = f"{name}hit"
    found = _with_spans(docs, cuts(docs, rate), name)
    text, n = F.col("text"), F.size(name)
    rest = F.lit(2**31 - 1)

    def cleaned(held: Column) -> Column:
        """The text between the spans, ``mark`` in place of each run of overlapping ones; cut by bytes, which needs no search."""
        data, reach = held["data"], held["reach"]
        between = lambda at, length: F.substring(data, at + 1, length).cast("string")

        def piece(s: Column, i: Column) -> Column:
            before = F.coalesce(F.get(reach, i - 1), F.lit(0))
            return F.when(s["byte"] >= before, F.concat(between(before, s["byte"] - before), F.lit(mark))).otherwise("")

        return F.concat(F.array_join(F.transform(F.col(name), piece), ""), between(F.get(reach, n - 1), rest))

    ends = F.transform(F.col(name), lambda s: s["byte"] + s["end"] - s["start"])
    held = F.struct(text.cast("string").cast("binary").alias("data"), _running(ends, n, F.greatest).alias("reach"))
    hit = F.size(name) > 0
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_chars")]
    counted = [F.col("n_chars"), hit.alias(changed)] if "n_chars" in docs.columns else []
    out = found.select(*others, *counted, F.when(hit, _let(held, cleaned)).otherwise(text).alias("text"))
    if counted:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(changed), F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
