"""Secret scans with DataFrame and SQL functions only.

Base rules find credentials by their form. A randomness test battery adds spans. Every long token gets an inferred
encoding, and three tests of the hypothesis "its symbols are drawn at random from that alphabet": chi-squared uniformity,
runs about the middle, and serial correlation of the four quarters of the alphabet. A token that the battery rejects is
not random. What it leaves is a discovery only against the other hypothesis, "it is ordinary text": its symbols are drawn
like those of all the texts of the corpus. The p-value of that is the chance that ordinary symbols stay inside the
token's alphabet and coincide as rarely as the token's do. A Benjamini-Hochberg threshold for each length class, over all
tested tokens of the corpus, bounds the share of ordinary tokens among those that are reported.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import materialize

#: The base rules, in the order in which equal starts are listed, with the least length of a match.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run that is too short fails wherever in it a match starts, so these two may ask for the length themselves.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LEAST_ASSIGN = 8
KINDS = ["assign", "access", "hex", "random"]
#: Tokens that are tested: of at least so many symbols, not only digits.
TOKEN_CHARS = 20
TOKEN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{TOKEN_CHARS},}}={{0,2}}"
RULES = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "random": TOKEN}
#: Every match of a rule holds one of these in lower case: texts without any are not matched.
NEEDED = {"assign": ["passw", "secret", "token", "api"], "access": ["akia"]}
#: Alphabets of the encodings, tried in this order; a token's own is the first that holds all its symbols.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = [
    ("hex", DIGITS + "abcdef"), ("upper hex", DIGITS + "ABCDEF"), ("lower", LOWER), ("upper", UPPER), ("base32", UPPER + "234567"),
    ("base36", DIGITS + LOWER), ("upper base36", DIGITS + UPPER), ("letters", UPPER + LOWER), ("base62", UPPER + LOWER + DIGITS),
    ("base64", UPPER + LOWER + DIGITS + "+/"), ("base64url", UPPER + LOWER + DIGITS + "-_"), ("mixed", UPPER + LOWER + DIGITS + "+/-_"),
]
SYMBOLS = ALPHABETS[-1][1]
#: Share of ordinary tokens among those reported; level of the battery; p-values are kept to 1 / BINS of a decade.
FDR, LEVEL = 0.05, 0.001
BINS, MOST_BIN = 8, 2400


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Results of ``step`` over all values before each one. n values take n^1.5 time: they are taken in blocks."""
    n = F.size(values)
    wide = F.ceil(F.sqrt(n)).cast("int")
    fold = lambda xs: F.aggregate(xs, zero, step)

    def within(block: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.slice(F.array(first), 1, 0).alias("out"))
        following = lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(block, start, following, lambda acc: acc["out"])

    cut = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / wide).cast("int")), lambda i: F.slice(values, i * wide + 1, wide))
    whole = lambda made: let(F.transform(made, fold), lambda t: F.flatten(F.zip_with(made, F.transform(F.sequence(F.lit(0), F.size(t) - 1), lambda i: fold(F.slice(t, F.lit(1), i))), within)))
    return F.when(n > 0, let(cut, whole)).otherwise(F.slice(F.array(zero), 1, 0))


MATCHES = "array<struct<s: int, r: int, e: int, m: string>>"


def placed(text: Column, kind: str) -> Column:
    """Matches of a rule: start and end (code points), rank of the kind, and the match itself."""
    rule, rank = RULES[kind], KINDS.index(kind)

    def sized(found: Column) -> Column:
        return F.zip_with(found, F.slice(F.split(text, rule, -1), 1, F.size(found)), lambda m, b: F.struct(F.length(b).alias("b"), F.length(m).alias("n"), m.alias("m")))

    def starts(xs: Column) -> Column:
        before = running(F.transform(xs, lambda x: x["b"] + x["n"]), F.lit(0), lambda a, b: a + b)
        return F.zip_with(xs, before, lambda x, at: F.struct((at + x["b"]).alias("s"), F.lit(rank).alias("r"), (at + x["b"] + x["n"]).alias("e"), x["m"].alias("m")))

    none = F.array().cast(MATCHES)
    found = let(F.regexp_extract_all(text, F.lit(rule), F.lit(0)), lambda f: F.when(F.size(f) > 0, let(sized(f), starts)).otherwise(none))
    if kind not in NEEDED:
        return found
    maybe = let(F.lower(text), lambda low: F.coalesce(*[F.when(F.contains(low, F.lit(w)), F.lit(True)) for w in NEEDED[kind]], F.lit(False)))
    return F.when(maybe, found).otherwise(none)


def _let(name: str, value: str, body: str) -> str:
    """SQL text of ``let``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _lower_tail(z: str) -> str:
    """SQL text: chance of a standard normal deviate below z, by a rational approximation of the complementary error
    function."""
    series = "((((1.061405429D * t - 1.453152027D) * t + 1.421413741D) * t - 0.284496736D) * t + 0.254829592D) * t"
    tail = _let("t", "1D / (1D + 0.3275911D * h)", f"greatest(({series}) * exp(-h * h) / 2D, 1e-300D)")
    return _let("w", z, _let("h", f"abs(w) / {math.sqrt(2)!r}D", _let("p", tail, "if(w <= 0, p, 1D - p)")))


def quarters(alphabet: str) -> str:
    """Quarter of the alphabet, 0 to 3, of each of its symbols."""
    return "".join(str(4 * i // len(alphabet)) for i in range(len(alphabet)))


def _facts(alphabet: str, ordinary: dict[str, float]) -> str:
    """SQL text of a struct: the alphabet, its quarters and their sizes, and what ordinary text does inside it (share of
    symbols as a logarithm, sums of their squares and cubes)."""
    shares = [ordinary[c] for c in alphabet]
    mass = sum(shares)
    sizes = [quarters(alphabet).count(str(g)) / len(alphabet) for g in range(4)]
    mean = sum(g * x for g, x in enumerate(sizes))
    power = sum(x * (g - mean) ** 2 for g, x in enumerate(sizes))
    numbers = {"mass": math.log10(mass), "squares": sum((x / mass) ** 2 for x in shares), "cubes": sum((x / mass) ** 3 for x in shares), "mean": mean, "power": power, "both": (sizes[2] + sizes[3]) * (sizes[0] + sizes[1])}
    return f"named_struct('a', '{alphabet}', 'q', '{quarters(alphabet)}', " + ", ".join(f"'{k}', {float(v)!r}D" for k, v in numbers.items()) + ")"


def tested(token: str, ordinary: dict[str, float]) -> str:
    """SQL text of a struct for a token. b: bin of the p-value of "ordinary text"; ok: whether the battery takes the token
    for random. ``ordinary``: share of each symbol in ordinary text. It works on counts of symbols and of neighbours (by
    what is left without them), so a token of any length takes memory in proportion to it."""
    alphabet = "coalesce(" + ", ".join(f"if(translate(t, '{a}', '') = '', {_facts(a, ordinary)}, null)" for _, a in ALPHABETS) + ")"
    pairs = "aggregate(sequence(1, length(x.a)), 0D, (s, i) -> s + " + _let("c", "cast(length(t) - length(replace(t, substring(x.a, i, 1), '')) as double)", "c * (c - 1D)") + ")"
    order = [(g, h) for g in range(4) for h in range(4) if g != h]
    places = ", ".join(f"cast(length(v) - length(replace(v, '{g}', '')) - if(right(v, 1) = '{g}', 1, 0) as double)" for g in range(4))
    steps = ", ".join(f"(length(v) - length(replace(v, '{g}{h}', ''))) / 2D" for g, h in order)
    coded = _let("v", "translate(t, x.a, x.q)", f"named_struct('starts', array({places}), 'steps', array({steps}))")
    n, at = "cast(length(t) as double)", {gh: f"c.steps[{i}]" for i, gh in enumerate(order)}
    for g in range(4):  # of equal neighbours: all but the last symbol start a pair
        at[g, g] = f"(c.starts[{g}] - " + " - ".join(at[g, h] for h in range(4) if h != g) + ")"
    changes = " + ".join(at[g, h] for g, h in order if (g < 2) != (h < 2))
    serial = " + ".join(f"{v} * ({g} - x.mean) * ({h} - x.mean)" for (g, h), v in at.items())
    made = f"named_struct('n', {n}, 'k', cast(length(x.a) as double), 'pairs', {pairs}, 'changes', {changes}, 'serial', ({serial}) / (x.power * sqrt({n} - 1D)))"
    chi = "(power(greatest(y.k / y.n * (y.pairs + y.n) - y.n, 0D) / (y.k - 1D), 1D / 3D) - (1D - 2D / (9D * (y.k - 1D)))) / sqrt(2D / (9D * (y.k - 1D)))"
    runs = "(y.changes - (y.n - 1D) * 2D * x.both) / sqrt((y.n - 1D) * 2D * x.both * (1D - 2D * x.both) + 2D * (y.n - 2D) * x.both * (1D - 4D * x.both))"
    battery = f"3D * 2D * array_min(transform(array({chi}, {runs}, y.serial), z -> {_lower_tail('-abs(z)')}))"
    spread = "4D * y.n * (y.n - 1D) * (y.n - 2D) * (x.cubes - x.squares * x.squares) + 2D * y.n * (y.n - 1D) * (x.squares - x.squares * x.squares)"
    rare = _lower_tail(f"(y.pairs + 1D - y.n * (y.n - 1D) * x.squares) / sqrt(greatest({spread}, 1e-9D))")
    log_p = f"{math.log10(len(ALPHABETS))!r}D + y.n * x.mass + log10({rare})"
    verdict = f"named_struct('b', least({MOST_BIN}, greatest(0, cast(floor(-({log_p}) * {BINS}) as int))), 'ok', {battery} >= {LEVEL}D)"
    return _let("t", f"rtrim('=', {token})", _let("x", alphabet, _let("c", coded, _let("y", made, verdict))))


#: Symbols in the order in which they are counted: white space and frequent letters first, as what is counted is taken out.
COUNTED = " \netaoinsrhldcumfpgwybvkxjqz" + UPPER + DIGITS + "+/-_"


def _symbols(text: Column) -> Column:
    """How often the text holds each symbol of COUNTED."""
    start = F.struct(text.alias("rest"), F.array().cast("array<bigint>").alias("n"))
    step = lambda acc, c: let(F.replace(acc["rest"], c, F.lit("")), lambda r: F.struct(r.alias("rest"), F.concat(acc["n"], F.array((F.octet_length(acc["rest"]) - F.octet_length(r)).cast("bigint"))).alias("n")))
    return F.aggregate(F.array(*[F.lit(c) for c in COUNTED]), start, step, lambda acc: acc["n"])


def ordinary_symbols(texts: DataFrame, found: DataFrame) -> dict[str, float]:
    """Share of each symbol among the symbols of all whole texts (t) outside of the tokens ``found`` (an array with m each);
    one more of each is counted, so none is zero."""
    tokens = found.select(F.explode("found").alias("x")).select(_symbols(F.col("x.m")).alias("n"), F.lit(-1).alias("sign"))
    everything = texts.select(_symbols(F.coalesce("t", F.lit(""))).alias("n"), F.lit(1).alias("sign")).unionByName(tokens)
    # an outer explode, as Spark would compute the counts once more to leave out empty ones
    rows = everything.select("sign", F.posexplode_outer("n").alias("i", "n")).groupBy("i").agg(F.sum(F.col("sign") * F.col("n")).alias("n")).collect()
    counted = {COUNTED[r.i]: r.n for r in rows if r.i is not None}
    total = sum(counted.get(c, 0) + 1 for c in SYMBOLS)
    return {c: (counted.get(c, 0) + 1) / total for c in SYMBOLS}


def _fresh(tokens: Column, base: Column) -> Column:
    """Tokens that overlap no base span, from the furthest end before each and the nearest start after it."""
    far = F.lit(-(2**31) + 1)

    def apart(all_: Column) -> Column:
        past = running(F.transform(all_, lambda x: F.when(x["r"] < 3, x["e"]).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
        ahead = running(F.transform(F.reverse(all_), lambda x: F.when(x["r"] < 3, -x["s"]).otherwise(far)), far, lambda a, b: F.greatest(a, b))
        with_past = F.zip_with(all_, past, lambda x, p: F.struct(x.alias("x"), p.alias("p")))
        both = F.zip_with(with_past, F.reverse(ahead), lambda y, a: F.struct(y["x"].alias("x"), ((y["x"]["r"] == 3) & (y["p"] <= y["x"]["s"]) & (-a >= y["x"]["e"])).alias("free")))
        return F.transform(F.filter(both, lambda y: y["free"]), lambda y: y["x"])

    return F.when((F.size(tokens) == 0) | (F.size(base) == 0), tokens).otherwise(let(F.array_sort(F.concat(base, tokens)), apart))


def scan_columns(docs: DataFrame, text: str, base: str, found: str) -> DataFrame:
    """Adds ``base`` (base spans: s, r, e) and ``found`` (tokens outside of them: s, e, m)."""
    t = F.coalesce(F.col(text), F.lit(""))
    assign = F.filter(placed(t, "assign"), lambda x: F.length(F.regexp_extract(x["m"], f"^{ASSIGN}$", 2)) >= LEAST_ASSIGN)
    tokens = F.filter(placed(t, "random"), lambda x: F.translate(F.rtrim(x["m"], F.lit("=")), DIGITS, "") != "")
    staged = docs.withColumn(base, F.array_sort(F.concat(assign, placed(t, "access"), placed(t, "hex")))).withColumn(found, tokens)
    spans = F.transform(base, lambda x: F.struct(x["s"].alias("s"), x["r"].alias("r"), x["e"].alias("e")))
    narrow = F.transform(_fresh(F.col(found), F.col(base)), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))
    return staged.withColumn(found, narrow).withColumn(base, spans)


def judged(found: str, ordinary: dict[str, float]) -> Column:
    """s, e, c (length class), b and ok of each token of an array (s, e, m)."""
    verdict = f"named_struct('s', x_.s, 'e', x_.e, 'c', cast(floor(log2(length(x_.m))) as int), 'v', {tested('x_.m', ordinary)})"
    flat = "named_struct('s', y_.s, 'e', y_.e, 'c', y_.c, 'b', y_.v.b, 'ok', y_.v.ok)"
    return F.expr(f"transform(transform({found}, x_ -> {verdict}), y_ -> {flat})")


def thresholds(found: DataFrame, column: str, fdr: float = FDR) -> dict[int, int]:
    """First bin of each length class whose tokens are told from ordinary text; reads 32 * (MOST_BIN + 1) counts at most."""
    rows = found.select(F.explode(column).alias("x")).groupBy("x.c", "x.b").count().collect()
    out: dict[int, int] = {}
    for c in {r.c for r in rows}:
        bins = sorted(((r.b, r["count"]) for r in rows if r.c == c), reverse=True)
        m, seen = sum(k for _, k in bins), 0
        out[c] = MOST_BIN + 1
        for b, k in bins:
            seen += k
            if 10 ** (-b / BINS) <= fdr * seen / m:
                out[c] = b
    return out


def _all_spans(base: str, found: str, limits: dict[int, int]) -> Column:
    """Base spans, and tested tokens that are random and not ordinary."""
    if not limits:
        return F.col(base)
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    kept = F.filter(found, lambda x: x["ok"] & (x["b"] >= F.coalesce(F.element_at(limit, x["c"]), F.lit(MOST_BIN + 1))))
    return F.array_sort(F.concat(base, F.transform(kept, lambda x: F.struct(x["s"].alias("s"), F.lit(3).alias("r"), x["e"].alias("e")))))


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, base (array of start, kind rank, end) and spans (the same with the battery's) of every row.

    Starts and ends count code points, ends are exclusive. Null and empty texts have no spans; repeated rows give
    repeated results and count repeatedly in the false-discovery control; an empty table gives no rows; other columns
    are ignored, whatever their names. The rows without their texts are written once to the shared folder, as the
    thresholds depend on all of them. A corpus whose texts hold next to no symbols has base spans only.
    """
    rows = docs.select(F.col(doc_id).alias("k"), F.col(text).alias("t"))
    scanned, _, limits = _scanned(rows, "k")
    return scanned.select(F.col("k").alias(doc_id), "base", _all_spans("base", "found", limits).alias("spans"))


def _scanned(rows: DataFrame, *keep: str) -> tuple[DataFrame, dict[str, float], dict[int, int]]:
    """base and judged tokens of all rows (t), written without their texts; ordinary symbols; thresholds."""
    first = materialize(scan_columns(rows, "t", "base", "found").select(*keep, "base", "found"), "secrets")
    ordinary = ordinary_symbols(rows, first)
    scanned = first.withColumn("found", judged("found", ordinary))
    return scanned, ordinary, thresholds(scanned, "found")


def named(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["r"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with ``mask`` in place of spans; those that overlap or touch become one. Texts are cut in blocks of pieces,
    so n spans in a text of m characters take m * n^0.5 steps."""

    def kept(xs: Column) -> Column:
        past = running(F.transform(xs, lambda x: x["e"]), F.lit(0), lambda a, b: F.greatest(a, b))
        gaps = F.zip_with(xs, past, lambda x, p: F.struct(p.alias("s"), x["s"].alias("e")))
        first = F.struct(F.lit(0).alias("s"), F.element_at(xs, 1)["s"].alias("e"))
        inner = F.filter(F.slice(gaps, F.lit(2), F.size(gaps)), lambda g: g["e"] > g["s"])
        last = F.struct(F.array_max(F.transform(xs, lambda x: x["e"])).alias("s"), F.length(text).alias("e"))
        return F.concat(F.array(first), inner, F.array(last))

    def joined(pieces: Column) -> Column:
        wide = F.ceil(F.sqrt(F.size(pieces))).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / wide).cast("int")), lambda i: F.slice(pieces, i * wide + 1, wide))
        region = lambda b: F.substring(text, b[0]["s"] + 1, F.element_at(b, -1)["e"] - b[0]["s"])
        inside = lambda b: let(region(b), lambda r: F.array_join(F.transform(b, lambda p: F.substring(r, p["s"] - b[0]["s"] + 1, p["e"] - p["s"])), mask))
        return F.array_join(F.transform(cut, inside), mask)

    return F.when(F.size(spans) > 0, let(kept(spans), joined)).otherwise(text)


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The rows with every span of their text replaced by ``mask``; overlapping and touching spans become one mask.

    Null stays null; all other columns stay as they are, whatever their names. Texts are scanned twice, for the thresholds
    and for the masks, as that moves no text between tasks.
    """
    base, found = "__secrets_base", "__secrets_found"
    _, ordinary, limits = _scanned(docs.select(F.col(text).alias("t")))
    again = scan_columns(docs, text, base, found).withColumn(found, judged(found, ordinary))
    return again.withColumn(base, _all_spans(base, found, limits)).drop(found).withColumn(text, masked(F.col(text), F.col(base), mask)).drop(base)
