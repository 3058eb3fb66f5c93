"""Small tables with everything that tends to break operators, and plain-Python references."""

import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, k bigint, t string, n_words string, base string, tested int, shard string"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
LONG = "Alpha beta gamma delta epsilon zeta eta theta iota kappa. " * 400
TEXTS = [
    None, "", " ", "!!! ??? 123", "one", "One two three four", "Un café déjà vu, naïve façade Straße", "日本語のテキスト です 🙂 end", LONG, LONG, LONG + "tail", LONG.upper(),
    "x" * 5000, "ab" * 300, "\x00\x1c weird\x85 control chars\u200b", "same text here and more words to fill it", "same text here and more words to fill it", "line\r\nbreak\ttab <|endoftext|> <| |> <\\| end",
]


def odd_rows():
    """Ids out of order, with a gap, repeated and null ones, rows that repeat as a whole; nulls in every column."""
    rows = [(2 * i + 5, t) for i, t in enumerate(TEXTS)]
    rows += [(7, "another text under a known id"), rows[8], rows[8], (None, "text without an id"), (None, None), (-3, "negative id")]
    full = [(k, t, "en" if i % 3 else None, f"s{i}" if i % 2 else None, len(t or "") if i % 4 else None, 0.5, 1, "clash", "clash", "clash", 3, "clash") for i, (k, t) in enumerate(rows)]
    return full[::-1]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall((text or "").encode("utf-8").translate(LOWER))


def shingles(text, n=5):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()
