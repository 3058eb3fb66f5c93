"""Chunks, sentences and evidence spans of texts. Offsets count code points."""

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNKS = "array<struct<start: int, end: int>>"
_STOP = re.compile(r"[。.\n]")
_SENTENCE = re.compile(r"[^.!?;。！？；\n]*[.!?;。！？；\n]?")


def chunk_spans(text: str, size: int, overlap: int, look: int = 100) -> list[tuple[int, int]]:
    """Spans of ``size``, moved to just after the next full stop or line break within ``look``, overlapping."""
    n, start, out = len(text), 0, []
    if n <= size:
        return [(0, n)]
    while True:
        end = start + size
        if end < n and (m := _STOP.search(text, end, min(n, end + look))):
            end = m.end()
        out.append((start, min(end, n)))
        if end >= n:
            return out
        start = max(end - overlap, start + 1)


def chunks(text: Column, size: int = 10_000, overlap: int = 200) -> Column:
    @F.pandas_udf(CHUNKS)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in chunk_spans(t or "", size, overlap)] for t in texts])

    return run(text)


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Sentences with their terminator, blank ones left out."""
    return [m.span() for m in _SENTENCE.finditer(text) if m[0].strip()]


def locate(text: str, terms: list[str], least: int, most: int, window: int = 240) -> tuple[int, int] | None:
    """The sentence with most terms (nearest to the first hit, then shortest), widened to at least ``least`` and cut to
    at most ``most`` characters; null without a hit."""
    low, wanted = text.lower(), [t.lower() for t in terms if t]
    first = min((p for t in wanted if (p := low.find(t)) >= 0), default=-1)
    if first < 0:
        return None
    near = [s for s in sentence_spans(text) if s[1] > first - window and s[0] < first + window]
    best = min(near, key=lambda s: (-sum(t in low[s[0] : s[1]] for t in wanted), abs(s[0] - first), s[1] - s[0]), default=(first, first + 1))
    a, b = best
    if b - a < least:
        a = max(0, min(a, len(text) - least))
        b = min(len(text), a + least)
    return a, min(b, a + most)


def evidence(text: Column, terms: Column, least: int = 40, most: int = 500) -> Column:
    @F.pandas_udf("struct<start: int, end: int>")
    def run(texts: pd.Series, wanted: pd.Series) -> pd.DataFrame:
        found = [locate(t or "", list(w) if w is not None else [], least, most) or (None, None) for t, w in zip(texts, wanted, strict=True)]
        return pd.DataFrame({"start": pd.array([a for a, _ in found], "Int32"), "end": pd.array([b for _, b in found], "Int32")})

    return run(text, terms)


def validated(start: Column, end: Column, text: Column, least: int, most: int, correction: int = 50) -> Column:
    """A span moved into its text if no more than ``correction`` characters lay outside and its length is in bounds;
    else null."""
    n = F.length(text)
    a, b = F.least(F.greatest(start, F.lit(0)), n), F.least(F.greatest(end, F.lit(0)), n)
    outside = F.abs(start - a) + F.abs(end - b)
    return F.when((outside <= correction) & (b - a >= least) & (b - a <= most), F.struct(a.alias("start"), b.alias("end")))


def quoted(text: Column, start: Column, end: Column, most: int) -> Column:
    """T20."""
    return F.left(F.substring(text, start + 1, end - start), F.lit(most))
