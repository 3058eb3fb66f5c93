"""Statistics of count vectors and contingency tables, as columns."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewrack import constants as K


def entropy(counts: list[Column]) -> Column:
    """M1: entropy over the natural logarithm of their number; 0 for no counts at all."""
    total = reduce(lambda a, b: a + b, counts)
    terms = [F.when(c > 0, -(c / total) * F.ln(c / total)).otherwise(0.0) for c in counts]
    return F.when(total > 0, reduce(lambda a, b: a + b, terms) / math.log(len(counts))).otherwise(0.0)


def dominant(counts: dict[str, Column]) -> tuple[Column, Column]:
    """M1: name of the greatest count (first of equal ones) and its share."""
    total = reduce(lambda a, b: a + b, counts.values())
    most = F.greatest(*counts.values())
    name = F.coalesce(*[F.when(c == most, F.lit(n)) for n, c in counts.items()])
    return name, F.when(total > 0, most / total).otherwise(0.0)


def category(h: Column, share: Column, papers: Column, h_univ: float = K.H_UNIVERSAL, n_univ: int = K.PAPERS_UNIVERSAL, n_cross: int = K.PAPERS_CROSS, h_sig: float = K.H_SIGNATURE, s_sig: float = K.SHARE_SIGNATURE, n_sig: int = K.PAPERS_SIGNATURE) -> Column:
    """M2: all comparisons strict; Signature overrides."""
    return (
        F.when((h < h_sig) & (share > s_sig) & (papers > n_sig), "Signature").when((h > h_univ) & (papers > n_univ), "Universal")
        .when((h > h_sig) & (h <= h_univ) & (papers > n_cross), "Cross-biome common").otherwise("Niche")
    )


def fisher_greater(a: Column, b: Column, c: Column, d: Column) -> Column:
    """M3: one-sided p-value of [[a, b], [c, d]]: sum of the hypergeometric terms from a up; 1 for a <= 0 or a negative cell.

    From a beyond the mode, terms are summed upwards, else those below a downwards, and taken from 1: so the first term is
    the largest, the others follow by their ratio, and they vanish within a few standard deviations, whatever the counts.
    """
    cell = F.struct(*[x.cast("double").alias(n) for x, n in ((a, "a"), (b, "b"), (c, "c"), (d, "d"))])
    return F.transform(F.array(cell), lambda x: _tail(x["a"], x["b"], x["c"], x["d"]))[0]


def _tail(a: Column, b: Column, c: Column, d: Column) -> Column:
    n = a + b + c + d
    mode = F.floor((a + b + 1) * (a + c + 1) / (n + 2))
    spread = (a + b) * (c + d) * (a + c) * (b + d) / (n * n * F.greatest(n - 1, F.lit(1.0)))
    reach = F.lit(20) + F.ceil(12 * F.sqrt(spread))

    def log_term(p, q, r, s):
        lg = lambda x: _lgamma(x + 1)
        return lg(p + q) + lg(r + s) + lg(p + r) + lg(q + s) - lg(p + q + r + s) - lg(p) - lg(q) - lg(r) - lg(s)

    def total(steps, ratio):
        """1 + r(1) + r(1) r(2) + ... over at most ``steps`` terms."""
        acc = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
        take = F.least(steps, reach).cast("int")
        return F.aggregate(
            F.when(take > 0, F.sequence(F.lit(1), take)).otherwise(F.array().cast("array<int>")), acc,
            lambda x, k: F.struct((x["t"] * ratio(k)).alias("t"), (x["s"] + x["t"] * ratio(k)).alias("s")), lambda x: x["s"],
        )

    up = F.exp(log_term(a, b, c, d)) * total(F.least(b, c), lambda k: (b - k + 1) * (c - k + 1) / ((a + k) * (d + k)))
    # one less in a: (a - 1, b + 1, c + 1, d - 1), from which terms go down while a and d last
    below = F.exp(log_term(a - 1, b + 1, c + 1, d - 1)) * total(F.least(a - 1, d - 1), lambda k: (a - k) * (d - k) / ((b + 1 + k) * (c + 1 + k)))
    down = 1 - F.when(d >= 1, below).otherwise(0.0)
    inside = F.when(a >= mode, up).otherwise(down)
    return F.when((a <= 0) | (b < 0) | (c < 0) | (d < 0), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), inside)))


def _lgamma(x: Column) -> Column:
    """Logarithm of the gamma function: Stirling's series, shifted up by eight."""
    z = x + 8
    series = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5.0)))
    return series - F.ln(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7))
