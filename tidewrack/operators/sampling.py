"""Stratified samples by hash order: repeatable, and the same wherever the rows are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.operators.ranking import top


def stratified(rows: DataFrame, cells: list[str], id_: str, each: int, seed: int = 42) -> DataFrame:
    """SM1, SM2: up to ``each`` rows of every cell (Spark keeps so many of each partition before the shuffle)."""
    return top(rows, cells, [F.xxhash64(F.lit(seed), F.col(id_)), F.col(id_)], each).drop("rn")


def excluding(rows: DataFrame, prior: DataFrame, id_: str) -> DataFrame:
    """ST4: rows that no earlier round took."""
    return rows.join(prior.select(id_).distinct(), id_, "left_anti")


def split(rows: DataFrame, id_: str, share: float, seed: int = 43) -> DataFrame:
    """Marks about ``share`` of all rows, by hash; not the split per bucket of SM4."""
    return rows.withColumn("held_out", F.pmod(F.xxhash64(F.lit(seed), F.col(id_)), F.lit(1_000_000)) < int(share * 1_000_000))
