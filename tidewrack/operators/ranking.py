"""Ranking: arbitration, hoisting, representatives, evidence, top-k. Every order ends in a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack import constants as K


def ranked(rows: DataFrame, by: list[str], order: list, name: str = "rn") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """First ``k`` rows of each group (Spark limits each partition before the shuffle)."""
    return ranked(rows, by, order).filter(F.col("rn") <= k)


def arbitration_order(modality: str, section: str, year: str, ordinal: str) -> list[Column]:
    """Tables before models, methods before other sections, early years first, then input order."""
    return [
        F.when(F.col(modality) == "table", 0).when(F.col(modality) == "llm", 1).otherwise(99), F.when(F.col(section) == "METHODS", 0).otherwise(1),
        F.coalesce(F.col(year), F.lit(K.MISSING_YEAR)), F.col(ordinal),
    ]


def arbitrated(candidates: DataFrame, by: list[str], value: str, modality: str = "modality", section: str = "section", year: str = "year", ordinal: str = "ord", alternates: int = K.ALTERNATES) -> DataFrame:
    """The winning value of each group, the next ones as alternates (joined by pipes) and the number of candidates.

    The first few rows of each group are found before anything is collected, so a large group stays spread out.
    """
    best = top(candidates, by, arbitration_order(modality, section, year, ordinal), alternates + 1)
    sizes = candidates.groupBy(*by).agg(F.count("*").alias("n_candidates"))
    listed = F.array_sort(F.collect_list(F.when(F.col("rn") > 1, F.struct("rn", F.col(value).cast("string").alias("v")))))
    chosen = best.groupBy(*by).agg(F.max(F.when(F.col("rn") == 1, F.col(value))).alias("value"), F.array_join(F.transform(listed, lambda x: x["v"]), "|").alias("alternates"))
    return chosen.join(sizes, by)


def hoisted(own: DataFrame, parent: DataFrame, by: list[str], order: list) -> DataFrame:
    """For each target and slot the row of the nearest level, then by ``order``. Both sides have ``level``."""
    return top(own.unionByName(parent), by, [F.col("level"), *order], 1).drop("rn")


def representative(members: DataFrame, group: str, name: str, papers: str) -> DataFrame:
    """Most papers, fewest underscores, shortest, first in the alphabet."""
    score = F.struct(-F.col(papers), F.length(name) - F.length(F.replace(F.col(name), F.lit("_"), F.lit(""))), F.length(name), F.col(name))
    return members.groupBy(group).agg(F.min_by(name, score).alias("canonical"), F.count("*").alias("n_members"))


def evidence_capped(rows: DataFrame, key: str, paper: str, is_table: str, ordinal: str, cap: int = 2) -> DataFrame:
    """Up to ``cap`` rows of each key, texts before tables, one of each paper within either kind, in input order."""
    one = top(rows, [key, is_table, paper], [F.col(ordinal)], 1).drop("rn")
    return top(one, [key], [F.col(is_table), F.col(ordinal)], cap)


def best_by_priority(rows: DataFrame, key: str, value: str, priority: Column, ordinal: str) -> DataFrame:
    """The first value of the highest priority."""
    return rows.groupBy(key).agg(F.min_by(value, F.struct(-priority, F.col(ordinal))).alias(value), F.max(priority).alias("priority"))


def last_wins(rows: DataFrame, by: list[str], ordinal: str) -> DataFrame:
    """J2, SRC11, SRC18: the last row of each key."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col(ordinal)).alias("x")).select(*by, "x.*")


def chunk_numbers(rows: DataFrame, by: str, order: list, size: int = 80) -> DataFrame:
    """Chunks of at most ``size`` members in a fixed order."""
    n = F.count("*").over(Window.partitionBy(by))
    return ranked(rows, [by], order).withColumn("chunk", F.floor((F.col("rn") - 1) / size).cast("int")).withColumn("n_chunks", F.ceil(n / size).cast("int"))


def capped_total(rows: DataFrame, group_order: str, order: list, each: int, total: int) -> DataFrame:
    """Up to ``each`` rows of a group and ``total`` in all, in the order of the groups."""
    few = top(rows, [group_order], order, each).orderBy(group_order, "rn").limit(total)
    return few.withColumn("at", F.row_number().over(Window.orderBy(group_order, "rn")))


def batches(rows: DataFrame, order: list, size: int) -> DataFrame:
    """Batch numbers of rows in an order: ranks are taken within ranges of the order and lifted by what is before."""
    placed = rows.repartitionByRange(*order).withColumn("pid", F.spark_partition_id())
    inside = placed.withColumn("at", F.row_number().over(Window.partitionBy("pid").orderBy(*order)))
    sizes = inside.groupBy("pid").agg(F.count("*").alias("n"))
    start = sizes.select("pid", (F.sum("n").over(Window.orderBy("pid")) - F.col("n")).alias("start"))
    return inside.join(F.broadcast(start), "pid").withColumn("batch", F.floor((F.col("start") + F.col("at") - 1) / size)).drop("pid", "at", "start")
