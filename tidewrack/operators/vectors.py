"""Embeddings: nearest neighbours, label purity, centroids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.operators.ranking import top

#: Queries held by one task, and vectors that a block of it is compared with at a time.
BLOCK = 2048


def neighbours(vectors: DataFrame, id_: str, vector: str, k: int = 5, block: int = BLOCK) -> DataFrame:
    """The k nearest others of every vector by cosine, then id.

    Vectors are dealt over blocks; each pair of blocks is one task-sized matrix product that keeps the k best of every
    query, and the best of all blocks are ranked at the end. Rows sent grow with blocks times vectors, not with pairs.
    """
    n = max(1, -(-vectors.count() // block))
    dealt = vectors.select(F.col(id_).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    both = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    pairs = both.select(F.col("b").alias("i"), F.col("o").alias("j"), F.lit(True).alias("asks"), "id", "v").union(both.select(F.col("o").alias("i"), F.col("b").alias("j"), F.lit(False).alias("asks"), "id", "v"))

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["asks"].to_numpy()
        unit = np.stack(rows["v"].to_numpy()) if len(rows) else np.zeros((0, 1))
        norm = np.linalg.norm(unit, axis=1, keepdims=True)
        unit = np.divide(unit, norm, out=np.zeros_like(unit), where=norm > 0)
        ids = rows["id"].to_numpy()
        q, c, qi, ci = unit[asks], unit[~asks], ids[asks], ids[~asks]
        order = np.argsort(ci, kind="stable")
        c, ci = c[order], ci[order]
        cos = np.round(q @ c.T, 12)
        cos[qi[:, None] == ci[None, :]] = -np.inf
        pick = np.argsort(-cos, axis=1, kind="stable")[:, :k]
        out = pd.DataFrame({"id": np.repeat(qi, pick.shape[1]), "other": ci[pick.ravel()], "cosine": np.take_along_axis(cos, pick, 1).ravel()})
        return out[out["cosine"] > -np.inf]

    found = pairs.groupBy("i", "j").applyInPandas(best, "id bigint, other bigint, cosine double")
    return top(found, ["id"], [F.col("cosine").desc(), F.col("other")], k)


def purity(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Neighbours of each label by their own label."""
    own = labels.select("id", F.col("label").alias("label"))
    other = labels.select(F.col("id").alias("other"), F.col("label").alias("near"))
    return pairs.join(own, "id").join(other, "other").groupBy("label", "near").agg(F.count("*").alias("n"))


def centroid_distances(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """One minus the cosine of the labels' mean vectors (labels are few)."""
    parts = vectors.select(label, F.posexplode(vector).alias("d", "x")).groupBy(label, "d").agg(F.avg("x").alias("x"))
    norm = parts.groupBy(label).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    unit = parts.join(norm, label).select(F.col(label).alias("label"), "d", (F.col("x") / F.col("norm")).alias("x"))
    a, b = unit.select(F.col("label").alias("a"), "d", F.col("x").alias("xa")), unit.select(F.col("label").alias("b"), "d", F.col("x").alias("xb"))
    return a.join(b, "d").filter("a < b").groupBy("a", "b").agg((1 - F.sum(F.col("xa") * F.col("xb"))).alias("distance"))
