"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A stable key and a shard count decide the shard, without a ring table. Going from n to n + 1 shards moves about
1 / (n + 1) of the rows, all of them into the new shard.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.llm.common import materialize, ship

#: Multiplier of the 64-bit linear congruential generator in the published algorithm.
LCG = np.uint64(2862933555777941757)
#: Rows aimed at in each ranking group.
GROUP_ROWS = 4096


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key; every pass advances all keys that have not passed ``shards`` yet."""
    key = np.asarray(keys).astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(key), np.int64)
    ahead = np.zeros(len(key), np.int64)
    todo = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(todo):
            shard[todo] = ahead[todo]
            key[todo] = key[todo] * LCG + np.uint64(1)
            step = float(1 << 31) / ((key[todo] >> np.uint64(33)).astype(np.float64) + 1.0)
            ahead[todo] = ((shard[todo] + 1).astype(np.float64) * step).astype(np.int64)
            todo = todo[ahead[todo] < shards]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """Shard in [0, shards) of an integer key; a null key counts as 0."""
    if shards < 1:
        raise ValueError("shards must be positive")

    @F.pandas_udf("int")
    def pick(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64), shards).astype(np.int32))

    return pick(F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint")))


def assign_shards(rows: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16) -> DataFrame:
    """Shard, gapless slot in the shard, and the shard that one more shard would give, for every row.

    Returns key, size (UTF-8 bytes plus 1; null text: 1), text_crc32, law, shard, slot, grown_shard. Repeated rows share
    the shard and get slots of their own; a null key counts as 0; an empty table gives no rows; other columns of the
    input are ignored, whatever their names.

    Slots: rows of a shard are dealt over groups by a hash of the row and its number in the scan, so that rows of one key
    are spread like others, ranked in each group, and lifted by the sizes of the groups before. No task ranks a whole
    shard. The narrow rows are written once, as that number must not change between the sizes and the ranks.
    """
    ship(rows.sparkSession)
    text_bytes = F.coalesce(F.col(text), F.lit("")).cast("binary")
    groups = max(2, math.ceil(rows.count() / (shards * GROUP_ROWS)), math.ceil(512 / shards))
    narrow = rows.select(
        F.col(key).alias("k"),
        (F.octet_length(text_bytes) + 1).cast("bigint").alias("size"),
        F.crc32(text_bytes).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )
    placed = narrow.select("*", shard_of(F.col("k"), shards).alias("shard"), shard_of(F.col("k"), shards + 1).alias("grown_shard"), F.pmod(F.xxhash64("k", "row"), F.lit(groups)).alias("sub"))
    placed = materialize(placed, "shards")
    sizes = placed.groupBy("shard", "sub").count()
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "sub", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "sub").orderBy("k", "text_crc32", "row")
    ranked = placed.withColumn("at", F.row_number().over(inside) - 1)
    return ranked.join(starts, ["shard", "sub"]).select(
        F.col("k").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start") + F.col("at")).cast("bigint").alias("slot"), "grown_shard",
    )
