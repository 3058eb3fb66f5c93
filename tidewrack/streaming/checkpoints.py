"""Resumable work: what is done is a table keyed by item; a run takes what is left, and the last result of a key holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewrack.operators.ranking import last_wins


def remaining(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """ST1, ST2: items without a result."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def merged(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """ST9: one row for each key, the one of the highest version."""
    return last_wins(old.unionByName(new, allowMissingColumns=True), keys, version)


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def resume(spark: SparkSession, items: DataFrame, results: str, key: str, work: Callable[[DataFrame], DataFrame]) -> int:
    """Work on what has no result in the Parquet table ``results`` yet, and append it; gives the number of rows that are new.

    Rows are counted while they are written. Spark commits a run's files at its end, so one that dies leaves nothing, and
    the next run takes its items again.
    """
    todo = remaining(items, spark.read.parquet(results), key) if _exists(spark, results) else items
    seen = Observation()
    work(todo).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(results)
    return seen.get["n"]


def file_stream(spark: SparkSession, path: str, schema, work: Callable[[DataFrame], DataFrame], out: str, state: str) -> None:
    """Everything that is new in a folder of Parquet files, as one bounded stream; ``state`` remembers what is done.

    A batch is written to a folder of its number (column ``batch``), which it replaces when it is played again.
    """
    write = lambda rows, n: work(rows).write.mode("overwrite").parquet(f"{out}/batch={n}")
    stream = spark.readStream.schema(schema).parquet(path)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def until_saturated(step: Callable[[int], DataFrame], check: Callable[[DataFrame], DataFrame], most: int = 20) -> tuple[int, DataFrame]:
    """ST5: rounds until ``check`` (one row with ``saturated``) says so; gives the last round and the coverage so far."""
    for r in range(1, most + 1):
        coverage = step(r)
        if check(coverage).first()["saturated"]:
            break
    return r, coverage
