"""Graphs of synonyms: connected components under partition keys, path compression, family assignment."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_FOLDERS: set[str] = set()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that executors share (``spark.checkpoint.dir``, else the warehouse); all of them go when the
    driver's JVM ends."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    folder = f"{root.rstrip('/')}/tidewrack-steps/{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _FOLDERS.add(folder)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table written once, in the folder that executors share."""
    path = scratch(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def star_edges(groups: DataFrame, group: str, member: str, position: str) -> DataFrame:
    """Edges from the first member of each group to its others."""
    pivot = groups.groupBy(group).agg(F.min_by(member, position).alias("a"))
    return groups.select(group, F.col(member).alias("b")).join(pivot, group).filter(F.col("a") != F.col("b")).select("a", "b").distinct()


def allowed(edges: DataFrame, keys: DataFrame, node: str, key: str) -> DataFrame:
    """G1: edges whose ends agree in their partition key (nulls agree); as keys partition the nodes, the components of these
    are those of a union-find that refuses all others."""
    a = keys.select(F.col(node).alias("a"), F.col(key).alias("ka"))
    b = keys.select(F.col(node).alias("b"), F.col(key).alias("kb"))
    return edges.join(a, "a").join(b, "b").withColumn("ok", F.col("ka").eqNullSafe(F.col("kb")))


def components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """node and component (its least member) of every node, isolated ones included.

    Labels fall to the least of the neighbours' and then to the label's own label, so long chains shrink by jumps; every
    round is a written table, and the loop ends when no label changes.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(nodes.select(F.col(node).alias("n"), F.col(node).alias("c")).distinct())
    while True:
        near = both.join(labels.withColumnRenamed("n", "b"), "b").groupBy("a").agg(F.min("c").alias("m"))
        lower = labels.join(near.withColumnRenamed("a", "n"), "n", "left").select("n", "c", F.least("c", "m").alias("d"))
        jumped = lower.join(labels.select(F.col("n").alias("d"), F.col("c").alias("e")), "d", "left").select("n", "c", F.least("d", "e").alias("d"))
        new = cut(jumped)
        changed = new.filter("c <> d").limit(1).count()
        labels = new.select("n", F.col("d").alias("c"))
        if not changed:
            return labels.select(F.col("n").alias(node), F.col("c").alias("component"))


def compressed(maps: DataFrame, source: str, target: str, most: int = 32) -> DataFrame:
    """End of the chain of each source, by doubling: a pass replaces a target by the target's own target. Chains that
    run into a cycle end at the cycle's least name."""
    now = maps.select(F.col(source).alias("s"), F.col(target).alias("t"))
    for _ in range(most):
        step = now.select(F.col("s").alias("t"), F.col("t").alias("u"))
        new = cut(now.join(step, "t", "left").select("s", "t", F.coalesce("u", "t").alias("u")))
        moved = new.filter("t <> u").limit(1).count()
        now = new.select("s", F.col("u").alias("t"))
        if not moved:
            break
    return now.select(F.col("s").alias(source), F.col("t").alias(target))


def families(keys: DataFrame, tokens: Column, heads: DataFrame) -> DataFrame:
    """(key, anchor, is_primary): all head words among a key's tokens; the rightmost one is primary."""
    placed = keys.select("key", F.posexplode(tokens).alias("pos", "anchor")).join(heads.select(F.col("token").alias("anchor")), "anchor", "left_semi")
    last = placed.groupBy("key").agg(F.max("pos").alias("last"))
    return placed.join(last, "key").groupBy("key", "anchor").agg(F.max(F.col("pos") == F.col("last")).alias("is_primary"))


def signature_edges(members: DataFrame, component: str, member: str, core: str) -> DataFrame:
    """Edges between components of equal signature, the shortest non-empty core of their members."""
    best = members.filter(F.size(core) > 0).groupBy(component).agg(F.min(F.struct(F.size(core).alias("n"), F.array_join(F.array_sort(core), " ").alias("s"))).alias("x"), F.min(member).alias("b"))
    first = best.groupBy("x.s").agg(F.min("b").alias("a"))
    return best.select(F.col("x.s").alias("s"), "b").join(first, "s").filter("a <> b").select("a", "b")


def clusters(names: DataFrame, bucket: str, name: str) -> DataFrame:
    """Single-link clusters inside buckets: (bucket, name, cluster), the cluster named by its least name."""
    from tidewrack.operators.matching import similar_pairs

    own = names.select(F.col(bucket).alias("__bucket"), F.col(name).alias("__name")).distinct()
    node = lambda c: F.struct("__bucket", F.col(c).alias("__name"))
    pairs = similar_pairs(own, "__bucket", "__name")
    found = components(own.select(node("__name").alias("node")), pairs.select(node("a").alias("a"), node("b").alias("b")))
    return found.select(F.col("node.__bucket").alias(bucket), F.col("node.__name").alias(name), F.col("component.__name").alias("cluster"))


def groups(labelled: DataFrame, component: str, member: str) -> DataFrame:
    """Sorted members of every component. One row holds a component, as curated groups are small; ``component`` and
    ``member`` themselves are the form for large ones."""
    return labelled.groupBy(component).agg(F.array_sort(F.collect_set(member)).alias("members"))
