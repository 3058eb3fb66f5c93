"""What operators leave on disk and in memory while they go on."""

import time

import numpy as np
import pyarrow as pa

from tidewrack.llm import common, jaccard_join, toxicity
from tidewrack.llm.fingerprints import fingerprint_documents


def shuffled(spark):
    """Bytes of shuffle files."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_") and f.getName().endswith(".data"))


def test_fingerprints_let_go_of_the_compared_texts(spark):
    common.release(spark)
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, rng.bytes(10_000).hex()) for i in range(400)], "doc_id long, text string").localCheckpoint()
    time.sleep(1)
    before = shuffled(spark)
    made = fingerprint_documents(docs)
    for _ in range(40):
        if shuffled(spark) - before < 1_000_000:
            break
        time.sleep(0.25)
    assert shuffled(spark) - before < 1_000_000  # the texts have 8 MB
    assert made.count() == 400


def test_training_gives_memory_back_on_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(6)
    docs = spark.createDataFrame([(i, rng.bytes(10_000).hex()) for i in range(200)], "doc_id long, text string").localCheckpoint()
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    held = []
    monkeypatch.setattr(toxicity, "trim", lambda: held.append(pa.total_allocated_bytes()))
    before = pa.total_allocated_bytes()
    toxicity.train(docs, labels)
    assert held and held[-1] - before < 1_000_000  # the sample has 3 MB


def test_fingerprints_shuffle_texts_by_id_once(spark):
    rng = np.random.default_rng(7)
    docs = spark.createDataFrame([(i, rng.bytes(10_000).hex()) for i in range(400)], "doc_id long, text string").localCheckpoint()
    key = "spark.sql.autoBroadcastJoinThreshold"
    usual = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        made = fingerprint_documents(docs)
        time.sleep(1)
        common.release(spark)
        before = shuffled(spark)
        out = made.collect()
    finally:
        spark.conf.set(key, usual)
    assert len(out) == 400
    assert shuffled(spark) - before < 13_000_000  # the texts have 8 MB, the prefixes a third of that


def test_meetings_shuffle_sketches_of_linked_sets_only(spark, monkeypatch):
    rng = np.random.default_rng(8)
    mh = rng.integers(0, 2**32, (8000, jaccard_join.SIZE), np.uint64).astype(np.uint32)
    mh[1:20] = mh[0]
    rows = [(i, m.tobytes(), (m & 255).astype(np.uint8).tobytes()) for i, m in enumerate(mh)]
    nodes = common.materialize(spark.createDataFrame(rows, "v long, mh binary, sk binary"), "nodes")
    key, seen = "spark.sql.autoBroadcastJoinThreshold", {}

    def written(df, label):
        common.release(spark)
        time.sleep(1)
        before = shuffled(spark)
        done = common.materialize(df, label)
        seen[label] = max(seen.get(label, 0), shuffled(spark) - before)
        return done

    monkeypatch.setattr(jaccard_join, "materialize", written)
    usual = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        found = jaccard_join.meetings(nodes).collect()
    finally:
        spark.conf.set(key, usual)
    assert {x for r in found for x in (r.a, r.b)} == set(range(20))
    assert seen["sizes"] < 4_500_000 and seen["live"] < 2_000_000, seen  # the minhashes have 4 MB, counts of buckets 3
