import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewrack.operators import graph
from tidewrack.operators.matching import targets_or_all
from tidewrack.sources import files
from tidewrack.streaming import checkpoints


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_json_sources(spark, tmp_path):
    p = write(tmp_path / "a.json", json.dumps([{"pmid": "1", "text": "x"}, {"pmid": "2"}]))
    assert [(r.pmid, r.text) for r in files.json_array(spark, p, "pmid string, text string").orderBy("ord").collect()] == [("1", "x"), ("2", None)]
    for k, value in enumerate(({"a": 1}, [{"a": 1}, 5, [{"a": 2}]], [[{"a": 1}, {"a": 2}]])):
        p = write(tmp_path / f"r{k}.json", json.dumps(value))
        assert {r.a for r in files.ragged_json(spark, p, "a int").collect()} == ({1} if k == 0 else {1, 2})
    p = write(tmp_path / "l.jsonl", '{"k": "a", "v": 1}\nbroken\n{"k": "a", "v": 2}\n{"k": "b", "v": 3}\n')
    got = files.json_lines(spark, p, T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.IntegerType())]), ["k"])
    assert {(r.k, r.v) for r in got.collect()} == {("a", 2), ("b", 3)}


def test_text_sources(spark, tmp_path):
    p = write(tmp_path / "y.txt", "1 2001\n2\n1  1999 x\n3 abc\n\n")
    assert {tuple(r) for r in files.pairs(spark, p).collect()} == {("1", "1999"), ("3", "abc")}
    assert {tuple(r) for r in files.pairs(spark, p, as_int=True).collect()} == {("1", 1999)}
    p = write(tmp_path / "acc.tsv", "SRR1\tPRJNA1\tSAMN1\to\ts\tss\te\t1; 2;\nshort\tline\n")
    papers = files.accession_papers(files.accession_list(spark, p))
    assert {r.pmid for r in papers.collect()} == {"1", "2"}
    p = write(tmp_path / "w.txt", "Lakes\nSoil\n\n")
    assert {r.term for r in files.whitelist(spark, p).collect()} == {"lakes", "lake", "soil"}
    p = write(tmp_path / "c.csv", "raw_key,n\n# note\nFe,1\n")
    assert [(r.raw_key, r.n) for r in files.delimited(spark, p, "raw_key string, n int", comments=True).collect()] == [("Fe", 1)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "short"), ("b", 1, None)], "k string, v int, reason string")
    files.split_by_reason(df, str(tmp_path / "kept"), str(tmp_path / "dropped"))
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 2
    files.write_index(df, str(tmp_path / "index"), "k", "v")
    assert {(r.k, tuple(r.v)) for r in spark.read.json(str(tmp_path / "index")).collect()} == {("a", (1, 2)), ("b", (1,))}
    files.write_partitioned(df, str(tmp_path / "by"), "k")
    assert {p.name for p in (tmp_path / "by").iterdir() if p.is_dir()} == {"k=a", "k=b"}


def test_lines_of_many_files_keep_their_order(spark, tmp_path):
    """The last record of a key is the one of the last file by name, though small files are packed by size."""
    for i in range(12):
        write(tmp_path / f"part-{i:02}.jsonl", "".join(json.dumps({"k": "a", "v": 100 * i + j, "pad": "x" * (997 * i % 5000)}) + "\n" for j in range(3)))
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.IntegerType())])
    got = files.json_lines(spark, str(tmp_path), schema, ["k"]).collect()
    assert [(r.k, r.v) for r in got] == [("a", 1102)]
    every = [r.v for r in files.json_lines(spark, str(tmp_path), schema).orderBy("ord").collect()]
    assert every == [100 * i + j for i in range(12) for j in range(3)]


def test_synonyms(spark):
    g = spark.createDataFrame([(0, "x", ["y", "z"]), (1, "y", ["z", "w"]), (2, "v", None)], "ord int, canonical string, aliases array<string>")
    assert {(r.alias, r.canonical) for r in files.synonyms(g).collect()} == {("x", "x"), ("y", "y"), ("z", "x"), ("w", "y"), ("v", "v")}


def test_resume_and_stream(spark, tmp_path):
    items = spark.range(10).select(F.col("id").alias("key"))
    work = lambda df: df.withColumn("result", F.col("key") * 2)
    out = str(tmp_path / "results")
    assert checkpoints.resume(spark, items.filter("key < 4"), out, "key", work) == 4
    assert checkpoints.resume(spark, items, out, "key", work) == 6
    assert checkpoints.resume(spark, items, out, "key", work) == 0
    source = str(tmp_path / "in")
    for n in (3, 5):
        spark.range(n).select(F.col("id").alias("key")).write.mode("append").parquet(source)
        checkpoints.file_stream(spark, source, "key bigint", work, str(tmp_path / "out"), str(tmp_path / "state"))
        assert spark.read.parquet(str(tmp_path / "out")).count() == (3 if n == 3 else 8)


def test_until_saturated(spark):
    step = lambda r: spark.range(1).select(F.lit(r >= 3).alias("saturated"))
    assert checkpoints.until_saturated(step, lambda c: c)[0] == 3


def test_components_of_a_long_chain(spark):
    nodes = spark.range(60).select(F.col("id").alias("node"))
    edges = spark.range(1, 50).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    got = {r.node: r.component for r in graph.components(nodes, edges).collect()}
    assert got == {i: 0 if i < 50 else i for i in range(60)}


def test_compressed_chain_and_targets(spark):
    maps = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "s string, t string")
    assert {(r.s, r.t) for r in graph.compressed(maps, "s", "t").collect()} == {("a", "d"), ("b", "d"), ("c", "d"), ("x", "y")}
    pairs = spark.createDataFrame([("t1",), ("t2",)], "target string")
    sections = spark.createDataFrame([(1,), (2,)], "section int")
    hits = spark.createDataFrame([(1, "t2")], "section int, target string")
    assert {tuple(r) for r in targets_or_all(pairs, sections, hits, "section", "target").collect()} == {(1, "t2"), (2, "t1"), (2, "t2")}


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    """Without its commit a batch is played again, and its rows are there once."""
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.range(5).select(F.col("id").alias("key")).write.parquet(source)
    for _ in range(2):
        checkpoints.file_stream(spark, source, "key bigint", lambda df: df, out, state)
        commits = tmp_path / "state" / "commits"
        for f in commits.iterdir():
            f.unlink()
        assert spark.read.parquet(out).count() == 5


def test_clusters_of_similar_names(spark):
    """Single-link clusters equal a union-find over all similar pairs of a bucket."""
    from tidewrack.functions import text as T

    names = ["depth", "depths", "water_depth", "depht", "salinity", "salinity_psu", "ph", "temp", "temperature", "temperatures", "total_nitrogen", "total_n", "nitrogen_total"]
    rows = [(b, n) for b in ("a", "b") for n in names[: 13 if b == "a" else 6]]
    df = spark.createDataFrame(rows, "b string, n string")
    pairs = df.alias("x").join(df.alias("y"), F.expr("x.b = y.b and x.n < y.n")).filter(T.similar(F.col("x.n"), F.col("y.n"))).select("x.b", F.col("x.n").alias("p"), F.col("y.n").alias("q")).collect()
    parent = {r: r for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in pairs:
        p, q = sorted((find((r.b, r.p)), find((r.b, r.q))))
        parent[q] = p
    assert {(r.b, r.n): r.cluster for r in graph.clusters(df, "b", "n").collect()} == {r: find(r)[1] for r in rows}
