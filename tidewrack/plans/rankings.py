"""Arbitration, hoisting, evidence, representatives, batches, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewrack.operators import ranking as R
from tidewrack.operators import sampling as S
from tidewrack.plans.proxies import load


def _candidates(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return load(spark, sf_dir, "events").select(
        F.col("user_id").alias("accession"), F.col("event_type").alias("slot"), F.col("value"), F.when(k % 3 == 0, "table").when(k % 3 == 1, "llm").otherwise("ocr").alias("modality"),
        F.when(k % 2 == 0, "METHODS").otherwise("RESULTS").alias("section"), F.when(k % 5 > 0, 2000 + k % 20).alias("year"), F.col("event_id").alias("ord"),
    )


CANDIDATES = "c AS (SELECT user_id AS accession, event_type AS slot, value, event_id AS ord, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events), cand AS (SELECT accession, slot, value, ord, CASE k % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'llm' ELSE 'ocr' END AS modality, CASE WHEN k % 2 = 0 THEN 'METHODS' ELSE 'RESULTS' END AS section, CASE WHEN k % 5 > 0 THEN 2000 + k % 20 END AS year FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY accession, slot ORDER BY CASE modality WHEN 'table' THEN 0 WHEN 'llm' THEN 1 ELSE 99 END, CASE section WHEN 'METHODS' THEN 0 ELSE 1 END, coalesce(year, 9999), ord) AS rn, count(*) OVER (PARTITION BY accession, slot) AS n FROM cand)"


def w1_arbitration(spark, sf_dir):
    return R.arbitrated(_candidates(spark, sf_dir).withColumn("value", F.col("ord").cast("string")), ["accession", "slot"], "value")


def a34_arbitration_stats(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    return c.groupBy("modality", "section").agg(F.count("*").alias("n"), F.countDistinct("accession").alias("n_accessions"), F.count_if(F.col("year").isNull()).alias("n_without_year"))


def w2_hoist(spark, sf_dir):
    """Own items of an order first, else those of its customer."""
    own = load(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("target"), F.col("l_linestatus").alias("slot"), F.lit(0).alias("level"), F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("item"))
    o = load(spark, sf_dir, "orders")
    parent = o.join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("target"), F.col("o_orderstatus").alias("slot"), F.lit(1).alias("level"), F.concat(F.lit("c"), "c_custkey").alias("item"))
    return R.hoisted(own, parent, ["target", "slot"], [F.col("item")])


def w3_canonical(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_brand", F.concat_ws("_", F.split("p_name", " ")[1], F.split("p_name", " ")[0], F.when(F.col("p_size") > 25, F.lower("p_type"))).alias("name"), (F.col("p_partkey") % 7).alias("papers"))
    return R.representative(p, "p_brand", "name", "papers")


def w5_evidence_cap2(spark, sf_dir):
    rows = _candidates(spark, sf_dir).select(F.col("slot").alias("key"), F.col("accession").alias("paper"), (F.col("modality") == "table").cast("int").alias("is_table"), "ord")
    return R.evidence_capped(rows, "key", "paper", "is_table", "ord").select("key", "paper", "is_table", "ord")


def w6_evidence_priority(spark, sf_dir):
    prio = F.when(F.col("section") == "METHODS", 2).otherwise(1) + F.when(F.col("modality") == "table", 5).otherwise(0)
    c = _candidates(spark, sf_dir).withColumn("evidence", F.col("ord").cast("string"))
    return R.best_by_priority(c, "accession", "evidence", prio, "ord")


def j2_last_wins(spark, sf_dir):
    return R.last_wins(_candidates(spark, sf_dir).select("accession", "slot", "modality", "ord"), ["accession", "slot"], "ord")


def w9_top_tokens(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0)))).alias("token"))
    return d.groupBy("token").agg(F.count("*").alias("df")).orderBy(F.col("df").desc(), "token").limit(100)


def w10_zipf(spark, sf_dir):
    """Frequencies by rank: equal frequencies are counted first, so ranks come from running counts over few rows."""
    from pyspark.sql import Window

    d = load(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))).alias("token"))
    freq = d.groupBy("token").agg(F.count("*").alias("f")).groupBy("f").agg(F.count("*").alias("n_tokens"))
    w = Window.orderBy(F.col("f").desc())
    return freq.select("f", "n_tokens", (F.sum("n_tokens").over(w) - F.col("n_tokens") + 1).alias("first_rank"))


def w13_chunks(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_type", "p_name", "p_partkey")
    return R.chunk_numbers(p, "p_type", [F.col("p_name"), F.col("p_partkey")], 80).select("p_type", "p_partkey", "rn", "chunk", "n_chunks")


def x12_capped_listing(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_brand", "p_name", "p_partkey")
    return R.capped_total(p, "p_brand", [F.col("p_name"), F.col("p_partkey")], 30, 400).select("p_brand", "p_partkey", "at")


def x13_batches(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", "p_name")
    return R.batches(p, [F.col("p_name"), F.col("p_partkey")], 60).groupBy("batch").agg(F.count("*").alias("n"), F.min("p_name").alias("first"), F.max("p_name").alias("last"))


def sm1_stratified(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return S.stratified(c, ["c_mktsegment", "c_nationkey"], "c_custkey", 3).groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))


def st4_next_round(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    one = S.stratified(c, ["c_mktsegment"], "c_custkey", 20)
    two = S.stratified(S.excluding(c, one, "c_custkey"), ["c_mktsegment"], "c_custkey", 20, 43)
    return one.join(two, "c_custkey", "left_semi").agg(F.count("*").alias("n_both")).join(two.agg(F.count("*").alias("n_second")))


def o9_top_signature(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    return R.top(p, ["p_type"], [F.col("p_retailprice").desc(), F.col("p_partkey")], 5).select("p_type", "p_partkey", "rn")


def o8_top30(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(30)


def a39_tail_tokens(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("t"))
    x = p.select(F.element_at("t", -1).alias("token"), "p_partkey")
    n = x.groupBy("token").agg(F.count("*").alias("n"))
    few = R.top(x, ["token"], [F.col("p_partkey")], 8).groupBy("token").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda k: k.cast("string")), " ").alias("samples"))
    return n.join(few, "token")


QUERIES = {f.__name__: f for f in (w1_arbitration, a34_arbitration_stats, w2_hoist, w3_canonical, w5_evidence_cap2, w6_evidence_priority, j2_last_wins, w9_top_tokens, w10_zipf, w13_chunks, x12_capped_listing, x13_batches, sm1_stratified, st4_next_round, o9_top_signature, o8_top30, a39_tail_tokens)}
PN = "p AS (SELECT p_brand, array_to_string(list_filter([split_part(p_name, ' ', 2), split_part(p_name, ' ', 1), CASE WHEN p_size > 25 THEN lower(p_type) END], lambda x: x IS NOT NULL), '_') AS name, p_partkey % 7 AS papers FROM part)"
SQL = {
    "w1_arbitration": "WITH " + CANDIDATES + " SELECT accession, slot, max(CAST(ord AS VARCHAR)) FILTER (rn = 1) AS value, coalesce(string_agg(CAST(ord AS VARCHAR), '|' ORDER BY rn) FILTER (rn BETWEEN 2 AND 4), '') AS alternates, max(n) AS n_candidates FROM r GROUP BY accession, slot",
    "a34_arbitration_stats": "WITH " + CANDIDATES + " SELECT modality, section, count(*) AS n, count(DISTINCT accession) AS n_accessions, count(*) FILTER (year IS NULL) AS n_without_year FROM cand GROUP BY ALL",
    "w2_hoist": "WITH u AS (SELECT l_orderkey AS target, l_linestatus AS slot, 0 AS level, l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS item FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT o_orderkey, o_orderstatus, 1, 'c' || c_custkey FROM orders JOIN customer ON o_custkey = c_custkey) SELECT target, slot, level, item FROM (SELECT *, row_number() OVER (PARTITION BY target, slot ORDER BY level, item) AS rn FROM u) WHERE rn = 1",
    "w3_canonical": "WITH " + PN + " SELECT p_brand, first(name ORDER BY papers DESC, length(name) - length(replace(name, '_', '')), length(name), name) AS canonical, count(*) AS n_members FROM p GROUP BY p_brand",
    "w5_evidence_cap2": "WITH " + CANDIDATES + ", e AS (SELECT slot AS key, accession AS paper, CAST(modality = 'table' AS INT) AS is_table, ord FROM cand), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, is_table, paper ORDER BY ord) AS a FROM e) WHERE a = 1) SELECT key, paper, is_table, ord FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY is_table, ord) AS b FROM o) WHERE b <= 2",
    "w6_evidence_priority": "WITH " + CANDIDATES + ", p AS (SELECT *, CASE section WHEN 'METHODS' THEN 2 ELSE 1 END + CASE modality WHEN 'table' THEN 5 ELSE 0 END AS pr FROM cand) SELECT accession, first(CAST(ord AS VARCHAR) ORDER BY pr DESC, ord) AS evidence, max(pr) AS priority FROM p GROUP BY accession",
    "j2_last_wins": "WITH " + CANDIDATES + " SELECT accession, slot, arg_max(modality, ord) AS modality, max(ord) AS ord FROM cand GROUP BY ALL",
    "w9_top_tokens": "SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS token FROM documents) GROUP BY token ORDER BY df DESC, token LIMIT 100",
    "w10_zipf": "WITH f AS (SELECT token, count(*) AS f FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS token FROM documents) GROUP BY token), g AS (SELECT f, count(*) AS n_tokens FROM f GROUP BY f) SELECT f, n_tokens, CAST(sum(n_tokens) OVER (ORDER BY f DESC) - n_tokens + 1 AS BIGINT) AS first_rank FROM g",
    "w13_chunks": "SELECT p_type, p_partkey, rn, CAST(floor((rn - 1) / 80) AS INT) AS chunk, CAST(ceil(n / 80) AS INT) AS n_chunks FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_name, p_partkey) AS rn, count(*) OVER (PARTITION BY p_type) AS n FROM part)",
    "x12_capped_listing": "WITH a AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS rn FROM part), b AS (SELECT *, row_number() OVER (ORDER BY p_brand, rn) AS pos FROM a WHERE rn <= 30) SELECT p_brand, p_partkey, pos AS \"at\" FROM b WHERE pos <= 400",
    "x13_batches": "WITH a AS (SELECT *, (row_number() OVER (ORDER BY p_name, p_partkey) - 1) // 60 AS batch FROM part) SELECT batch, count(*) AS n, min(p_name) AS first, max(p_name) AS last FROM a GROUP BY batch",
    "sm1_stratified": "SELECT c_mktsegment, c_nationkey, least(count(*), 3) AS n FROM customer GROUP BY ALL",
    "st4_next_round": "SELECT CAST(0 AS BIGINT) AS n_both, CAST(sum(least(greatest(n - 20, 0), 20)) AS BIGINT) AS n_second FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment)",
    "o9_top_signature": "SELECT p_type, p_partkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn <= 5",
    "o8_top30": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30",
    "a39_tail_tokens": "WITH x AS (SELECT split_part(p_name, ' ', -1) AS token, p_partkey, row_number() OVER (PARTITION BY split_part(p_name, ' ', -1) ORDER BY p_partkey) AS rn FROM part) SELECT token, count(*) AS n, string_agg(CAST(p_partkey AS VARCHAR), ' ' ORDER BY rn) FILTER (rn <= 8) AS samples FROM x GROUP BY token",
}
