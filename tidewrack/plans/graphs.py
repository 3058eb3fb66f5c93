"""Components, path compression, families; neighbours and centroids of embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewrack.operators import graph as G
from tidewrack.operators import vectors as V
from tidewrack.plans.proxies import load


def _edges(spark, sf_dir):
    """Names that are similar inside a brand."""
    from tidewrack.operators.matching import similar_pairs
    from tidewrack.plans.joins import _bucketed

    named = _bucketed(spark, sf_dir)
    pairs = similar_pairs(named, "p_brand", "name")
    node = lambda c: F.concat_ws("/", "p_brand", c)
    return named.select(node("name").alias("node")), pairs.select(node("a").alias("a"), node("b").alias("b"))


def g1_components(spark, sf_dir):
    nodes, edges = _edges(spark, sf_dir)
    return G.components(nodes, edges)


def g1_constrained(spark, sf_dir):
    """Star edges of the customers of all orders of a group, kept where the market segments agree; refused edges are counted."""
    o = load(spark, sf_dir, "orders")
    groups = o.select((F.col("o_orderkey") % 900).alias("g"), F.col("o_custkey").alias("m"), F.col("o_orderkey").alias("pos"))
    marked = G.allowed(G.star_edges(groups, "g", "m", "pos"), load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment")
    return marked.groupBy("ok").agg(F.count("*").alias("n_edges"))


def g1_constrained_components(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    groups = o.select((F.col("o_orderkey") % 900).alias("g"), F.col("o_custkey").alias("m"), F.col("o_orderkey").alias("pos"))
    keys = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    edges = G.allowed(G.star_edges(groups, "g", "m", "pos"), keys, "c_custkey", "c_mktsegment").filter("ok").select("a", "b")
    c = G.components(groups.select(F.col("m").alias("node")), edges)
    return c.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1")


def g7_path_compress(spark, sf_dir):
    """Each part points to the part of half its key until 0."""
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("s"), F.floor(F.col("p_partkey") / 3).alias("t")).filter("s > 4")
    return G.compressed(p, "s", "t")


def g8_families(spark, sf_dir):
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.concat(F.split(F.lower("p_name"), " "), F.array(F.lower("p_type"))).alias("tokens"))
    heads = p.select(F.explode("tokens").alias("token")).groupBy("token").count().filter("count % 2 = 0").select("token")
    return G.families(p, F.col("tokens"), heads).groupBy("anchor").agg(F.count("*").alias("n"), F.count_if("is_primary").alias("n_primary"))


def w16_knn(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    return V.neighbours(e, "vec_id", "embedding", 5).select(F.col("id").alias("vec_id"), "other", "rn", F.round("cosine", 4).alias("cosine"))


def a42_knn_purity(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    return V.purity(V.neighbours(e, "vec_id", "embedding", 5), e.select(F.col("vec_id").alias("id"), "label"))


def v5_misplaced(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    lab = e.select(F.col("vec_id").alias("id"), "label")
    near = V.neighbours(e, "vec_id", "embedding", 5).join(lab, "id").join(lab.select(F.col("id").alias("other"), F.col("label").alias("near")), "other")
    return near.groupBy("id").agg(F.count_if(F.col("label") == F.col("near")).alias("n_same")).filter("n_same < 3").select(F.col("id").alias("vec_id"), "n_same")


def m17_centroids(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    return V.centroid_distances(e, "label", "embedding").withColumn("distance", F.round("distance", 5))


QUERIES = {f.__name__: f for f in (g1_components, g1_constrained, g1_constrained_components, g7_path_compress, g8_families, w16_knn, a42_knn_purity, v5_misplaced, m17_centroids)}
STARS = "g AS (SELECT o_orderkey % 900 AS g, o_custkey AS m, o_orderkey AS pos FROM orders), pv AS (SELECT g, arg_min(m, pos) AS a FROM g GROUP BY g), st AS (SELECT DISTINCT a, m AS b FROM g JOIN pv USING (g) WHERE a <> m), ok AS (SELECT a, b, x.c_mktsegment IS NOT DISTINCT FROM y.c_mktsegment AS ok FROM st JOIN customer x ON x.c_custkey = a JOIN customer y ON y.c_custkey = b)"
COSINE = "nn AS (SELECT x.vec_id, y.vec_id AS other, x.label, y.label AS near, list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS cosine, row_number() OVER (PARTITION BY x.vec_id ORDER BY round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 12) DESC, y.vec_id) AS rn FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id), k AS (SELECT * FROM nn WHERE rn <= 5)"


def _sql() -> dict[str, str]:
    from tidewrack.plans.joins import SQL as JOINS

    pairs = JOINS["j11_bucket_similarity"]
    return {
        "g1_components": "WITH RECURSIVE pr AS (" + pairs + "), ed AS (SELECT p_brand || '/' || a AS a, p_brand || '/' || b AS b FROM pr), bo AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), nd AS (SELECT DISTINCT x.p_brand || '/' || x.name AS node FROM (" + pairs.split("SELECT x.p_brand, x.name AS a")[0] + "SELECT DISTINCT p_brand, name FROM names) x), reach AS (SELECT node, node AS r FROM nd UNION SELECT reach.node, bo.b FROM reach JOIN bo ON bo.a = reach.r) SELECT node, min(r) AS component FROM reach GROUP BY node",
        "g1_constrained": "WITH " + STARS + " SELECT ok, count(*) AS n_edges FROM ok GROUP BY ok",
        "g1_constrained_components": "WITH RECURSIVE " + STARS + ", bo AS (SELECT a, b FROM ok WHERE ok UNION SELECT b, a FROM ok WHERE ok), reach AS (SELECT DISTINCT a AS node, a AS r FROM bo UNION SELECT reach.node, bo.b FROM reach JOIN bo ON bo.a = reach.r), c AS (SELECT node, min(r) AS component FROM reach GROUP BY node) SELECT component, count(*) AS n FROM c GROUP BY component HAVING count(*) > 1",
        "g7_path_compress": "WITH RECURSIVE w AS (SELECT p_partkey AS s, p_partkey // 3 AS t FROM part WHERE p_partkey > 4 UNION ALL SELECT s, t // 3 FROM w WHERE t > 4) SELECT s, min(t) AS t FROM w GROUP BY s",
        "g8_families": "WITH p AS (SELECT p_partkey AS key, list_append(string_split(lower(p_name), ' '), lower(p_type)) AS tokens FROM part), x AS (SELECT key, unnest(tokens) AS anchor, generate_subscripts(tokens, 1) AS pos FROM p), h AS (SELECT anchor FROM x GROUP BY anchor HAVING count(*) % 2 = 0), y AS (SELECT x.* FROM x JOIN h USING (anchor)), l AS (SELECT key, max(pos) AS last FROM y GROUP BY key), z AS (SELECT key, anchor, bool_or(pos = last) AS pr FROM y JOIN l USING (key) GROUP BY ALL) SELECT anchor, count(*) AS n, count(*) FILTER (pr) AS n_primary FROM z GROUP BY anchor",
        "w16_knn": "WITH " + COSINE + " SELECT vec_id, other, rn, round(cosine, 4) AS cosine FROM k",
        "a42_knn_purity": "WITH " + COSINE + " SELECT label, near, count(*) AS n FROM k GROUP BY ALL",
        "v5_misplaced": "WITH " + COSINE + " SELECT vec_id, count(*) FILTER (label = near) AS n_same FROM k GROUP BY vec_id HAVING count(*) FILTER (label = near) < 3",
        "m17_centroids": "WITH m AS (SELECT label, d, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY label), u AS (SELECT label, d, x / n AS x FROM m JOIN n USING (label)) SELECT a.label AS a, b.label AS b, round(1 - sum(a.x * b.x), 5) AS distance FROM u a JOIN u b ON a.d = b.d AND a.label < b.label GROUP BY ALL",
    }


SQL = _sql()
