"""Profiles of keys over environments, coverage, tiers, rounds."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.operators import profile as P
from tidewrack.plans.proxies import EVENT_FACTS, LANGS, OCCURRENCES, event_facts, load, occurrences

GRID = [(a, b, c, d, e) for a, b, c, d, e in product((0.75, 0.85, 0.95), (20, 50), (10, 30), (0.3, 0.4), (0.7, 0.9))]
EVENT_ENVS = ["e0", "e1", "e2", "e3"]


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.env_vectors(occurrences(spark, sf_dir), LANGS)


VECTORS = OCCURRENCES + """, vec AS (
  SELECT key, count(*) FILTER (env = 'en') AS env_en, count(*) FILTER (env = 'fr') AS env_fr, count(*) FILTER (env = 'de') AS env_de, count(*) FILTER (env = 'es') AS env_es,
         count(*) AS total_papers, count(DISTINCT env) AS n_envs_present
  FROM (SELECT DISTINCT key, env, paper FROM occ WHERE env IN ('en', 'fr', 'de', 'es')) GROUP BY key
), cls0 AS (
  SELECT *, -(CASE WHEN env_en > 0 THEN env_en / total_papers * ln(env_en / total_papers) ELSE 0 END + CASE WHEN env_fr > 0 THEN env_fr / total_papers * ln(env_fr / total_papers) ELSE 0 END
          + CASE WHEN env_de > 0 THEN env_de / total_papers * ln(env_de / total_papers) ELSE 0 END + CASE WHEN env_es > 0 THEN env_es / total_papers * ln(env_es / total_papers) ELSE 0 END) / ln(4) AS h,
         greatest(env_en, env_fr, env_de, env_es) AS most FROM vec
), cls AS (
  SELECT *, most / total_papers AS share, CASE most WHEN env_en THEN 'en' WHEN env_fr THEN 'fr' WHEN env_de THEN 'de' ELSE 'es' END AS dominant_env,
         CASE WHEN h < 0.4 AND most / total_papers > 0.7 AND total_papers > 5 THEN 'Signature' WHEN h > 0.85 AND total_papers > 50 THEN 'Universal'
              WHEN h > 0.4 AND h <= 0.85 AND total_papers > 30 THEN 'Cross-biome common' ELSE 'Niche' END AS category FROM cls0
)"""


def a1_pivot_distinct(spark, sf_dir):
    return _vectors(spark, sf_dir)


def flagship_env_entropy(spark, sf_dir):
    out = P.classified(_vectors(spark, sf_dir), LANGS)
    return out.select("key", *[f"env_{e}" for e in LANGS], "total_papers", F.round("h_norm", 6).alias("h_norm"), "dominant_env", F.round("dominant_share", 6).alias("dominant_share"), "category").orderBy(F.col("total_papers").desc(), "key")


def a2_stats(spark, sf_dir):
    return _vectors(spark, sf_dir).agg(
        F.count("*").alias("n_keys"), F.count_if(F.col("total_papers") >= 3).alias("n_ge3"), F.count_if(F.col("total_papers") >= 10).alias("n_ge10"),
        *[F.count_if(F.col("n_envs_present") == i).alias(f"n_in_{i}") for i in (1, 2, 3, 4)], *[F.sum(f"env_{e}").alias(f"sum_{e}") for e in LANGS],
    )


def f15_split_coverage(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return v.groupBy(F.when(F.col("total_papers") >= 3, "mainstream").otherwise("orphan").alias("part")).agg(F.count("*").alias("n_keys"), F.sum("total_papers").alias("papers"))


def m2_category_counts(spark, sf_dir):
    return P.classified(_vectors(spark, sf_dir), LANGS).groupBy("category", "dominant_env").agg(F.count("*").alias("n"))


def a26_threshold_grid(spark, sf_dir):
    return P.threshold_grid(P.classified(_vectors(spark, sf_dir), LANGS), GRID)


A26 = "WITH " + VECTORS + ", grid(h_univ, n_univ, n_cross, h_sig, s_sig) AS (VALUES " + ", ".join(f"(CAST({a} AS DOUBLE), {b}, {c}, CAST({d} AS DOUBLE), CAST({e} AS DOUBLE))" for a, b, c, d, e in GRID) + """), m AS (
  SELECT g.*, CASE WHEN h < h_sig AND share > s_sig AND total_papers > 5 THEN 's' WHEN h > h_univ AND total_papers > n_univ THEN 'u' WHEN h > h_sig AND h <= h_univ AND total_papers > n_cross THEN 'c' ELSE 'n' END AS k FROM cls, grid g)
SELECT h_univ, n_univ, n_cross, h_sig, s_sig, count(*) FILTER (k = 'u') AS universal, count(*) FILTER (k = 'c') AS cross_biome, count(*) FILTER (k = 's') AS signature, count(*) FILTER (k = 'n') AS niche FROM m GROUP BY ALL"""


def a7_inverted_index(spark, sf_dir):
    return P.inverted_index(event_facts(spark, sf_dir), "key", "env")


def a6_papers_by_key(spark, sf_dir):
    return occurrences(spark, sf_dir).groupBy("key").agg(F.countDistinct("paper").alias("n_papers"))


def _canonicals(spark, sf_dir):
    """Parts as canonicals: brand and type as slots (some null), prices as vectors."""
    p = load(spark, sf_dir, "part")
    return p.select(
        F.col("p_brand").alias("family"), F.col("p_type").alias("subtype"), F.when(F.col("p_size") % 7 == 0, None).otherwise(F.split("p_name", " ")[1]).alias("quantity_kind"),
        F.when(F.col("p_size") % 3 == 0, F.split("p_name", " ")[0]).otherwise("").alias("bag"), F.concat_ws("_", "p_name", "p_partkey").alias("name"), (F.col("p_partkey") % 97).alias("env_a"), (F.col("p_partkey") % 53).alias("env_b"), (F.col("p_partkey") % 97 + F.col("p_partkey") % 53).alias("total"),
    )


CANONICALS = "can AS (SELECT p_brand AS family, p_type AS subtype, CASE WHEN p_size % 7 = 0 THEN NULL ELSE split_part(p_name, ' ', 2) END AS quantity_kind, CASE WHEN p_size % 3 = 0 THEN split_part(p_name, ' ', 1) ELSE '' END AS bag, p_name || '_' || p_partkey AS name, p_partkey % 97 AS env_a, p_partkey % 53 AS env_b, p_partkey % 97 + p_partkey % 53 AS total FROM part)"


def a24_safety_net(spark, sf_dir):
    c = _canonicals(spark, sf_dir).withColumn("rank", F.col("total"))
    return P.merged_duplicates(c, ["family", "subtype", "quantity_kind", "bag"], ["env_a", "env_b", "total"], "rank", "name")


def a25_coarse_collapse(spark, sf_dir):
    c = _canonicals(spark, sf_dir).withColumn("rank", F.col("total"))
    return P.collapsed(c, ["family", "subtype", "quantity_kind"], ["env_a", "env_b", "total"], "rank", "name", "bag")


def m3_fisher_classify(spark, sf_dir):
    x = P.enriched(_customers(spark, sf_dir), ["MACHINERY", "BUILDING", "FURNITURE", "HOUSEHOLD"])
    return x.select("key", "total_papers", *[F.round(F.log10(f"p_{e}"), 5).alias(f"lp_{e}") for e in ("MACHINERY", "BUILDING")], F.round("e_MACHINERY", 6).alias("e_MACHINERY"), "n_present", "n_enriched", "basis", "category")


def _customers(spark, sf_dir):
    """Nations of customers as keys, market segments as environments."""
    return load(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey")).alias("key"), F.col("c_mktsegment").alias("env"), F.col("c_custkey").alias("paper"))


def _fisher_sql() -> str:
    envs = ["MACHINERY", "BUILDING", "FURNITURE", "HOUSEHOLD"]
    n = ", ".join(f"count(*) FILTER (env = '{e}') AS n_{e}" for e in envs)
    size = ", ".join(f"count(*) FILTER (env = '{e}') AS N_{e}_all" for e in envs)
    pct = {e: f"100.0 * n_{e} / N_{e}_all" for e in envs}
    mean = "(" + " + ".join(pct.values()) + ") / 4"
    p = {e: f"(SELECT sum(exp(fa.lf + fb.lf + fc.lf + fd.lf - fn.lf - f1.lf - f2.lf - f3.lf - f4.lf)) FROM range(n_{e}, least(total_papers, N_{e}_all) + 1) r(k), lfs fa, lfs fb, lfs fc, lfs fd, lfs fn, lfs f1, lfs f2, lfs f3, lfs f4 "
            f"WHERE fa.n = total_papers AND fb.n = papers_all - total_papers AND fc.n = N_{e}_all AND fd.n = papers_all - N_{e}_all AND fn.n = papers_all AND f1.n = k AND f2.n = total_papers - k AND f3.n = N_{e}_all - k AND f4.n = papers_all - N_{e}_all - total_papers + k)" for e in envs}
    ps = ", ".join(f"CASE WHEN n_{e} <= 0 THEN 1 ELSE least(1, {p[e]}) END AS p_{e}" for e in envs)
    es = ", ".join(f"({pct[e]}) / ({mean}) AS e_{e}" for e in envs)
    present = " + ".join(f"CAST(n_{e} >= 5 AND {pct[e]} >= 0.5 AS INT)" for e in envs)
    return f"""WITH f AS (SELECT DISTINCT 'n' || c_nationkey AS key, c_mktsegment AS env, c_custkey AS paper FROM customer), g AS (SELECT * FROM f WHERE env IN ({', '.join(repr(e) for e in envs)})),
 s AS (SELECT {size} FROM (SELECT DISTINCT env, paper FROM g)), t AS (SELECT count(DISTINCT paper) AS papers_all FROM f),
 lfs AS (SELECT n, sum(CASE WHEN n > 0 THEN ln(n) ELSE 0 END) OVER (ORDER BY n) AS lf FROM (SELECT unnest(range(0, (SELECT papers_all FROM t) + 1)) AS n)),
 c AS (SELECT key, {n}, count(*) AS total_papers FROM g GROUP BY key), x AS (SELECT c.*, s.*, t.* FROM c, s, t), y AS (SELECT *, {ps}, {es}, {present} AS n_present FROM x),
 z AS (SELECT *, {' + '.join(f'CAST(p_{e} < 0.05 AND e_{e} >= 2 AS INT)' for e in envs)} AS n_enriched FROM y)
SELECT key, total_papers, round(log10(p_MACHINERY), 5) AS lp_MACHINERY, round(log10(p_BUILDING), 5) AS lp_BUILDING, round(e_MACHINERY, 6) AS e_MACHINERY, n_present, n_enriched,
 CASE WHEN n_enriched > 0 THEN 'enrichment' ELSE 'count' END AS basis,
 CASE WHEN CASE WHEN n_enriched > 0 THEN n_enriched ELSE greatest(1, n_present) END >= 3 THEN 'Universal' WHEN CASE WHEN n_enriched > 0 THEN n_enriched ELSE greatest(1, n_present) END = 2 THEN 'Shared' ELSE 'Signature' END AS category
FROM z WHERE n_present > 0"""


def a20_tiering(spark, sf_dir):
    f = occurrences(spark, sf_dir).groupBy("key").agg(F.countDistinct("paper").alias("n_papers"))
    mapped = f.withColumn("slot", F.when(F.col("n_papers") >= 100, F.concat(F.lit("slot_"), F.col("key"))))
    return P.tiers(mapped, "n_papers", "slot", F.length("key") > 15).groupBy("tier").agg(F.count("*").alias("n_fields"), F.sum("n_papers").alias("papers"))


def a36_dominant_env(spark, sf_dir):
    return P.dominant_vote(event_facts(spark, sf_dir).withColumn("paper", F.col("paper").cast("string")), "paper", "env", "ord", "e3")


def a37_size_stats(spark, sf_dir):
    return P.group_sizes(occurrences(spark, sf_dir).select("key", "paper").distinct(), "key")


def a9_token_df(spark, sf_dir):
    p = load(spark, sf_dir, "part").select(F.concat_ws("_", "p_name", "p_partkey").alias("key"), F.concat(F.split("p_name", " "), F.array(F.lower("p_type"), F.lower("p_brand"))).alias("tokens"))
    return P.document_frequency(p, F.col("tokens"))


def _documents_as_keys(spark, sf_dir):
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0)).alias("tokens"))


DOC_TOKENS = "d AS (SELECT doc_id AS key, regexp_extract_all(lower(text), '[a-z]{2,}') AS tokens FROM documents), e AS (SELECT DISTINCT key, unnest(tokens) AS token FROM d), f AS (SELECT token, count(*) AS df FROM e GROUP BY token), b AS (SELECT key, max(df) AS df FROM e JOIN f USING (token) GROUP BY key)"
TAUS = [1, 5, 20, 50, 100, 200, 400, 600]


def a10_coverage_curve(spark, sf_dir):
    x = P.coverage_curve(_documents_as_keys(spark, sf_dir), F.col("tokens"), TAUS)
    return x.withColumn("coverage", F.round("coverage", 6))


def a11_headwords(spark, sf_dir):
    return P.headword_threshold(_documents_as_keys(spark, sf_dir), F.col("tokens"), 0.95)


def a13_df_hist(spark, sf_dir):
    df = P.document_frequency(_documents_as_keys(spark, sf_dir), F.col("tokens"))
    bucket = F.when(F.col("df") == 1, "1").when(F.col("df") <= 5, "2-5").when(F.col("df") <= 20, "6-20").when(F.col("df") <= 100, "21-100").when(F.col("df") <= 500, "101-500").otherwise(">=501")
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n_tokens"), F.sum("df").alias("df"))


def a31_cumulative_rounds(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("target"), F.dayofmonth("ts").alias("round"))
    return P.first_seen_rounds(e, "target", "round")


def w11_saturation(spark, sf_dir):
    return P.saturated(a31_cumulative_rounds(spark, sf_dir), "round", {"n_new": "n_total"})


def a33_cells(spark, sf_dir):
    o = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    base = o.select(F.col("c_mktsegment").alias("env"), F.substring("o_orderpriority", 1, 1).alias("tier"), F.when(F.year("o_orderdate") <= 1996, "early").when(F.year("o_orderdate") <= 1998, "middle").otherwise("late").alias("era"))
    return base.groupingSets([["env", "tier", "era"], ["env", "tier"]], "env", "tier", "era").agg(F.count("*").alias("n")).select("env", "tier", "era", "n")


def a46_env_distribution(spark, sf_dir):
    e = event_facts(spark, sf_dir).groupBy("paper").agg(F.collect_set("env").alias("envs"))
    return e.agg(F.count("*").alias("n_papers"), F.count_if(F.size("envs") > 1).alias("n_multi"), F.count_if(F.array_contains("envs", "e0")).alias("n_e0"), F.count_if(F.size("envs") == 1).alias("n_single"))


def a16_single_env(spark, sf_dir):
    e = occurrences(spark, sf_dir).groupBy("key").agg(F.countDistinct("env").alias("n"), F.min("env").alias("env"))
    return e.filter("n = 1").groupBy("env").agg(F.count("*").alias("n_keys"))


def a43_histogram2d(spark, sf_dir):
    p = load(spark, sf_dir, "part").select(F.width_bucket("p_size", F.lit(0), F.lit(51), F.lit(10)).alias("x"), F.floor((F.col("p_retailprice") - 900) / 100).alias("y"), F.col("p_type").alias("family"))
    cell = p.groupBy("x", "y", "family").agg(F.count("*").alias("n")).groupBy("x", "y").agg(F.sum("n").alias("total"), F.min_by("family", F.struct(-F.col("n"), F.col("family"))).alias("family"), F.max("n").alias("most"))
    return cell.select("x", "y", "total", F.when(F.col("most") * 2 >= F.col("total"), F.col("family")).otherwise("mixed").alias("family"))


def a44_crosstab(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    types = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    return p.groupBy("p_brand").agg(*[F.count_if(F.col("p_type") == t).alias(t.lower()) for t in types])


def a28_eval_metrics(spark, sf_dir):
    lab = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").withColumn("predicted", (F.col("n_chars") > 1500).cast("int"))
    return lab.agg(F.count("*").alias("n"), F.round(100 * F.avg(F.when(F.col("quality") == 1, F.col("predicted"))), 4).alias("recall_keep"), F.round(100 - 100 * F.avg(F.when(F.col("quality") == 1, F.col("predicted"))), 4).alias("false_negative"), F.round(100 * F.avg((F.col("quality") == F.col("predicted")).cast("int")), 4).alias("accuracy"))


def a29_tries_success(spark, sf_dir):
    o = load(spark, sf_dir, "lineitem")
    tries = o.groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("tries"))
    good = o.filter("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("successes"))
    return tries.join(good, "l_suppkey", "full_outer").select("l_suppkey", F.coalesce("tries", F.lit(0)).alias("tries"), F.coalesce("successes", F.lit(0)).alias("successes"), F.round(F.coalesce("successes", F.lit(0)) / F.col("tries"), 4).alias("rate"))


def v2_threshold_heatmap(spark, sf_dir):
    g = a26_threshold_grid(spark, sf_dir).filter("n_cross = 30 AND h_sig = 0.4 AND s_sig = 0.7")
    return g.groupBy("h_univ").agg(*[F.max(F.when(F.col("n_univ") == n, F.col("universal"))).alias(f"n{n}") for n in (20, 50)])


QUERIES = {f.__name__: f for f in (
    flagship_env_entropy, a1_pivot_distinct, a2_stats, f15_split_coverage, m2_category_counts, a26_threshold_grid, a7_inverted_index, a6_papers_by_key, a24_safety_net, a25_coarse_collapse, m3_fisher_classify,
    a20_tiering, a36_dominant_env, a37_size_stats, a9_token_df, a10_coverage_curve, a11_headwords, a13_df_hist, a31_cumulative_rounds, w11_saturation, a33_cells, a46_env_distribution, a16_single_env, a43_histogram2d, a44_crosstab,
    a28_eval_metrics, a29_tries_success, v2_threshold_heatmap,
)}
ROUNDS = "e AS (SELECT user_id AS target, day(ts) AS round FROM events), fst AS (SELECT target, min(round) AS round FROM e GROUP BY target), r AS (SELECT round, (SELECT count(*) FROM fst WHERE fst.round = x.round) AS n_new FROM (SELECT DISTINCT round FROM e) x), cum AS (SELECT round, n_new, CAST(sum(n_new) OVER (ORDER BY round) AS BIGINT) AS n_total FROM r)"
SQL = {
    "a1_pivot_distinct": "WITH " + VECTORS + " SELECT key, env_en, env_fr, env_de, env_es, total_papers, n_envs_present FROM vec",
    "flagship_env_entropy": "WITH " + VECTORS + " SELECT key, env_en, env_fr, env_de, env_es, total_papers, round(h, 6) AS h_norm, dominant_env, round(share, 6) AS dominant_share, category FROM cls",
    "a2_stats": "WITH " + VECTORS + " SELECT count(*) AS n_keys, count(*) FILTER (total_papers >= 3) AS n_ge3, count(*) FILTER (total_papers >= 10) AS n_ge10, " + ", ".join(f"count(*) FILTER (n_envs_present = {i}) AS n_in_{i}" for i in (1, 2, 3, 4)) + ", " + ", ".join(f"CAST(sum(env_{e}) AS BIGINT) AS sum_{e}" for e in LANGS) + " FROM vec",
    "f15_split_coverage": "WITH " + VECTORS + " SELECT CASE WHEN total_papers >= 3 THEN 'mainstream' ELSE 'orphan' END AS part, count(*) AS n_keys, CAST(sum(total_papers) AS BIGINT) AS papers FROM vec GROUP BY 1",
    "m2_category_counts": "WITH " + VECTORS + " SELECT category, dominant_env, count(*) AS n FROM cls GROUP BY ALL",
    "a26_threshold_grid": A26,
    "v2_threshold_heatmap": "SELECT h_univ, max(universal) FILTER (n_univ = 20) AS n20, max(universal) FILTER (n_univ = 50) AS n50 FROM (" + A26 + ") WHERE n_cross = 30 AND h_sig = 0.4 AND s_sig = 0.7 GROUP BY 1",
    "a7_inverted_index": "WITH " + EVENT_FACTS + " SELECT key, env, count(DISTINCT paper) AS n_papers, array_to_string(list_sort(list_distinct(list(CAST(paper AS VARCHAR)))), ' ') AS papers FROM facts GROUP BY ALL",
    "a6_papers_by_key": "WITH " + OCCURRENCES + " SELECT key, count(DISTINCT paper) AS n_papers FROM occ GROUP BY key",
    "a24_safety_net": "WITH " + CANONICALS + " SELECT family, subtype, quantity_kind, bag, CAST(sum(env_a) AS BIGINT) AS env_a, CAST(sum(env_b) AS BIGINT) AS env_b, CAST(sum(total) AS BIGINT) AS total, count(*) AS n_merged, first(name ORDER BY total DESC, name) AS name FROM can GROUP BY ALL",
    "a25_coarse_collapse": "WITH " + CANONICALS + " SELECT family, subtype, quantity_kind, CAST(sum(env_a) AS BIGINT) AS env_a, CAST(sum(env_b) AS BIGINT) AS env_b, CAST(sum(total) AS BIGINT) AS total, first(name ORDER BY total DESC, name) AS name, array_to_string(list_sort(list_distinct(list(CASE WHEN trim(bag) = '' THEN '(empty)' ELSE bag END))), '|') AS variants FROM can WHERE family IS NOT NULL AND subtype IS NOT NULL AND quantity_kind IS NOT NULL GROUP BY family, subtype, quantity_kind",
    "m3_fisher_classify": _fisher_sql(),
    "a20_tiering": "WITH " + OCCURRENCES + ", f AS (SELECT key, count(DISTINCT paper) AS n FROM occ GROUP BY key) SELECT CASE WHEN n >= 100 THEN 1 WHEN length(key) > 15 THEN 0 WHEN n >= 3 THEN 2 ELSE 3 END AS tier, count(*) AS n_fields, CAST(sum(n) AS BIGINT) AS papers FROM f GROUP BY 1",
    "a36_dominant_env": "WITH " + EVENT_FACTS + ", c AS (SELECT CAST(paper AS VARCHAR) AS paper, env, count(*) AS n, min(ord) AS o FROM facts WHERE env <> 'e3' GROUP BY ALL), p AS (SELECT DISTINCT CAST(paper AS VARCHAR) AS paper FROM facts) SELECT p.paper, coalesce(first(env ORDER BY n DESC, o), 'unknown') AS dominant FROM p LEFT JOIN c USING (paper) GROUP BY p.paper",
    "a37_size_stats": "WITH " + OCCURRENCES + ", s AS (SELECT list_sort(list(n)) AS l FROM (SELECT count(DISTINCT paper) AS n FROM occ GROUP BY key)) SELECT CAST(len(l) AS BIGINT) AS n_groups, l[1] AS least, l[len(l) // 2 + 1] AS p50, l[CAST(floor(len(l) * 0.9) AS BIGINT) + 1] AS p90, l[CAST(floor(len(l) * 0.99) AS BIGINT) + 1] AS p99, l[len(l)] AS most FROM s",
    "a9_token_df": "SELECT token, count(*) AS df FROM (SELECT DISTINCT p_name, p_partkey, unnest(list_concat(string_split(p_name, ' '), [lower(p_type), lower(p_brand)])) AS token FROM part) GROUP BY token",
    "a10_coverage_curve": "WITH " + DOC_TOKENS + ", t(tau) AS (VALUES " + ", ".join(f"({t})" for t in TAUS) + ") SELECT tau, (SELECT count(*) FROM b WHERE b.df >= tau) AS n_keys, (SELECT count(*) FROM f WHERE f.df >= tau) AS n_headwords, round((SELECT count(*) FROM b WHERE b.df >= tau) / (SELECT count(*) FROM b), 6) AS coverage FROM t",
    "a11_headwords": "WITH " + DOC_TOKENS + ", s AS (SELECT df, (SELECT count(*) FROM b b2 WHERE b2.df >= x.df) / (SELECT count(*) FROM b) AS coverage FROM (SELECT DISTINCT df FROM b) x) SELECT coalesce(max(df) FILTER (coverage >= 0.95), min(df)) AS tau FROM s",
    "a13_df_hist": "WITH " + DOC_TOKENS + " SELECT CASE WHEN df = 1 THEN '1' WHEN df <= 5 THEN '2-5' WHEN df <= 20 THEN '6-20' WHEN df <= 100 THEN '21-100' WHEN df <= 500 THEN '101-500' ELSE '>=501' END AS bucket, count(*) AS n_tokens, CAST(sum(df) AS BIGINT) AS df FROM f GROUP BY 1",
    "a31_cumulative_rounds": "WITH " + ROUNDS + " SELECT round, n_new, n_total FROM cum",
    "w11_saturation": "WITH " + ROUNDS + " SELECT count(*) AS n_rounds, count(*) >= 3 AND coalesce(bool_and(n_new / greatest(n_total, 1) < 0.05) FILTER (age <= 2), false) AS saturated FROM (SELECT *, row_number() OVER (ORDER BY round DESC) AS age FROM cum)",
    "a33_cells": "WITH b AS (SELECT c_mktsegment AS env, substr(o_orderpriority, 1, 1) AS tier, CASE WHEN year(o_orderdate) <= 1996 THEN 'early' WHEN year(o_orderdate) <= 1998 THEN 'middle' ELSE 'late' END AS era FROM orders JOIN customer ON o_custkey = c_custkey) SELECT env, tier, era, count(*) AS n FROM b GROUP BY GROUPING SETS ((env, tier, era), (env, tier))",
    "a46_env_distribution": "WITH " + EVENT_FACTS + ", e AS (SELECT paper, list_distinct(list(env)) AS envs FROM facts GROUP BY paper) SELECT count(*) AS n_papers, count(*) FILTER (len(envs) > 1) AS n_multi, count(*) FILTER (list_contains(envs, 'e0')) AS n_e0, count(*) FILTER (len(envs) = 1) AS n_single FROM e",
    "a16_single_env": "WITH " + OCCURRENCES + " SELECT env, count(*) AS n_keys FROM (SELECT key, min(env) AS env FROM occ GROUP BY key HAVING count(DISTINCT env) = 1) GROUP BY env",
    "a43_histogram2d": "WITH p AS (SELECT CAST(floor(p_size / 5.1) AS BIGINT) + 1 AS x, CAST(floor((p_retailprice - 900) / 100) AS BIGINT) AS y, p_type AS family FROM part), c AS (SELECT x, y, family, count(*) AS n FROM p GROUP BY ALL) SELECT x, y, CAST(sum(n) AS BIGINT) AS total, CASE WHEN max(n) * 2 >= sum(n) THEN first(family ORDER BY n DESC, family) ELSE 'mixed' END AS family FROM c GROUP BY x, y",
    "a44_crosstab": "SELECT p_brand, " + ", ".join(f"count(*) FILTER (p_type = '{t}') AS {t.lower()}" for t in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")) + " FROM part GROUP BY p_brand",
    "a28_eval_metrics": "WITH l AS (SELECT quality, CAST(n_chars > 1500 AS INT) AS predicted FROM labels JOIN documents USING (doc_id)) SELECT count(*) AS n, round(100 * avg(predicted) FILTER (quality = 1), 4) AS recall_keep, round(100 - 100 * avg(predicted) FILTER (quality = 1), 4) AS false_negative, round(100 * avg(CAST(quality = predicted AS INT)), 4) AS accuracy FROM l",
    "a29_tries_success": "SELECT l_suppkey, count(DISTINCT l_orderkey) AS tries, count(DISTINCT l_orderkey) FILTER (l_returnflag = 'R') AS successes, round(count(DISTINCT l_orderkey) FILTER (l_returnflag = 'R') / count(DISTINCT l_orderkey), 4) AS rate FROM lineitem GROUP BY l_suppkey",
}
