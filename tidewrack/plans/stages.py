"""Further pieces of the stages: discovery, identities, target rendering, curation of canonicals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewrack.functions import text as T
from tidewrack.operators import graph as G
from tidewrack.operators import profile as P
from tidewrack.operators import ranking as R
from tidewrack.operators.matching import overlap_join
from tidewrack.plans.profiles import DOC_TOKENS, _documents_as_keys
from tidewrack.plans.proxies import EVENT_FACTS, event_facts, load

TARGETS = [0.5, 0.8, 0.9, 0.95, 0.99]


def a12_sensitivity(spark, sf_dir):
    """Thresholds of several coverage targets from one histogram."""
    k = _documents_as_keys(spark, sf_dir)
    df = P.document_frequency(k, F.col("tokens"))
    best = k.select("key", F.explode(F.array_distinct("tokens")).alias("token")).join(df, "token").groupBy("key").agg(F.max("df").alias("df"))
    hist = best.groupBy("df").agg(F.count("*").alias("n"))
    share = hist.select("df", (F.sum("n").over(Window.orderBy(F.col("df").desc())) / F.sum("n").over(Window.partitionBy())).alias("c"))
    picks = F.array(*[F.struct(F.lit(t).alias("target"), F.coalesce(F.max(F.when(F.col("c") >= t, F.col("df"))), F.min("df")).alias("tau")) for t in TARGETS])
    return share.agg(picks.alias("x")).select(F.inline("x"))


def a14_non_headwords(spark, sf_dir):
    df = P.document_frequency(_documents_as_keys(spark, sf_dir), F.col("tokens"))
    return df.agg(F.count_if(F.col("df") < 20).alias("n_below"), F.count_if(F.col("df") == 1).alias("n_once"), F.max(F.when(F.col("df") < 20, F.col("df"))).alias("most"))


def x7_orphan_keys(spark, sf_dir):
    """Keys without a head word, by their number of tokens."""
    from tidewrack.plans.scalars import _names

    d = _names(spark, sf_dir).select("name", T.root_tokens(T.decompose(F.col("name"))["root"]).alias("tokens")).distinct()
    heads = d.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").count().filter("count >= 450").select("token")
    covered = d.select("name", F.explode("tokens").alias("token")).join(heads, "token", "left_semi").select("name").distinct()
    left = d.join(covered, "name", "left_anti")
    return left.groupBy(F.least(F.size("tokens"), F.lit(6)).alias("n_tokens")).agg(F.count("*").alias("n"), F.min("name").alias("first"))


def a23_canonical_assembly(spark, sf_dir):
    """Names of a brand that share their last word are one canonical: vectors summed, metrics recomputed."""
    from tidewrack.functions import stats

    p = load(spark, sf_dir, "part").select("p_brand", F.split("p_name", " ")[1].alias("component"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), (F.col("p_partkey") % 50).alias("a"), (F.col("p_size") % 20).alias("b"))
    g = p.groupBy("p_brand", "component").agg(F.sum("a").alias("env_a"), F.sum("b").cast("bigint").alias("env_b"), F.countDistinct("name").alias("n_members"), F.array_join(F.array_sort(F.collect_set("name")), "|").alias("members"))
    h = stats.entropy([F.col("env_a"), F.col("env_b")])
    return g.withColumn("h_norm", F.round(h, 6))


def w8_candidates(spark, sf_dir):
    """Up to three candidates of each type by shared words, then name."""
    p = load(spark, sf_dir, "part")
    a = p.groupBy(F.col("p_type").alias("key")).agg(F.collect_set(F.split("p_name", " ")[0]).alias("t"))
    b = p.select(F.col("p_name").alias("canonical")).distinct()
    x = a.select("key", F.explode("t").alias("token")).join(b.select("canonical", F.explode(F.split("canonical", " ")).alias("token")), "token")
    s = x.groupBy("key", "canonical").agg(F.count("*").alias("shared"))
    return R.top(s, ["key"], [F.col("shared").desc(), F.col("canonical")], 3).select("key", "canonical", "rn")


def w5d_tiered_evidence(spark, sf_dir):
    """One row of a paper for a key over all tiers, the first to arrive; then by tier, two of each key."""
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("paper"), F.col("event_id").alias("ord"), T.section_tier(F.when(F.col("event_id") % 3 == 0, "Methods").when(F.col("event_id") % 3 == 1, "Intro").otherwise("other")).alias("tier"))
    first = R.top(e, ["key", "paper"], [F.col("ord")], 1).drop("rn")
    return R.top(first, ["key"], [F.col("tier"), F.col("ord")], 2).select("key", "paper", "tier", "ord")


def j9_label_matching(spark, sf_dir):
    """Labels to names: exact, else in lower case, else by shared words."""
    p = load(spark, sf_dir, "part")
    names = p.groupBy("p_name").agg(F.min("p_partkey").alias("acc"))
    labels = p.select(F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.upper("p_name")).otherwise(F.concat(F.lit("big "), "p_name")).alias("label")).union(p.select("p_brand")).distinct()
    exact = labels.join(names.select(F.col("p_name").alias("label"), F.col("acc").alias("a")), "label", "left")
    low = exact.join(names.groupBy(F.lower("p_name").alias("k")).agg(F.min("acc").alias("b")), F.lower("label") == F.col("k"), "left").drop("k")
    fuzzy = overlap_join(labels.withColumn("t", F.split(F.lower("label"), " ")), names.select("acc", F.split(F.lower("p_name"), " ").alias("t")), "label", "acc", "t", 0.5).select("label", F.col("acc").alias("c"))
    return low.join(fuzzy, "label", "left").select("label", F.coalesce("a", "b", "c").alias("acc"), F.when(F.col("a").isNotNull(), "exact").when(F.col("b").isNotNull(), "case").when(F.col("c").isNotNull(), "fuzzy").otherwise("none").alias("how"))


def j7_skeleton(spark, sf_dir):
    """Customers as samples with their nation; nations gather the names of a few of them, and alias priority."""
    c, n = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    x = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    few = R.top(x, ["n_name"], [F.col("c_name")], 10).groupBy("n_name").agg(F.array_join(F.array_sort(F.collect_list("c_name")), ";").alias("hints"))
    sizes = x.groupBy("n_name").agg(F.count("*").alias("n"))
    return sizes.join(few, "n_name")


def j16_target_pool(spark, sf_dir):
    """Papers of a target that also have a year and an accession."""
    o, li = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    pool = o.filter("year(o_orderdate) >= 1997").select(F.col("o_orderkey").alias("pmid")).join(li.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("pmid")).distinct(), "pmid", "left_semi")
    target = li.select(F.col("l_orderkey").alias("pmid"), F.col("l_linestatus").alias("target")).distinct()
    return target.join(pool, "pmid").groupBy("target").agg(F.count("*").alias("n"))


def j23_traceability(spark, sf_dir):
    """Part to brand to region of its suppliers, with the reason where the chain ends."""
    p, li, s, n = (load(spark, sf_dir, t) for t in ("part", "lineitem", "supplier", "nation"))
    first = li.groupBy("l_partkey").agg(F.min("l_suppkey").alias("s"))
    x = p.join(first, F.col("p_partkey") == F.col("l_partkey"), "left").join(s.filter("s_acctbal > 0"), F.col("s") == F.col("s_suppkey"), "left").join(n.filter("n_regionkey < 4"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    reason = F.when(F.col("s").isNull(), "no supplier").when(F.col("s_suppkey").isNull(), "supplier dropped").when(F.col("n_nationkey").isNull(), "nation dropped").otherwise("kept")
    return x.groupBy("p_brand", reason.alias("reason")).agg(F.count("*").alias("n"))


def j24_alias_union(spark, sf_dir):
    """Aliases of a type from three sources, its own name left out."""
    p = load(spark, sf_dir, "part")
    a = p.select("p_type", F.split("p_name", " ")[0].alias("alias")).union(p.select("p_type", F.lower("p_brand"))).union(p.select("p_type", F.col("p_type")))
    kept = a.select("p_type", T.alias(F.col("alias"), F.col("p_type")).alias("alias")).filter("alias IS NOT NULL")
    return kept.groupBy("p_type").agg(F.count_distinct("alias").alias("n"), F.array_join(F.array_sort(F.collect_set("alias")), ",").alias("aliases"))


def j26_missing_syntax(spark, sf_dir):
    """Targets with and without a syntax; merged with suggestions."""
    p = load(spark, sf_dir, "part")
    targets = p.select("p_brand", "p_type").distinct()
    syntax = p.groupBy("p_brand", F.when(F.col("p_size") <= 45, F.lower("p_type")).otherwise(F.col("p_type")).alias("p_type")).agg(F.min("p_name").alias("syntax"))
    auto = targets.join(syntax, ["p_brand", "p_type"], "left")
    suggested = auto.filter("syntax IS NULL").select("p_brand", "p_type", F.lit("suggested").alias("syntax"))
    merged = auto.filter("syntax IS NOT NULL").unionByName(suggested)
    return merged.groupBy("p_brand").agg(F.count_if(F.col("syntax") == "suggested").alias("n_suggested"), F.count("*").alias("n"))


def f16_tristate_split(spark, sf_dir):
    """F16: kept only where true; null counts as excluded."""
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("keep")), "doc_id", "left")
    return d.groupBy(F.col("keep").eqNullSafe(F.lit(True)).alias("kept"), F.col("keep").isNull().alias("unknown")).agg(F.count("*").alias("n"))


def f9_routing(spark, sf_dir):
    """table-like or long texts give a head of 3000 characters, others whole."""
    from tidewrack.functions import names as N

    d = load(spark, sf_dir, "documents")
    head = N.is_table_like(F.when(F.col("doc_id") % 10 == 0, "table").otherwise("RESULTS"), F.concat("source", F.lit(".txt"))) | (F.length("text") > 5000)
    return d.groupBy(head.alias("head")).agg(F.count("*").alias("n"), F.sum(F.length(F.when(head, F.left("text", F.lit(3000))).otherwise(F.col("text")))).alias("chars"))


def f20_frequency_gate(spark, sf_dir):
    """words in at least 30 documents, without an exclusion list."""
    k = P.document_frequency(_documents_as_keys(spark, sf_dir), F.col("tokens")).filter("df >= 30")
    drop = load(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("token")).distinct()
    return k.join(drop, "token", "left_anti").agg(F.count("*").alias("n"), F.sum("df").alias("df"))


def f22_giant_tables(spark, sf_dir):
    """F22, TP2: orders of more than six lines are giant; their rows go, others stay."""
    li = load(spark, sf_dir, "lineitem")
    giant = li.groupBy("l_orderkey").count().filter("count > 6").select("l_orderkey")
    return li.join(giant, "l_orderkey", "left_anti").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("n_orders"))


def r7_slot_correction(spark, sf_dir):
    """Unknown families become D_other, subtypes fall back, bags are sorted and kept for family A only."""
    p = load(spark, sf_dir, "part")
    family = F.when(F.col("p_brand").isin("Brand#1", "Brand#2"), "A").when(F.col("p_size") > 25, "B").otherwise("weird")
    fixed = F.when(family.isin("A", "B"), family).otherwise("D_other")
    bag = F.when(fixed == "A", F.array_join(F.array_sort(F.array_distinct(F.split("p_name", " "))), "|")).otherwise("")
    return p.groupBy(fixed.alias("family"), F.when(F.col("p_type").isin("SMALL", "LARGE"), F.col("p_type")).otherwise("other").alias("subtype"), bag.alias("bag")).agg(F.count("*").alias("n"))


def r11_nested_targets(spark, sf_dir):
    """R11, SNK9, A21: fields of each environment nested and read back; percentages by environment."""
    f = event_facts(spark, sf_dir).groupBy("env", "key").agg(F.countDistinct("paper").alias("n"))
    nested = f.groupBy("env").agg(F.array_sort(F.collect_list(F.struct("key", "n"))).alias("fields"))
    again = nested.select("env", F.posexplode("fields").alias("pos", "x")).select("env", "pos", "x.*")
    return again.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("env")), 2))


def g3_signature_merge(spark, sf_dir):
    """Components of equal signature are joined by edges."""
    p = load(spark, sf_dir, "part").select((F.col("p_partkey") % 300).alias("c"), F.col("p_partkey").alias("m"), F.filter(F.split("p_name", " "), lambda t: ~t.isin("small", "red")).alias("core"))
    return G.signature_edges(p, "c", "m", "core").agg(F.count("*").alias("n"), F.countDistinct("a").alias("n_heads"))


def g5_pair_proposals(spark, sf_dir):
    """Pairs of components of a bucket, at least one of them single, where a bucket has few enough of them."""
    c = load(spark, sf_dir, "customer").groupBy("c_nationkey", F.floor(F.col("c_acctbal") / 50).alias("part")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("k"))
    a, b = c.select("c_nationkey", F.col("k").alias("a"), F.col("n").alias("na")), c.select("c_nationkey", F.col("k").alias("b"), F.col("n").alias("nb"))
    return a.join(b, "c_nationkey").filter("a < b AND (na = 1 OR nb = 1)").select("c_nationkey", "a", "b")


def g6_rule_layer(spark, sf_dir):
    """Quantity kinds joined to those that are their literal variants, by component."""
    from tidewrack.plans.scalars import _names

    k = _names(spark, sf_dir).select(F.col("name").alias("node")).distinct()
    edges = k.select(F.col("node").alias("a"), F.explode(T.qk_variants(F.col("node"))).alias("b")).join(k.select(F.col("node").alias("b")), "b", "left_semi")
    return G.components(k, edges.select("a", "b")).groupBy("component").agg(F.count("*").alias("n")).filter("n > 1")


def sm6_cells(spark, sf_dir):
    """A32, SM6, X26: papers in the cells of their list dimensions."""
    e = event_facts(spark, sf_dir).groupBy("paper").agg(F.collect_set("env").alias("envs"), F.collect_set("key").alias("keys"))
    return e.select("paper", F.explode("envs").alias("env"), "keys").select("paper", "env", F.explode("keys").alias("key")).groupBy("env", "key").agg(F.count("*").alias("n"))


def c4_merge_targets(spark, sf_dir):
    """Manual merges over chains, vectors summed at the host, metrics again."""
    from tidewrack.functions import stats

    f = event_facts(spark, sf_dir)
    v = P.env_vectors(f, ["e0", "e1", "e2", "e3"])
    rules = spark.createDataFrame([("click", "view"), ("view", "signup")], "s string, t string")
    host = G.compressed(rules, "s", "t").withColumnRenamed("s", "key")
    cols = [f"env_e{i}" for i in range(4)]
    m = v.join(F.broadcast(host), "key", "left").groupBy(F.coalesce("t", "key").alias("key")).agg(*[F.sum(c).alias(c) for c in cols])
    return m.withColumn("h_norm", F.round(stats.entropy([F.col(c) for c in cols]), 6))


def x25_paper_keys(spark, sf_dir):
    """Distinct normalised keys of each paper, counted."""
    from tidewrack.plans.proxies import parts

    li = load(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    k = parts(spark, sf_dir).select("p_partkey", T.key_joined(F.col("raw")).alias("key"))
    x = li.join(k, "p_partkey").select("l_orderkey", "key").distinct()
    return x.agg(F.count("*").alias("n_occurrences"), F.countDistinct("l_orderkey").alias("n_papers"), F.countDistinct("key").alias("n_keys"))


def x35_target_fallback(spark, sf_dir):
    """A nation's big suppliers; without one, all of its region's."""
    s, n = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "nation")
    x = n.join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    own = x.groupBy("n_nationkey", "n_regionkey").agg(F.array_sort(F.collect_set(F.when(F.col("s_acctbal") > 5000, F.col("s_name")))).alias("own"))
    region = x.groupBy("n_regionkey").agg(F.array_sort(F.collect_set("s_name")).alias("all"))
    return own.join(region, "n_regionkey").select("n_nationkey", F.size(F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("all"))).alias("n"), (F.size("own") > 0).alias("is_own"))


QUERIES = {f.__name__: f for f in (
    a12_sensitivity, a14_non_headwords, x7_orphan_keys, a23_canonical_assembly, w8_candidates, w5d_tiered_evidence, j9_label_matching, j7_skeleton, j16_target_pool, j23_traceability, j24_alias_union, j26_missing_syntax, f16_tristate_split, f9_routing, f20_frequency_gate,
    f22_giant_tables, r7_slot_correction, r11_nested_targets, g3_signature_merge, g5_pair_proposals, g6_rule_layer, sm6_cells, c4_merge_targets, x25_paper_keys, x35_target_fallback,
)}


def _sql() -> dict[str, str]:
    from tidewrack.constants import STOPWORDS
    from tidewrack.plans.proxies import PARTS
    from tidewrack.plans.scalars import SQL as SCALARS

    head, tail = SCALARS["t7_decompose"].rsplit(" SELECT p_partkey, root", 1)
    dd = head + ", dd AS MATERIALIZED (SELECT p_partkey, root" + tail + ")"
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    h2 = lambda cols: "-(" + " + ".join(f"CASE WHEN {c} > 0 THEN {c} / ({' + '.join(cols)}) * ln({c} / ({' + '.join(cols)})) ELSE 0 END" for c in cols) + f") / ln({len(cols)})"
    envs = [f"env_e{i}" for i in range(4)]
    return {
        "a12_sensitivity": "WITH " + DOC_TOKENS + ", s AS (SELECT df, (SELECT count(*) FROM b b2 WHERE b2.df >= x.df) / (SELECT count(*) FROM b) AS c FROM (SELECT DISTINCT df FROM b) x), t(target) AS (VALUES " + ", ".join(f"(CAST({t} AS DOUBLE))" for t in TARGETS) + ") SELECT target, coalesce(max(df) FILTER (c >= target), min(df)) AS tau FROM s, t GROUP BY target",
        "a14_non_headwords": "WITH " + DOC_TOKENS + " SELECT count(*) FILTER (df < 20) AS n_below, count(*) FILTER (df = 1) AS n_once, max(df) FILTER (df < 20) AS most FROM f",
        "x7_orphan_keys": dd + f", d AS (SELECT DISTINCT name, list_filter(string_split(root, '_'), lambda t: t <> '' AND t NOT IN ({stop})) AS tokens FROM dd JOIN names USING (p_partkey)), e AS (SELECT name, unnest(tokens) AS token FROM d), h AS (SELECT token FROM (SELECT DISTINCT name, token FROM e) GROUP BY token HAVING count(*) >= 450) SELECT least(len(tokens), 6) AS n_tokens, count(*) AS n, min(name) AS first FROM d WHERE name NOT IN (SELECT name FROM e JOIN h USING (token)) GROUP BY 1",
        "a23_canonical_assembly": "WITH g AS (SELECT p_brand, split_part(p_name, ' ', 2) AS component, CAST(sum(p_partkey % 50) AS BIGINT) AS env_a, CAST(sum(p_size % 20) AS BIGINT) AS env_b, count(DISTINCT p_name) AS n_members, array_to_string(list_sort(list_distinct(list(replace(p_name, ' ', '_')))), '|') AS members FROM part GROUP BY ALL) SELECT *, round(CASE WHEN env_a + env_b > 0 THEN " + h2(["env_a", "env_b"]) + " ELSE 0 END, 6) AS h_norm FROM g",
        "w8_candidates": "WITH a AS (SELECT DISTINCT p_type AS key, split_part(p_name, ' ', 1) AS token FROM part), b AS (SELECT canonical, unnest(string_split(canonical, ' ')) AS token FROM (SELECT DISTINCT p_name AS canonical FROM part)), s AS (SELECT key, canonical, count(*) AS shared FROM a JOIN b USING (token) GROUP BY ALL) SELECT key, canonical, rn FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY shared DESC, canonical) AS rn FROM s) WHERE rn <= 3",
        "w5d_tiered_evidence": "WITH e AS (SELECT event_type AS key, user_id AS paper, event_id AS ord, event_id % 3 + 1 AS tier, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS a FROM events) SELECT key, paper, tier, ord FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tier, ord) AS b FROM e WHERE a = 1) WHERE b <= 2",
        "j9_label_matching": "WITH n AS (SELECT p_name, min(p_partkey) AS acc FROM part GROUP BY p_name), l AS (SELECT CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) ELSE 'big ' || p_name END AS label FROM part UNION SELECT p_brand FROM part), f AS (SELECT label, acc, row_number() OVER (PARTITION BY label ORDER BY len(list_intersect(string_split(lower(label), ' '), string_split(p_name, ' '))) / least(len(string_split(label, ' ')), 2) DESC, acc) AS rn FROM l, n WHERE len(list_intersect(string_split(lower(label), ' '), string_split(p_name, ' '))) / least(len(string_split(label, ' ')), 2) >= 0.5) SELECT l.label, coalesce(a.acc, b.acc, f.acc) AS acc, CASE WHEN a.acc IS NOT NULL THEN 'exact' WHEN b.acc IS NOT NULL THEN 'case' WHEN f.acc IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS how FROM l LEFT JOIN n a ON a.p_name = l.label LEFT JOIN n b ON b.p_name = lower(l.label) LEFT JOIN f ON f.label = l.label AND rn = 1",
        "j7_skeleton": "WITH x AS (SELECT n_name, c_name, row_number() OVER (PARTITION BY n_name ORDER BY c_name) AS rn FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT n_name, count(*) AS n, string_agg(c_name, ';' ORDER BY rn) FILTER (rn <= 10) AS hints FROM x GROUP BY n_name",
        "j16_target_pool": "SELECT target, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linestatus AS target FROM lineitem) WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE year(o_orderdate) >= 1997) AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY target",
        "j23_traceability": "WITH f AS (SELECT l_partkey, min(l_suppkey) AS s FROM lineitem GROUP BY l_partkey) SELECT p_brand, CASE WHEN s IS NULL THEN 'no supplier' WHEN s_suppkey IS NULL THEN 'supplier dropped' WHEN n_nationkey IS NULL THEN 'nation dropped' ELSE 'kept' END AS reason, count(*) AS n FROM part LEFT JOIN f ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = s AND s_acctbal > 0 LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey < 4 GROUP BY ALL",
        "j24_alias_union": "WITH a AS (SELECT p_type, split_part(p_name, ' ', 1) AS alias FROM part UNION SELECT p_type, lower(p_brand) FROM part) SELECT p_type, count(DISTINCT alias) AS n, array_to_string(list_sort(list_distinct(list(alias))), ',') AS aliases FROM a WHERE lower(alias) <> lower(p_type) GROUP BY p_type",
        "j26_missing_syntax": "WITH t AS (SELECT DISTINCT p_brand, p_type FROM part), s AS (SELECT DISTINCT p_brand, CASE WHEN p_size <= 45 THEN lower(p_type) ELSE p_type END AS p_type, 1 AS x FROM part) SELECT p_brand, count(*) FILTER (x IS NULL) AS n_suggested, count(*) AS n FROM t LEFT JOIN s USING (p_brand, p_type) GROUP BY p_brand",
        "f16_tristate_split": "SELECT coalesce(quality = 1, false) AS kept, quality IS NULL AS unknown, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL",
        "f9_routing": "WITH d AS (SELECT text, doc_id % 10 = 0 OR length(text) > 5000 AS head FROM documents) SELECT head, count(*) AS n, CAST(sum(CASE WHEN head THEN least(length(text), 3000) ELSE length(text) END) AS BIGINT) AS chars FROM d GROUP BY head",
        "f20_frequency_gate": "WITH " + DOC_TOKENS + " SELECT count(*) AS n, CAST(sum(df) AS BIGINT) AS df FROM f WHERE df >= 30 AND token NOT IN (SELECT unnest(string_split(p_name, ' ')) FROM part)",
        "f22_giant_tables": "WITH g AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS n_orders FROM g WHERE n <= 6",
        "r7_slot_correction": "WITH a AS (SELECT CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'A' WHEN p_size > 25 THEN 'B' ELSE 'D_other' END AS family, CASE WHEN p_type IN ('SMALL', 'LARGE') THEN p_type ELSE 'other' END AS subtype, p_name FROM part) SELECT family, subtype, CASE WHEN family = 'A' THEN array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), '|') ELSE '' END AS bag, count(*) AS n FROM a GROUP BY ALL",
        "r11_nested_targets": "WITH " + EVENT_FACTS + ", f AS (SELECT env, key, count(DISTINCT paper) AS n FROM facts GROUP BY ALL) SELECT env, row_number() OVER (PARTITION BY env ORDER BY key) - 1 AS pos, key, n, round(100 * n / sum(n) OVER (PARTITION BY env), 2) AS pct FROM f",
        "g3_signature_merge": "WITH p AS (SELECT p_partkey % 300 AS c, p_partkey AS m, list_sort(list_filter(string_split(p_name, ' '), lambda t: t NOT IN ('small', 'red'))) AS core FROM part), b AS (SELECT c, min(m) AS b, first(array_to_string(core, ' ') ORDER BY len(core), array_to_string(core, ' ')) AS s FROM p WHERE len(core) > 0 GROUP BY c), a AS (SELECT s, min(b) AS a FROM b GROUP BY s) SELECT count(*) AS n, count(DISTINCT a) AS n_heads FROM b JOIN a USING (s) WHERE a <> b",
        "g5_pair_proposals": "WITH c AS (SELECT c_nationkey, count(*) AS n, min(c_custkey) AS k FROM customer GROUP BY c_nationkey, CAST(floor(c_acctbal / 50) AS BIGINT)) SELECT x.c_nationkey, x.k AS a, y.k AS b FROM c x JOIN c y ON x.c_nationkey = y.c_nationkey AND x.k < y.k WHERE x.n = 1 OR y.n = 1",
        "g6_rule_layer": "WITH RECURSIVE k AS (SELECT DISTINCT name FROM (" + SCALARS["t13_variants"].split(", v AS")[0] + " SELECT name FROM names)), v AS (SELECT DISTINCT name AS a, variant AS b FROM (SELECT name, unnest([regexp_replace(name, '_(concentration|content|level|value|rate)$', ''), regexp_replace(name, '^(total|mean|average)_', ''), CASE WHEN regexp_matches(name, '[a-z]{3}s$') THEN left(name, length(name) - 1) ELSE name END, regexp_replace(name, '^(.+)_of_(.+)$', '\\2_\\1')]) AS variant FROM k) WHERE variant <> name AND variant IN (SELECT name FROM k)), bo AS (SELECT a, b FROM v UNION SELECT b, a FROM v), reach AS (SELECT DISTINCT a AS node, a AS r FROM bo UNION SELECT reach.node, bo.b FROM reach JOIN bo ON bo.a = reach.r), c AS (SELECT node, min(r) AS component FROM reach GROUP BY node) SELECT component, count(*) AS n FROM c GROUP BY component",
        "sm6_cells": "WITH " + EVENT_FACTS + " SELECT e.env, k.key, count(*) AS n FROM (SELECT DISTINCT paper, env FROM facts) e JOIN (SELECT DISTINCT paper, key FROM facts) k USING (paper) GROUP BY ALL",
        "c4_merge_targets": "WITH " + EVENT_FACTS + ", v AS (SELECT key, " + ", ".join(f"count(DISTINCT paper) FILTER (env = 'e{i}') AS env_e{i}" for i in range(4)) + " FROM facts GROUP BY key), m AS (SELECT CASE WHEN key IN ('click', 'view') THEN 'signup' ELSE key END AS key, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in envs) + " FROM v GROUP BY 1) SELECT *, round(" + h2(envs) + ", 6) AS h_norm FROM m",
        "x25_paper_keys": "WITH " + PARTS + ", k AS (SELECT p_partkey, translate(lower(trim(raw)), ' -', '__') AS key FROM parts), x AS (SELECT DISTINCT l_orderkey, key FROM lineitem JOIN k ON p_partkey = l_partkey) SELECT count(*) AS n_occurrences, count(DISTINCT l_orderkey) AS n_papers, count(DISTINCT key) AS n_keys FROM x",
        "x35_target_fallback": "WITH x AS (SELECT * FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey), o AS (SELECT n_nationkey, n_regionkey, count(DISTINCT s_name) FILTER (s_acctbal > 5000) AS k FROM x GROUP BY ALL), r AS (SELECT n_regionkey, count(DISTINCT s_name) AS a FROM x GROUP BY n_regionkey) SELECT n_nationkey, CASE WHEN k > 0 THEN k ELSE a END AS n, k > 0 AS is_own FROM o JOIN r USING (n_regionkey)",
    }


SQL = _sql()
