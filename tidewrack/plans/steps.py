"""Steps between stages, extractors, small text functions, sources and sinks, each over whole proxy tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewrack.functions import json_repair as J
from tidewrack.functions import text as T
from tidewrack.operators import graph as G
from tidewrack.operators import steps as S
from tidewrack.plans.proxies import load


def _items(spark, sf_dir):
    """Lines as items of papers: every third one is an abstract."""
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pmid"), "l_linenumber", F.when(F.col("l_partkey") % 3 == 0, "abstract").otherwise("METHODS").alias("section"))


def f7_relation_input(spark, sf_dir):
    targets = load(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("pmid"))
    return S.relation_input(_items(spark, sf_dir), targets, "pmid", "section").groupBy("section").agg(F.count("*").alias("n"), F.countDistinct("pmid").alias("n_papers"))


def f11_x20_routed(spark, sf_dir):
    """Parts of whitelisted types (those of small parts of one brand) wait for the model; the others are labelled."""
    p = load(spark, sf_dir, "part")
    terms = p.filter("p_size < 5 AND p_brand = 'Brand#11'").select(F.upper("p_type").alias("term"))
    return S.routed(p.select("p_partkey", F.concat(F.lit(" "), "p_type").alias("key")), terms, "key", "term").groupBy("origin", F.coalesce("label", F.lit("-")).alias("label")).agg(F.count("*").alias("n"))


def f17_without_failed(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 4 == 0, "FAILED").when(F.col("o_orderkey") % 4 == 1, None).otherwise(F.col("o_orderstatus")).alias("family"))
    return S.without_failed(o, "family").groupBy(F.coalesce("family", F.lit("-")).alias("family")).agg(F.count("*").alias("n"))


def f18_without_singletons(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("family"), "o_orderstatus")
    return S.without_singletons(o, "family", "o_orderstatus").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.countDistinct("family").alias("n_families"))


def f21_target_accessions(spark, sf_dir):
    """Customers as accessions: targets are those with debts and their nations; orders link customers to the nation of their clerk."""
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    acc = lambda x, k: F.concat(F.lit(x), k)
    samples = c.filter("c_acctbal < -900").select(acc("c", "c_custkey").alias("sample"), acc("n", "c_nationkey").alias("project"))
    links = o.select(acc("c", "o_custkey").alias("acc"), acc("n", F.col("o_orderkey") % 25).alias("other"))
    every = c.select(acc("c", "c_custkey").alias("acc")).union(load(spark, sf_dir, "nation").select(acc("n", "n_nationkey")))
    return S.target_accessions(every, samples, links).groupBy(F.left("acc", F.lit(1)).alias("kind")).agg(F.count("*").alias("n"))


def f25_f24b_papers(spark, sf_dir):
    """Items of the papers of a pool; the broad pool asks for a year only."""
    pool = load(spark, sf_dir, "orders").filter("year(o_orderdate) = 1996").select(F.col("o_orderkey").alias("pmid"))
    return _items(spark, sf_dir).join(pool, "pmid", "left_semi").groupBy("section").agg(F.count("*").alias("n"))


def f27_key_spaces(spark, sf_dir):
    p = load(spark, sf_dir, "part").select(F.concat(F.when(F.col("p_size") < 20, "mixs:").when(F.col("p_size") < 35, "internal:").otherwise(""), "p_name").alias("key"))
    return S.odd_keys(p, "key", ["mixs", "internal"])


def j3_j4_joined_last(spark, sf_dir):
    """Customers with the priority of their last order."""
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority", F.col("o_orderkey").alias("ord"))
    return S.joined_last(load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), o, "c_custkey", "ord").groupBy("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"))


def j13b_inherited(spark, sf_dir):
    """Groups of names by brand and size, of even keys (old, approved where the size is even) and odd ones (new)."""
    from tidewrack.operators.matching import overlaps, set_overlap

    p = load(spark, sf_dir, "part").withColumn("g", F.concat_ws("/", "p_brand", "p_size"))
    old, new = p.filter("p_partkey % 2 = 0").select("g", "p_name"), p.filter("p_partkey % 2 = 1").select(F.concat(F.lit("new "), "g").alias("g"), "p_name")
    kinds = set_overlap(old, new, "g", "p_name").select("new", "kind")
    decisions = old.select(F.col("g").alias("old")).distinct().withColumn("approved", F.substring_index("old", "/", -1).cast("int") % 2 == 0)
    rejected = new.filter(F.endswith("g", F.lit("/7"))).select(F.col("g").alias("new")).distinct()
    return S.inherited(kinds, overlaps(old, new, "g", "p_name"), decisions, rejected).groupBy("kind", "approved").agg(F.count("*").alias("n"))


def j14b_target_sets(spark, sf_dir):
    """All targets (types) of an alias (first word of a name), with their papers."""
    p = load(spark, sf_dir, "part").select(F.split("p_name", " ")[0].alias("alias"), F.col("p_type").alias("target"), "p_partkey").distinct()
    papers = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").alias("pmid"))
    return p.join(papers, "p_partkey").groupBy("alias", "target").agg(F.countDistinct("pmid").alias("n_papers"))


def j28_src19_more_aliases(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    canon = p.groupBy("p_type").agg(F.array_sort(F.collect_set(F.lower("p_brand"))).alias("aliases"))
    raw = p.select(F.lower("p_type").alias("normalized"), F.split("p_name", " ")[1].alias("raw_key"))
    made = S.with_more_aliases(canon, raw, F.lower("p_type"))
    return made.select("p_type", F.array_join("aliases", ",").alias("aliases"))


def j21_x21_consistent(spark, sf_dir):
    """What a model gave back against its input: the organism differs for some, and some rows are missing."""
    p = load(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("sample"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("organism"))
    told = p.filter("p_partkey % 5 > 0").select("p_partkey", "sample", F.when(F.col("p_partkey") % 7 == 0, "other").otherwise(F.coalesce("organism", F.lit(""))).alias("organism"))
    return S.consistent(told, p, "p_partkey", ["sample", "organism"]).groupBy("ok").agg(F.count("*").alias("n"))


def a3_split_coverage(spark, sf_dir):
    n = load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("papers"))
    return S.split_coverage(n, n.filter("papers >= 30"), "papers")


def a16b_environments(spark, sf_dir):
    from tidewrack.plans.proxies import event_facts

    return S.by_environment(event_facts(spark, sf_dir), "env", "paper")


def a16c_several(spark, sf_dir):
    from tidewrack.plans.proxies import event_facts

    return S.in_several(event_facts(spark, sf_dir), "env", "paper").groupBy("n_envs").agg(F.count("*").alias("n"))


def a18b_unmapped(spark, sf_dir):
    """Papers of unmapped fields (names without a slot)."""
    f = load(spark, sf_dir, "part").filter("p_size % 3 = 0").select("p_partkey", F.col("p_name").alias("field"))
    li = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").alias("pmid"))
    return f.join(li, "p_partkey").groupBy("field").agg(F.countDistinct("pmid").alias("n_papers"))


def a35_distributions(spark, sf_dir):
    return S.distributions(load(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


def a40_family_preview(spark, sf_dir):
    p = load(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("family"), "p_partkey")
    return S.family_preview(p, "family", "p_partkey", 20)


def w3b_longest_name(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_brand", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.when(F.col("p_size") % 3 == 0, "_x_y").otherwise("")).alias("name"))
    return S.longest_name(p, "p_brand", "name")


def w4b_frequent_name(spark, sf_dir):
    p = load(spark, sf_dir, "part").groupBy("p_brand", "p_name").agg(F.count("*").alias("f"))
    return S.frequent_name(p, "p_brand", "p_name", "f")


def w5e_first_evidence(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_type", "event_id", "user_id")
    return S.first_evidence(e, "event_type", "event_id", 6)


def r1_ordered_distinct(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.array(F.lit(" "), F.col("o_orderstatus"), F.concat(F.lit(" "), "o_orderstatus"), F.lower("o_orderpriority"), F.lit("")).alias("x"))
    return o.groupBy(F.array_join(S.ordered_distinct(F.col("x")), "|").alias("labels")).agg(F.count("*").alias("n"))


def x34_ordered_labels(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ord"), F.array("l_returnflag", "l_linestatus").alias("labels"))
    return S.ordered_labels(li, "l_orderkey", "labels", "ord").groupBy(F.array_join("labels", "").alias("labels")).agg(F.count("*").alias("n"))


def r13_first_in_any_case(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_brand", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.concat(F.lit(" "), F.lower("p_type"))).alias("v"), "p_partkey")
    return S.first_in_any_case(p, "p_brand", "v", "p_partkey")


def r14_merged_sources(spark, sf_dir):
    c, s = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), "c_acctbal"), load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return S.merged_sources(table=c, model=s).groupBy("k", "source").agg(F.count("*").alias("n"), F.count("c_acctbal").alias("n_values"))


def r5_r15_inverted(spark, sf_dir):
    canon = load(spark, sf_dir, "part").groupBy("p_type").agg(F.collect_set(F.split("p_name", " ")[0]).alias("aliases"))
    return S.inverted(canon, "p_type", "aliases")


def r3_r4_items_by_slot(spark, sf_dir):
    """Items of each accession and slot in order, as arrays, and flat again."""
    li = load(spark, sf_dir, "lineitem")
    x = li.groupBy("l_orderkey", "l_returnflag").agg(F.sort_array(F.collect_list("l_partkey")).alias("items"))
    return x.select("l_returnflag", F.posexplode("items").alias("i", "part")).groupBy("l_returnflag", "i").agg(F.count("*").alias("n"), F.sum("part").alias("s"))


def x27_paper_environments(spark, sf_dir):
    c = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("envs"))
    return S.paper_environments(c, "envs", ["1-URGENT", "3-MEDIUM"]).groupBy(F.array_join("envs", "+").alias("envs")).agg(F.count("*").alias("n"))


def x28_x30_success_rates(spark, sf_dir):
    s, li = load(spark, sf_dir, "part"), load(spark, sf_dir, "lineitem")
    return S.success_rates(s.select(F.col("p_partkey").alias("t")), li.filter("l_quantity > 30").select(F.col("l_partkey").alias("t"), "l_returnflag"), "t", F.col("l_returnflag") == "R")


def x36_finalized(spark, sf_dir):
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    accs = c.select(F.col("c_custkey").alias("acc"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("env"))
    ident = o.filter("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("acc"), F.lower("o_orderstatus").alias("env"), F.col("o_orderpriority").alias("label"))
    got = S.finalized(accs, ident, c.filter("c_acctbal > 0").select(F.col("c_custkey").alias("acc")))
    return got.groupBy("env", F.size("labels").alias("n_labels")).agg(F.count("*").alias("n"))


def x37_context(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    return S.shared_prompt(c, "conv_id", "role", "text", "turn", 4000).select("conv_id", F.md5(F.col("context").cast("binary")).alias("digest"))


def x38_x39_provenance(spark, sf_dir):
    p = load(spark, sf_dir, "part").select(S.provenance(paper=F.col("p_partkey"), quote=F.when(F.col("p_size") % 2 == 0, " ").otherwise(F.col("p_name"))).alias("x"))
    return p.agg(F.count("x.paper").alias("n_papers"), F.count("x.quote").alias("n_quotes"))


def x47_main_list(spark, sf_dir):
    n = load(spark, sf_dir, "part").join(load(spark, sf_dir, "lineitem"), F.col("p_partkey") == F.col("l_partkey")).groupBy("p_name").agg(F.countDistinct("l_orderkey").alias("papers"))
    return S.main_list(n.filter("papers >= 100"), n, "p_name", "papers", ["blue", "ring", "absent"])


def x48_prompt_sizes(spark, sf_dir):
    """Bytes of all texts, and of those of the target languages only."""
    d = load(spark, sf_dir, "documents").select("lang", F.octet_length(F.coalesce("text", F.lit(""))).alias("b"))
    return d.agg(F.sum("b").alias("before"), F.sum(F.when(F.col("lang").isin("en", "de"), F.col("b"))).alias("after"))


def s8_overlapping(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("chunk"))
    primary = load(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ")[1].alias("chunk"))
    return S.overlapping(p, primary, "p_partkey", "chunk").groupBy("chunk").agg(F.count("*").alias("n"))


def g4_clusters(spark, sf_dir):
    from tidewrack.plans.joins import _bucketed

    return G.clusters(_bucketed(spark, sf_dir), "p_brand", "name")


def g1b_groups(spark, sf_dir):
    found = G.groups(load(spark, sf_dir, "nation"), "n_regionkey", "n_name")
    return found.select("n_regionkey", F.array_join("members", ",").alias("members"))


def st3_snapshots(spark, sf_dir):
    path = G.scratch(spark, "snapshots")
    p = load(spark, sf_dir, "part").select("p_partkey", "p_type")
    for version in (1, 2):
        S.snapshot(p.filter(F.col("p_partkey") % 3 < version), path, version)
    return S.newest(spark, path).groupBy("p_type").agg(F.count("*").alias("n"))


def t9_t31_tokens(spark, sf_dir):
    r = load(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("sampling_"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_water")).alias("root"), F.array("p_name", "p_type").alias("names"))
    return r.select("p_partkey", F.array_join(T.core_tokens(F.col("root")), ",").alias("core"), F.array_join(T.metadata_words(F.col("names"), ["small", "red"]), ",").alias("words"))


def t27_t40_lookups(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    reason = F.when(F.col("o_orderkey") % 4 == 0, "数据集 Cruise").when(F.col("o_orderkey") % 4 == 1, "reagent size").when(F.col("o_orderkey") % 4 == 2, None).otherwise("x")
    env = F.when(F.col("o_custkey") % 3 == 0, "OCEAN").when(F.col("o_custkey") % 3 == 1, "Lake").otherwise("Desert")
    return o.groupBy(T.reason_category(reason).alias("category"), T.environment_key(env).alias("env")).agg(F.count("*").alias("n"))


def t41b_t44_t46_texts(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    labels = F.concat_ws(",", F.when(F.col("p_size") % 2 == 0, " Lake"), F.lit("Others"), F.when(F.col("p_size") % 3 == 0, "Wetlands"), F.lit("?"))
    name = F.when(F.col("p_size") % 2 == 0, "v1_out").otherwise("out")
    about = T.description(F.col("p_name"), F.when(F.col("p_size") % 5 > 0, F.col("p_type")), F.when(F.col("p_size") % 7 == 0, "other").otherwise(F.col("p_brand")), F.when(F.col("p_size") % 2 == 0, "a|b"))
    return p.select("p_partkey", F.array_join(T.environment_labels_of(labels), "+").alias("labels"), T.prefixed_name(name, F.lit("v1")).alias("file"), about.alias("about"), T.tier_text(F.col("p_size"), F.col("p_size") / 2, 25).alias("tier"))


def t32_t36_ids(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    units = T.listed(F.concat(F.lit(" mg, "), "p_type", F.lit(",, (empty),m")))
    bars = T.listed(F.concat_ws("|", F.lit("a "), "p_brand", F.lit("(empty)"), F.lit("")), "|")
    return p.select("p_partkey", T.record_id(F.col("p_partkey"), F.lit(None).cast("string"), F.col("p_type")).alias("id"), T.segment_hash(F.col("p_name")).alias("hash"), F.array_join(units, ";").alias("units"), F.array_join(bars, ";").alias("bars"))


def t39_m13_d2_small(spark, sf_dir):
    from tidewrack.functions import values as V

    o = load(spark, sf_dir, "orders")
    year = F.when(F.col("o_orderkey") % 3 == 0, 2003).when(F.col("o_orderkey") % 3 == 1, 2019)
    return o.groupBy(T.alias(F.concat(F.lit(" "), "o_orderstatus"), F.lower(F.left("o_orderpriority", F.lit(1)))).alias("alias"), V.era(year).alias("era")).agg(F.count("*").alias("n"))


def _wrapped(spark, sf_dir):
    """Answers with a list, a fenced object, an object among words, a list with a comma too many, and without any JSON."""
    body = F.concat(F.lit('{"key": "'), "o_orderkey", F.lit('"}'))
    kinds = [F.concat(F.lit("Sure: ["), body, F.lit("] ok?")), F.concat(F.lit("```json\n"), body, F.lit("\n```")), F.concat(F.lit("It is "), body, F.lit(". Done")), F.concat(F.lit("["), body, F.lit(", ]")), F.lit("nothing")]
    return load(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*kinds), (F.col("o_orderkey") % 5).cast("int") + 1).alias("answer"))


def js12_simple(spark, sf_dir):
    x = _wrapped(spark, sf_dir).select("o_orderkey", J.simple_list(F.col("answer")).alias("v"))
    key = F.coalesce(F.try_variant_get("v", "$[0].key", "string"), F.try_variant_get("v", "$.key", "string"))
    return x.select("o_orderkey", key.alias("key"))


def js14_js16_lists(spark, sf_dir):
    x = _wrapped(spark, sf_dir)
    return x.select("o_orderkey", J.list_text(F.col("answer")).alias("wide"), J.list_text(F.col("answer"), greedy=False).alias("narrow"))


def js15_object(spark, sf_dir):
    return _wrapped(spark, sf_dir).select("o_orderkey", F.try_variant_get(J.object_of(F.col("answer")), "$.key", "string").alias("key"))


def js17_groups(spark, sf_dir):
    body = F.concat(F.lit('{"groups": [{"members": ["a", 1, null]}, ["'), "o_orderstatus", F.lit('", {"x": 1}], 5, {"members": []}]}'))
    text = F.when(F.col("o_orderkey") % 3 == 0, "[1]").otherwise(body)
    g = load(spark, sf_dir, "orders").select(J.groups_of(F.try_parse_json(text)).alias("g"))
    return g.select(F.to_json("g").alias("groups")).groupBy("groups").agg(F.count("*").alias("n"))


def js5_js13b_texts(spark, sf_dir):
    x = _wrapped(spark, sf_dir).select(J.without_explanation(F.col("answer")).alias("t"), J.keys_in(F.col("answer"), ["key", "value"]).alias("k"))
    return x.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.length("t")).alias("chars"))


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and not name.startswith("_") and getattr(f, "__module__", "") == __name__}

ITEMS = "items AS (SELECT l_orderkey AS pmid, CASE WHEN l_partkey % 3 = 0 THEN 'abstract' ELSE 'METHODS' END AS section FROM lineitem)"
WRAPPED = """w AS (SELECT o_orderkey, '{"key": "' || o_orderkey || '"}' AS body, o_orderkey % 5 AS k FROM orders)"""
SQL = {
    "f7_relation_input": "WITH " + ITEMS + " SELECT section, count(*) AS n, count(DISTINCT pmid) AS n_papers FROM items WHERE section <> 'abstract' AND pmid IN (SELECT pmid FROM items WHERE section = 'abstract') AND pmid IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY section",
    "f11_x20_routed": "SELECT CASE WHEN m THEN 'model' ELSE 'prefilter' END AS origin, CASE WHEN m THEN '-' ELSE 'Others' END AS label, count(*) AS n FROM (SELECT p_type IN (SELECT p_type FROM part WHERE p_size < 5 AND p_brand = 'Brand#11') AS m FROM part) GROUP BY ALL",
    "f17_without_failed": "SELECT coalesce(f, '-') AS family, count(*) AS n FROM (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'FAILED' WHEN 1 THEN NULL ELSE o_orderstatus END AS f FROM orders) WHERE f IS NULL OR f <> 'FAILED' GROUP BY 1",
    "f18_without_singletons": "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS n_families FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) >= 2) GROUP BY o_orderstatus",
    "f21_target_accessions": "WITH g AS (SELECT 'c' || c_custkey AS acc FROM customer WHERE c_acctbal < -900 UNION SELECT 'n' || c_nationkey FROM customer WHERE c_acctbal < -900), a AS (SELECT acc FROM g UNION SELECT 'c' || o_custkey FROM orders WHERE 'n' || (o_orderkey % 25) IN (SELECT acc FROM g)), e AS (SELECT 'c' || c_custkey AS acc FROM customer UNION ALL SELECT 'n' || n_nationkey FROM nation) SELECT acc[1] AS kind, count(*) AS n FROM e WHERE acc IN (SELECT acc FROM a) GROUP BY 1",
    "f25_f24b_papers": "WITH " + ITEMS + " SELECT section, count(*) AS n FROM items WHERE pmid IN (SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1996) GROUP BY section",
    "f27_key_spaces": "SELECT CASE WHEN p_size < 20 THEN 'mixs' WHEN p_size < 35 THEN 'internal' ELSE 'none' END AS space, count(*) AS n FROM part GROUP BY 1",
    "j3_j4_joined_last": "SELECT c_mktsegment, p AS o_orderpriority, count(*) AS n FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey GROUP BY ALL",
    "j13b_inherited": "WITH o AS (SELECT p_brand || '/' || p_size AS g, p_size % 2 = 0 AS ok, list_sort(list_distinct(list(p_name))) AS s FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL), n AS (SELECT p_brand || '/' || p_size AS g, p_size, list_sort(list_distinct(list(p_name))) AS s FROM part WHERE p_partkey % 2 = 1 GROUP BY ALL), k AS (SELECT n.g, n.p_size, CASE WHEN bool_or(o.s = n.s) THEN 'exact' WHEN count(o.g) > 0 THEN 'partial' ELSE 'new' END AS kind, bool_or(o.ok) FILTER (o.s = n.s) AS own, bool_or(o.ok) AS anyok FROM n LEFT JOIN o ON list_has_any(o.s, n.s) GROUP BY ALL) SELECT kind, coalesce(CASE kind WHEN 'exact' THEN own WHEN 'partial' THEN anyok ELSE p_size <> 7 END, false) AS approved, count(*) AS n FROM k GROUP BY ALL",
    "j14b_target_sets": "SELECT split_part(p_name, ' ', 1) AS alias, p_type AS target, count(DISTINCT l_orderkey) AS n_papers FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY ALL",
    "j28_src19_more_aliases": "SELECT p_type, array_to_string(list_sort(list_distinct(list_concat(list(lower(p_brand)), list(split_part(p_name, ' ', 2))))), ',') AS aliases FROM part GROUP BY p_type",
    "j21_x21_consistent": "SELECT p_partkey % 5 > 0 AND (p_partkey % 7 > 0) AS ok, count(*) AS n FROM part GROUP BY 1",
    "a3_split_coverage": "WITH n AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS p FROM lineitem GROUP BY 1), x AS (SELECT count(*) AS n_all, CAST(sum(p) AS BIGINT) AS papers_all, count(*) FILTER (p >= 30) AS n_kept, CAST(sum(p) FILTER (p >= 30) AS BIGINT) AS papers_kept FROM n) SELECT *, round(100 * papers_kept / papers_all, 2) AS pct, round(100 * n_kept / n_all, 2) AS pct_rows FROM x",
    "a16b_environments": "SELECT 'e' || (CAST(json_extract_string(props, '$.k') AS INT) % 4) AS env, count(DISTINCT user_id) AS n_papers FROM events GROUP BY 1",
    "a16c_several": "SELECT n_envs, count(*) AS n FROM (SELECT user_id, count(DISTINCT CAST(json_extract_string(props, '$.k') AS INT) % 4) AS n_envs FROM events GROUP BY 1) WHERE n_envs > 1 GROUP BY 1",
    "a18b_unmapped": "SELECT p_name AS field, count(DISTINCT l_orderkey) AS n_papers FROM part JOIN lineitem ON p_partkey = l_partkey WHERE p_size % 3 = 0 GROUP BY 1",
    "a35_distributions": "SELECT 'o_orderstatus' AS \"column\", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL",
    "a40_family_preview": "SELECT family, count(DISTINCT p_partkey) AS size FROM (SELECT unnest(string_split(p_name, ' ')) AS family, p_partkey FROM part) GROUP BY 1 ORDER BY size DESC, family LIMIT 20",
    "w3b_longest_name": "WITH n AS (SELECT p_brand, replace(p_name, ' ', '_') || CASE WHEN p_size % 3 = 0 THEN '_x_y' ELSE '' END AS name FROM part) SELECT p_brand, first(name ORDER BY len(string_split(name, '_')) DESC, length(name) DESC, name) AS canonical FROM n GROUP BY 1",
    "w4b_frequent_name": "SELECT p_brand, first(p_name ORDER BY f DESC, length(p_name), p_name) AS representative FROM (SELECT p_brand, p_name, count(*) AS f FROM part GROUP BY ALL) GROUP BY 1",
    "w5e_first_evidence": "SELECT event_type, event_id, user_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events) WHERE rn <= 6",
    "r1_ordered_distinct": "SELECT o_orderstatus || '|' || lower(o_orderpriority) AS labels, count(*) AS n FROM orders GROUP BY 1",
    "x34_ordered_labels": "WITH x AS (SELECT l_orderkey, unnest([l_returnflag, l_linestatus]) AS l, unnest([1, 2]) AS j, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem), f AS (SELECT l_orderkey, l, min(2 * i + j) AS place FROM x GROUP BY ALL) SELECT labels, count(*) AS n FROM (SELECT string_agg(l, '' ORDER BY place) AS labels FROM f GROUP BY l_orderkey) GROUP BY 1",
    "r13_first_in_any_case": "WITH p AS (SELECT p_brand, CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE ' ' || lower(p_type) END AS v, p_partkey FROM part) SELECT p_brand, v, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, lower(trim(v)) ORDER BY p_partkey) AS rn FROM p) WHERE rn = 1",
    "r14_merged_sources": "SELECT c_nationkey AS k, 'table' AS source, count(*) AS n, count(c_acctbal) AS n_values FROM customer GROUP BY ALL UNION ALL SELECT s_nationkey, 'model', count(*), 0 FROM supplier GROUP BY ALL",
    "r5_r15_inverted": "SELECT DISTINCT unnest([p_type, split_part(p_name, ' ', 1)]) AS key, p_type AS canonical FROM part",
    "r3_r4_items_by_slot": "SELECT l_returnflag, i, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS s FROM (SELECT l_returnflag, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_partkey) - 1 AS i FROM lineitem) GROUP BY ALL",
    "x27_paper_environments": "SELECT envs, count(*) AS n FROM (SELECT string_agg(DISTINCT o_orderpriority, '+' ORDER BY o_orderpriority) AS envs FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM') GROUP BY o_custkey) GROUP BY 1",
    "x28_x30_success_rates": "SELECT p_partkey AS t, count(l_orderkey) AS tries, count(l_orderkey) FILTER (l_returnflag = 'R') AS successes, CASE WHEN count(l_orderkey) > 0 THEN round(count(l_orderkey) FILTER (l_returnflag = 'R') / count(l_orderkey), 4) ELSE 0 END AS rate FROM part LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 30) ON l_partkey = p_partkey GROUP BY 1",
    "x36_finalized": "WITH i AS (SELECT o_custkey AS acc, lower(min(o_orderstatus)) AS e, count(DISTINCT o_orderpriority) AS nl FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) SELECT coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, e) AS env, nl AS n_labels, count(*) AS n FROM customer JOIN i ON acc = c_custkey WHERE c_acctbal > 0 GROUP BY ALL",
    "x37_context": "SELECT conv_id, md5(left(string_agg('[' || role || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn), 4000)) AS digest FROM conversations WHERE text IS NOT NULL GROUP BY conv_id",
    "x38_x39_provenance": "SELECT count(*) AS n_papers, count(*) FILTER (p_size % 2 > 0) AS n_quotes FROM part",
    "x47_main_list": "WITH n AS (SELECT p_name, count(DISTINCT l_orderkey) AS p FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY 1), m AS (SELECT * FROM n WHERE p >= 100) SELECT 'coverage' AS \"check\", CAST(round(100 * (SELECT sum(p) FROM m) / (SELECT sum(p) FROM n), 2) AS VARCHAR) AS value UNION ALL SELECT w, CAST(EXISTS (SELECT 1 FROM m WHERE contains(p_name, w)) AS VARCHAR) FROM (VALUES ('blue'), ('ring'), ('absent')) v(w)",
    "x48_prompt_sizes": "SELECT CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS before, CAST(sum(strlen(coalesce(text, ''))) FILTER (lang IN ('en', 'de')) AS BIGINT) AS after FROM documents",
    "s8_overlapping": "SELECT chunk, count(*) AS n FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS chunk, split_part(p_name, ' ', 2) AS prim FROM part) WHERE chunk = prim GROUP BY 1",
    "g1b_groups": "SELECT n_regionkey, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS members FROM nation GROUP BY 1",
    "st3_snapshots": "SELECT p_type, count(*) AS n FROM part WHERE p_partkey % 3 < 2 GROUP BY 1",
    "t9_t31_tokens": "SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda t, i: list_position(string_split(p_name, ' '), t) = i), ',') AS core, array_to_string(list_sort(list_filter(list_distinct(list_append(string_split(lower(p_name), ' '), lower(p_type))), lambda t: t NOT IN ('small', 'red'))), ',') AS words FROM part",
    "t27_t40_lookups": "SELECT ['identifier', 'processing', 'other', 'other'][o_orderkey % 4 + 1] AS category, ['Open_ocean', 'Lake', 'desert'][o_custkey % 3 + 1] AS env, count(*) AS n FROM orders GROUP BY ALL",
    "t41b_t44_t46_texts": "SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN 'Lake+Wetlands' WHEN p_size % 2 = 0 THEN 'Lake' WHEN p_size % 3 = 0 THEN 'Wetlands' ELSE 'Others' END AS labels, 'v1_out' AS file, p_name || CASE WHEN p_size % 5 > 0 THEN '. a ' || p_type || ' field' ELSE '' END || CASE WHEN p_size % 7 > 0 THEN '. measuring ' || p_brand ELSE '' END || CASE WHEN p_size % 2 = 0 THEN '. with modifiers a, b' ELSE '' END || '.' AS about, CASE WHEN p_size >= 25 THEN 'High literature frequency (' || p_size || ' PMIDs, ' || printf('%.1f', p_size / 2) || '%) >= absolute threshold (25 PMIDs); no MIxS equivalent' ELSE 'Low literature frequency (' || p_size || ' PMIDs, ' || printf('%.1f', p_size / 2) || '%), below Tier 2 threshold (25 PMIDs)' END AS tier FROM part",
    "t32_t36_ids": "SELECT p_partkey, p_partkey || '||' || p_type AS id, md5(p_name) AS hash, 'mg;' || p_type || ';m' AS units, 'a;' || p_brand AS bars FROM part",
    "t39_m13_d2_small": "SELECT o_orderstatus AS alias, ['early', 'middle', 'unknown'][o_orderkey % 3 + 1] AS era, count(*) AS n FROM orders GROUP BY ALL",
    "js12_simple": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN CAST(o_orderkey AS VARCHAR) END AS key FROM orders",
    "js14_js16_lists": "WITH " + WRAPPED + " SELECT o_orderkey, CASE k WHEN 0 THEN '[' || body || ']' WHEN 1 THEN body WHEN 2 THEN 'It is ' || body || '. Done' WHEN 3 THEN '[' || body || ', ]' ELSE 'nothing' END AS wide, CASE k WHEN 0 THEN '[' || body || ']' WHEN 1 THEN body WHEN 2 THEN 'It is ' || body || '. Done' WHEN 3 THEN '[' || body || ', ]' ELSE 'nothing' END AS narrow FROM w",
    "js15_object": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN CAST(o_orderkey AS VARCHAR) END AS key FROM orders",
    "js17_groups": "SELECT CASE WHEN o_orderkey % 3 > 0 THEN '[[\"a\",\"1\"],[\"' || o_orderstatus || '\"]]' END AS groups, count(*) AS n FROM orders GROUP BY 1",
    "js5_js13b_texts": "WITH " + WRAPPED + " SELECT CASE WHEN k < 4 THEN 1 ELSE 0 END AS k, count(*) AS n, CAST(sum(CASE k WHEN 0 THEN 8 + length(body) WHEN 1 THEN 8 + length(body) WHEN 2 THEN 6 + length(body) WHEN 3 THEN 4 + length(body) ELSE 7 END) AS BIGINT) AS chars FROM w GROUP BY 1",
}
