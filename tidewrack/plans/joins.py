"""Joins, predicates, set operations, curation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewrack.operators import curation as C
from tidewrack.operators import matching as M
from tidewrack.plans.proxies import load, occurrences


def j1_fallback_join(spark, sf_dir):
    """Brand by twice the part key, which not all parts reach, else by supplier key in the role of one."""
    left = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (2 * F.col("l_partkey")).alias("l_partkey"), "l_suppkey")
    right = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("brand"))
    return M.fallback_join(left, right, "l_partkey", "l_suppkey", "k", "brand").filter("brand IS NOT NULL").groupBy("brand").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("s"))


def j14_alias_priority(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    foreign = p.select(F.split("p_name", " ")[0].alias("alias"), F.split("p_name", " ")[1].alias("target"), F.col("p_partkey").alias("ord"))
    own = foreign.select(F.col("target").alias("alias"), "target", "ord")
    odd = p.select(F.upper("p_type").alias("alias"), F.split("p_name", " ")[1].alias("target"), F.col("p_partkey").alias("ord"))
    return M.alias_index(foreign.union(own).union(odd), "alias", "target", "ord")


def j10_fuzzy_overlap(spark, sf_dir):
    """Part names against the names of all parts, by shared words; every fifth one last."""
    p = load(spark, sf_dir, "part").select("p_partkey", F.concat(F.split("p_name", " "), F.array("p_type")).alias("tokens"), "p_type")
    right = p.select(F.col("p_partkey").alias("match"), "tokens")
    return M.overlap_join(p, right, "p_partkey", "match", "tokens", 0.5, last=(F.col("match") % 5 == 0).cast("int")).withColumn("score", F.round("score", 6))


def j12_ontology_overlap(spark, sf_dir):
    n = load(spark, sf_dir, "part").select("p_partkey", F.split(F.concat_ws(" ", "p_name", "p_brand"), " ").alias("tokens"))
    o = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("term"), F.split(F.concat_ws(" ", "p_name", "p_type"), " ").alias("tokens"))
    return M.overlap_join(n, o, "p_partkey", "term", "tokens", 0.7, smaller=False).withColumn("score", F.round("score", 6))


def _bucketed(spark, sf_dir):
    from tidewrack.plans.scalars import _names

    return _names(spark, sf_dir).select("p_brand", "name").distinct()


def j11_bucket_similarity(spark, sf_dir):
    return M.similar_pairs(_bucketed(spark, sf_dir), "p_brand", "name")


def j13_set_overlap(spark, sf_dir):
    """Names of the parts of each brand and size, of even and of odd keys."""
    p = load(spark, sf_dir, "part")
    old = p.filter("p_partkey % 2 = 0").select(F.concat_ws("/", "p_brand", "p_size").alias("g"), F.col("p_name").alias("m"))
    new = p.filter("p_partkey % 2 = 1").select(F.concat(F.lit("new "), F.concat_ws("/", "p_brand", "p_size")).alias("g"), F.col("p_name").alias("m"))
    return M.set_overlap(old, new, "g", "m")


def j17_cde_lookup(spark, sf_dir):
    cde = load(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("env"), F.concat(F.lit("n"), F.col("n_nationkey") % 7).alias("key"), F.concat(F.lit("norm"), "n_nationkey").alias("normalizer"), F.col("n_nationkey").alias("ord")).filter("ord < 15")
    cde = cde.groupBy("env", "key").agg(F.min_by("normalizer", "ord").alias("normalizer"), F.min("ord").alias("ord"))
    rows = load(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("r"), F.col("c_nationkey") % 5).alias("env"), F.concat(F.lit("n"), F.col("c_custkey") % 9).alias("key"))
    return M.cde_lookup(rows, cde, "env", "key").groupBy("env", "key", "normalizer").agg(F.count("*").alias("n"))


def f6_task_queue(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("section"))
    done = d.filter("doc_id % 4 = 0").select("doc_id")
    return M.dead_letters(d, done, "doc_id", "text", "section", ["SRC1", "SRC7"]).groupBy("reason").agg(F.count("*").alias("n"))


def f4_regex_filter(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return d.groupBy((F.coalesce(F.col("text"), F.lit("")) == "").alias("empty"), F.col("text").rlike(r"(?i)\b(token|license|the and)\b").alias("hit")).agg(F.count("*").alias("n"))


def f10_semi_anti(spark, sf_dir):
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    yes = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n_with"))
    no = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n_without"))
    return yes.join(no, "c_mktsegment", "left")


def f19_multi_env_exclusion(spark, sf_dir):
    """Papers of one environment only, and the keys that they leave."""
    from tidewrack.plans.proxies import event_facts

    f = event_facts(spark, sf_dir)
    many = f.groupBy("paper", "key").agg(F.countDistinct("env").alias("n")).filter("n > 3").select("paper", "key")
    return f.join(many, ["paper", "key"], "left_anti").groupBy("key").agg(F.countDistinct("paper").alias("n_papers"), F.count("*").alias("n"))


def f23_targets_or_all(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    pairs = p.select(F.col("p_type").alias("target"))
    sections = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("section"))
    hits = p.select((F.col("p_partkey") % 90).alias("section"), F.col("p_type").alias("target"))
    hits = hits.join(sections, "section", "left_semi")
    return M.targets_or_all(pairs, sections, hits, "section", "target")


def s1_s6_setops(spark, sf_dir):
    """S1-S3, S5; S4: that a set splits into two parts without a row in both or in none."""
    o = load(spark, sf_dir, "orders")
    a, b = o.filter("o_orderstatus = 'F'").select("o_custkey"), o.filter("o_orderpriority = '1-URGENT'").select("o_custkey")
    out = None
    for name, x in (("union", a.union(b).distinct()), ("intersect", a.intersect(b)), ("except", a.distinct().exceptAll(b.distinct())), ("minus", a.subtract(b)), ("both parts", a.subtract(b).intersect(a.intersect(b))), ("no part", a.subtract(a.subtract(b).union(a.intersect(b))))):
        row = x.agg(F.lit(name).alias("op"), F.count("*").alias("n"), F.sum("o_custkey").alias("s"))
        out = row if out is None else out.unionByName(row)
    return out


def s6_concat_dedup(spark, sf_dir):
    """Two tables of names one after the other, the first row of each name kept."""
    from tidewrack.operators.ranking import top

    p = load(spark, sf_dir, "part")
    a, b = p.filter("p_size < 20").select("p_name", "p_partkey", F.lit(0).alias("src")), p.filter("p_size >= 20").select("p_name", "p_partkey", F.lit(1).alias("src"))
    return top(a.unionByName(b), ["p_name"], [F.col("src"), F.col("p_partkey")], 1).drop("rn")


def c2_review_decisions(spark, sf_dir):
    """The few first parts stand for a reviewer's decisions, a table that is small by nature."""
    p = load(spark, sf_dir, "part")
    mapped = p.select(F.col("p_name").alias("field")).distinct().withColumn("slot", F.when(F.length("field") % 2 == 0, F.lit("UNMAPPED")).otherwise(F.concat(F.lit("slot_"), "field")))
    decisions = p.filter("p_partkey < 40").select(F.col("p_name").alias("field"), F.element_at(F.array(F.lit("FORCE_SLOT"), F.lit("EXCLUDE"), F.lit("FORCE_UNMAPPED"), F.lit("FORCE_SLOT")), (F.col("p_partkey") % 4).cast("int") + 1).alias("action"), F.lower("p_type").alias("target_slot"), F.col("p_partkey").alias("ord"))
    return C.review_decisions(mapped, decisions)


def r8_reconcile(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    groups = li.select((F.col("l_orderkey") % 500).alias("family"), (F.col("l_partkey") % 40).alias("member"), F.col("l_suppkey").cast("bigint").alias("grp"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    groups = groups.groupBy("family", "member", "grp").agg(F.min("pos").alias("pos"))
    members = spark.range(500).select(F.col("id").alias("family")).withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(59), F.lit(2)))).withColumn("member", F.col("member").cast("bigint"))
    return C.reconciled(groups, members)


def c1_canonical_edits(spark, sf_dir):
    s = load(spark, sf_dir, "part").select(F.col("p_type").alias("canonical"), F.col("p_name").alias("alias")).distinct()
    edits = [
        {"action": "REMOVE_ALIAS", "canonical": "SMALL", "alias": "blue bolt"}, {"action": "MERGE", "canonical": "LARGE", "merge_with": "MEDIUM"},
        {"action": "SPLIT", "canonical": "ECONOMY", "split_groups": [{"canonical": "ECONOMY-RING", "members": ["small ring", "red ring", "blue ring"]}]}, {"action": "RENAME", "canonical": "LARGE", "new_name": "BIG"},
    ]
    return C.canonical_edits(s, edits).distinct().groupBy("canonical").agg(F.count("*").alias("n"), F.min("alias").alias("first"))


def c8_expand_keys(spark, sf_dir):
    """The few first parts stand for a curated expansion table, which is small by nature."""
    p = load(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("key"))
    table = load(spark, sf_dir, "part").filter("p_partkey < 30").select(F.lower("p_type").alias("raw_key"), F.concat(F.lit("norm_"), F.lower("p_type")).alias("normalized"), F.col("p_partkey").alias("ord")).filter("raw_key <> 'small'")
    return C.expanded(C.expanded(p, table, "key"), table, "key").groupBy("key", "raw_key_original").agg(F.count("*").alias("n"))


def j22_three_way_diff(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    before, after = p.filter("p_partkey % 5 > 0").select("p_partkey", "p_type"), p.filter("p_partkey % 7 > 0").select("p_partkey", F.when(F.col("p_partkey") % 11 == 0, None).otherwise(F.col("p_type")).alias("now"))
    kind = F.when(F.col("p_type").isNull(), "new").when(F.col("present").isNull(), "retired").when(F.col("p_type").eqNullSafe(F.col("now")), "same").otherwise("changed")
    return before.join(after.withColumn("present", F.lit(1)), "p_partkey", "full_outer").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def r2_flatten_nested(spark, sf_dir):
    """Orders as papers with lines as samples, nested and flattened again."""
    li = load(spark, sf_dir, "lineitem")
    nested = li.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", F.array(F.struct(F.lit("part").alias("field"), F.col("l_partkey").alias("v")), F.struct(F.lit("supp").alias("field"), F.col("l_suppkey").alias("v"))).alias("metadata"))).alias("samples"))
    return nested.select("l_orderkey", F.inline("samples")).select("l_orderkey", "l_linenumber", F.inline("metadata")).groupBy("field").agg(F.count("*").alias("n"), F.sum("v").alias("s"))


def r10_unpivot(spark, sf_dir):
    from tidewrack.plans.profiles import a44_crosstab

    x = a44_crosstab(spark, sf_dir)
    return x.unpivot("p_brand", ["economy", "large", "medium", "promo", "small", "standard"], "kind", "n").filter("n > 0")


def x2_env_bins(spark, sf_dir):
    e = occurrences(spark, sf_dir).groupBy("key").agg(F.collect_set("env").alias("e"))
    return e.groupBy(F.when(F.size("e") == 1, F.col("e")[0]).when(F.size("e") > 1, "multi_env").otherwise("unknown_env").alias("bin")).agg(F.count("*").alias("n"))


def j6_two_hop(spark, sf_dir):
    """Region of a customer by its nation, counted over orders."""
    o, c, n, r = (load(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    return o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy("r_name", "o_orderstatus").agg(F.count("*").alias("n"), F.countDistinct("c_custkey").alias("n_customers"))


QUERIES = {f.__name__: f for f in (
    j1_fallback_join, j14_alias_priority, j10_fuzzy_overlap, j12_ontology_overlap, j11_bucket_similarity, j13_set_overlap, j17_cde_lookup, f6_task_queue, f4_regex_filter, f10_semi_anti, f19_multi_env_exclusion, f23_targets_or_all, s1_s6_setops, s6_concat_dedup,
    c2_review_decisions, r8_reconcile, c1_canonical_edits, c8_expand_keys, j22_three_way_diff, r2_flatten_nested, r10_unpivot, x2_env_bins, j6_two_hop,
)}


def _sql() -> dict[str, str]:
    from tidewrack.plans.proxies import EVENT_FACTS, OCCURRENCES
    from tidewrack.plans.scalars import _SUFFIX, NAMES

    overlap = "e AS (SELECT l.{a}, r.{b}, l.na, r.nb, count(*) AS shared FROM (SELECT {a}, len(list_distinct(tokens)) AS na, unnest(list_distinct(tokens)) AS t FROM lhs) l JOIN (SELECT {b}, len(list_distinct(tokens)) AS nb, unnest(list_distinct(tokens)) AS t FROM rhs) r USING (t) GROUP BY ALL), s AS (SELECT *, shared / {f}(na, nb) AS score FROM e) SELECT {a}, {b}, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY {a} ORDER BY score DESC, {o}{b}) AS rn FROM s WHERE score >= {m}) WHERE rn = 1"
    comparable = "cmp AS (SELECT DISTINCT p_brand, name, trim(regexp_replace(" + _SUFFIX + ", '[_ ]+', '_', 'g'), '_') AS c FROM (SELECT p_brand, name, lower(trim(name)) AS t FROM names)), tok AS (SELECT *, list_distinct(list_filter(string_split(regexp_replace(regexp_replace(c, '([0-9])([^0-9_])', '\\1_\\2', 'g'), '([^0-9_])([0-9])', '\\1_\\2', 'g'), '_'), lambda t: t <> '')) AS tk FROM cmp)"
    return {
        "j1_fallback_join": "WITH p AS (SELECT p_partkey AS k, p_brand FROM part), x AS (SELECT 2 * l_partkey AS l_partkey, coalesce(a.p_brand, b.p_brand) AS brand FROM lineitem LEFT JOIN p a ON a.k = 2 * l_partkey LEFT JOIN p b ON b.k = l_suppkey) SELECT brand, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS s FROM x WHERE brand IS NOT NULL GROUP BY brand",
        "j14_alias_priority": "WITH f AS (SELECT split_part(p_name, ' ', 1) AS alias, split_part(p_name, ' ', 2) AS target, p_partkey AS ord, p_type FROM part), u AS (SELECT alias, target, ord FROM f UNION ALL SELECT target, target, ord FROM f UNION ALL SELECT upper(p_type), target, ord FROM f) SELECT lower(alias) AS alias, first(target ORDER BY lower(alias) <> lower(target), ord) AS target, count(DISTINCT target) AS n_targets FROM u GROUP BY lower(alias)",
        "j10_fuzzy_overlap": "WITH lhs AS (SELECT p_partkey, list_append(string_split(p_name, ' '), p_type) AS tokens FROM part), rhs AS (SELECT p_partkey AS match, tokens FROM lhs), " + overlap.format(a="p_partkey", b="match", f="least", o="match % 5 <> 0 DESC, ", m=0.5),
        "j12_ontology_overlap": "WITH lhs AS (SELECT p_partkey, string_split(p_name || ' ' || p_brand, ' ') AS tokens FROM part), rhs AS (SELECT p_partkey AS term, string_split(p_name || ' ' || p_type, ' ') AS tokens FROM part), " + overlap.format(a="p_partkey", b="term", f="greatest", o="", m=0.7),
        "j11_bucket_similarity": "WITH " + NAMES + ", " + comparable + " SELECT x.p_brand, x.name AS a, y.name AS b FROM tok x JOIN tok y ON x.p_brand = y.p_brand AND x.name < y.name WHERE x.c = y.c OR (len(x.tk) > 0 AND len(y.tk) > 0 AND len(list_intersect(x.tk, y.tk)) / len(list_distinct(list_concat(x.tk, y.tk))) >= 0.5) OR levenshtein(x.c, y.c) <= greatest(2, CAST(floor(least(length(x.c), length(y.c)) * 0.3) AS INT)) OR (least(length(x.c), length(y.c)) > 0 AND (contains(x.c, y.c) OR contains(y.c, x.c)) AND least(length(x.c), length(y.c)) / greatest(length(x.c), length(y.c)) >= 0.5)",
        "j13_set_overlap": "WITH o AS (SELECT p_brand || '/' || p_size AS g, list_sort(list_distinct(list(p_name))) AS s FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), n AS (SELECT 'new ' || p_brand || '/' || p_size AS g, list_sort(list_distinct(list(p_name))) AS s FROM part WHERE p_partkey % 2 = 1 GROUP BY 1) SELECT n.g AS new, CASE WHEN bool_or(o.s = n.s) THEN 'exact' WHEN count(o.g) > 0 THEN 'partial' ELSE 'new' END AS kind, count(o.g) AS n_old FROM n LEFT JOIN o ON list_has_any(o.s, n.s) GROUP BY n.g",
        "j17_cde_lookup": "WITH c0 AS (SELECT 'r' || n_regionkey AS env, 'n' || (n_nationkey % 7) AS key, 'norm' || n_nationkey AS normalizer, n_nationkey AS ord FROM nation WHERE n_nationkey < 15), c AS (SELECT env, key, arg_min(normalizer, ord) AS normalizer, min(ord) AS ord FROM c0 GROUP BY ALL), anyw AS (SELECT key, arg_min(normalizer, ord) AS normalizer FROM c GROUP BY key), r AS (SELECT 'r' || (c_nationkey % 5) AS env, 'n' || (c_custkey % 9) AS key FROM customer) SELECT r.env, r.key, coalesce(c.normalizer, anyw.normalizer, 'passthrough') AS normalizer, count(*) AS n FROM r LEFT JOIN c ON c.env = r.env AND c.key = r.key LEFT JOIN anyw ON anyw.key = r.key GROUP BY ALL",
        "f6_task_queue": "SELECT CASE WHEN upper(trim(source)) IN ('SRC1', 'SRC7') THEN 'excluded section' WHEN length(trim(text)) < 200 THEN 'short text' WHEN text IS NULL THEN 'no text' END AS reason, count(*) AS n FROM documents WHERE doc_id % 4 > 0 GROUP BY 1",
        "f4_regex_filter": "SELECT coalesce(text, '') = '' AS empty, regexp_matches(text, '(?i)\\b(token|license|the and)\\b') AS hit, count(*) AS n FROM documents GROUP BY ALL",
        "f10_semi_anti": "WITH x AS (SELECT c_mktsegment, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS w FROM customer) SELECT c_mktsegment, count(*) FILTER (w) AS n_with, nullif(count(*) FILTER (NOT w), 0) AS n_without FROM x GROUP BY c_mktsegment HAVING count(*) FILTER (w) > 0",
        "f19_multi_env_exclusion": "WITH " + EVENT_FACTS + ", m AS (SELECT paper, key FROM facts GROUP BY ALL HAVING count(DISTINCT env) > 3) SELECT key, count(DISTINCT paper) AS n_papers, count(*) AS n FROM facts ANTI JOIN m USING (paper, key) GROUP BY key",
        "f23_targets_or_all": "WITH h AS (SELECT DISTINCT p_partkey % 90 AS section, p_type AS target FROM part JOIN supplier ON s_suppkey = p_partkey % 90) SELECT section, target FROM h UNION ALL SELECT s_suppkey, target FROM supplier, (SELECT DISTINCT p_type AS target FROM part) WHERE s_suppkey NOT IN (SELECT section FROM h)",
        "s1_s6_setops": "WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') SELECT 'union' AS op, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*), CAST(sum(o_custkey) AS BIGINT) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*), CAST(sum(o_custkey) AS BIGINT) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'minus', count(*), CAST(sum(o_custkey) AS BIGINT) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'both parts', count(*), CAST(sum(o_custkey) AS BIGINT) FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) INTERSECT (SELECT * FROM a INTERSECT SELECT * FROM b)) UNION ALL SELECT 'no part', count(*), CAST(sum(o_custkey) AS BIGINT) FROM (SELECT * FROM a EXCEPT ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION (SELECT * FROM a INTERSECT SELECT * FROM b)))",
        "s6_concat_dedup": "SELECT p_name, p_partkey, src FROM (SELECT p_name, p_partkey, CAST(p_size >= 20 AS INT) AS src, row_number() OVER (PARTITION BY p_name ORDER BY p_size >= 20, p_partkey) AS rn FROM part) WHERE rn = 1",
        "c2_review_decisions": "WITH m AS (SELECT DISTINCT p_name AS field, CASE WHEN length(p_name) % 2 = 0 THEN 'UNMAPPED' ELSE 'slot_' || p_name END AS slot FROM part), d AS (SELECT p_name AS field, ['FORCE_SLOT', 'EXCLUDE', 'FORCE_UNMAPPED', 'FORCE_SLOT'][p_partkey % 4 + 1] AS action, lower(p_type) AS t, p_partkey AS ord FROM part WHERE p_partkey < 40), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY CASE action WHEN 'EXCLUDE' THEN 0 WHEN 'FORCE_UNMAPPED' THEN 1 ELSE 2 END, ord) AS rn FROM d) WHERE rn = 1) SELECT m.field, CASE WHEN action = 'FORCE_UNMAPPED' THEN 'UNMAPPED' WHEN action = 'FORCE_SLOT' AND slot <> 'UNMAPPED' THEN t ELSE slot END AS slot FROM m LEFT JOIN o USING (field) WHERE action IS DISTINCT FROM 'EXCLUDE'",
        "r8_reconcile": "WITH g AS (SELECT l_orderkey % 500 AS family, l_partkey % 40 AS member, l_suppkey AS grp, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY ALL), m AS (SELECT family, member FROM range(500) a(family), range(0, 60, 2) b(member)) SELECT m.family, m.member, first(g.grp ORDER BY g.grp, g.pos) AS grp FROM m LEFT JOIN g USING (family, member) GROUP BY ALL",
        "c1_canonical_edits": "WITH s AS (SELECT DISTINCT p_type AS canonical, p_name AS alias FROM part), r AS (SELECT CASE WHEN canonical IN ('LARGE', 'MEDIUM') THEN 'BIG' WHEN canonical = 'ECONOMY' AND alias IN ('small ring', 'red ring', 'blue ring') THEN 'ECONOMY-RING' ELSE canonical END AS canonical, alias FROM s WHERE NOT (canonical = 'SMALL' AND alias = 'blue bolt')) SELECT canonical, count(DISTINCT alias) AS n, min(alias) AS first FROM r GROUP BY canonical",
        "c8_expand_keys": "WITH t AS (SELECT DISTINCT lower(p_type) AS k FROM part WHERE p_partkey < 30 AND lower(p_type) <> 'small') SELECT coalesce('norm_' || k, p_type) AS key, p_type AS raw_key_original, count(*) AS n FROM part LEFT JOIN t ON k = lower(p_type) GROUP BY ALL",
        "j22_three_way_diff": "WITH b AS (SELECT p_partkey, p_type FROM part WHERE p_partkey % 5 > 0), a AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_type END AS now FROM part WHERE p_partkey % 7 > 0) SELECT CASE WHEN b.p_type IS NULL THEN 'new' WHEN a.k IS NULL THEN 'retired' WHEN b.p_type IS NOT DISTINCT FROM a.now THEN 'same' ELSE 'changed' END AS kind, count(*) AS n FROM b FULL JOIN a ON a.k = b.p_partkey GROUP BY 1",
        "r2_flatten_nested": "SELECT field, count(*) AS n, CAST(sum(v) AS BIGINT) AS s FROM (SELECT 'part' AS field, l_partkey AS v FROM lineitem UNION ALL SELECT 'supp', l_suppkey FROM lineitem) GROUP BY field",
        "r10_unpivot": "SELECT p_brand, lower(p_type) AS kind, count(*) AS n FROM part WHERE p_type IN ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD') GROUP BY ALL",
        "x2_env_bins": "WITH " + OCCURRENCES + ", e AS (SELECT key, list_distinct(list(env)) AS e FROM occ GROUP BY key) SELECT CASE WHEN len(e) = 1 THEN e[1] WHEN len(e) > 1 THEN 'multi_env' ELSE 'unknown_env' END AS bin, count(*) AS n FROM e GROUP BY 1",
        "j6_two_hop": "SELECT r_name, o_orderstatus, count(*) AS n, count(DISTINCT c_custkey) AS n_customers FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    }


SQL = _sql()
