"""Composites: papers and their relations, slots, sections, coverage, rendering; each on the proxies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewrack.functions import names as N
from tidewrack.functions import text as T
from tidewrack.operators import ranking as R
from tidewrack.operators import sampling as S
from tidewrack.plans.proxies import load


def a4_concat_parts(spark, sf_dir):
    """Turns of a conversation as one text, in order."""
    c = load(spark, sf_dir, "conversations")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n")
    return c.groupBy("conv_id").agg(F.md5(joined.cast("binary")).alias("digest"), F.count("*").alias("n_parts"))


def _relations(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    names = ["label-metadata", "accession-metadata", "accession-label", "accession-label-metadata", "unknown"]
    return li.select(F.col("l_orderkey").alias("pmid"), F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("l_partkey") % 5).cast("int") + 1).alias("relation"), F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("SRR"), "l_suppkey")).otherwise(F.concat(F.lit("X"), "l_suppkey")).alias("accession"))


def a5_relation_flags(spark, sf_dir):
    """Modes of a paper: A, B, C; relations of accessions count only with an accession of an archive."""
    r = _relations(spark, sf_dir)
    good = F.size(T.accessions(F.col("accession"))) > 0
    flag = lambda name, need: F.coalesce(F.bool_or((F.col("relation") == name) & (good if need else F.lit(True))), F.lit(False))
    f = r.groupBy("pmid").agg(flag("accession-metadata", True).alias("a"), flag("accession-label-metadata", True).alias("b"), flag("accession-label", True).alias("al"), flag("label-metadata", False).alias("lm"))
    modes = F.concat(F.when(F.col("a"), "A").otherwise(""), F.when(F.col("b"), "B").otherwise(""), F.when(F.col("al") & F.col("lm"), "C").otherwise(""))
    return f.select("pmid", F.when(modes == "", "none").otherwise(modes).alias("build_mode")).groupBy("build_mode").agg(F.count("*").alias("n"))


def w7_best_relation(spark, sf_dir):
    from tidewrack.constants import RELATIONS

    r = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.element_at(F.array(*[F.lit(x) for x in RELATIONS]), (F.col("l_partkey") % 5).cast("int") + 1).alias("relation"))
    rank = F.array_position(F.array(*[F.lit(x) for x in RELATIONS]), F.col("relation"))
    return R.best_by_priority(r.withColumn("ord", F.struct("l_linenumber", "l_partkey", "l_suppkey")), "l_orderkey", "relation", rank, "ord").select("l_orderkey", "relation", F.col("priority").cast("bigint").alias("priority"))


def a8_side_tags(spark, sf_dir):
    """Tags of decomposed names by brand, unpivoted."""
    from tidewrack.plans.scalars import _names

    d = _names(spark, sf_dir).select("p_brand", T.decompose(F.col("name")).alias("d")).select("p_brand", "d.stat", "d.unit", "d.qualifier", "d.isotope", "d.aggregation")
    tags = d.unpivot("p_brand", ["stat", "unit", "qualifier", "isotope", "aggregation"], "tag", "value")
    return tags.filter("value IS NOT NULL").groupBy("p_brand", "tag", "value").agg(F.count("*").alias("n"))


def a15_rule_hits(spark, sf_dir):
    from tidewrack.plans.scalars import _names

    d = _names(spark, sf_dir).select(T.decompose(F.col("name")).alias("d"))
    return d.agg(*[F.count(f"d.{t}").alias(t) for t in ("stat", "unit", "qualifier", "isotope", "aggregation", "replicate", "taxon")], F.count_if(F.size("d.substances") > 0).alias("substance"))


def a38_root_collisions(spark, sf_dir):
    from tidewrack.plans.scalars import _names

    d = _names(spark, sf_dir).select("name", T.decompose(F.col("name"))["root"].alias("root")).distinct()
    sizes = d.groupBy("root").agg(F.count("*").alias("n_keys"))
    return sizes.groupBy("n_keys").agg(F.count("*").alias("n_roots"), F.min("root").alias("first"))


def a18_slot_frequency(spark, sf_dir):
    """Slots (brands) over fields (part names): papers (orders) of any of their fields."""
    f = load(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("slot"), F.col("p_name").alias("field"))
    li = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").alias("pmid"))
    x = f.join(li, "p_partkey").groupBy("slot").agg(F.countDistinct("pmid").alias("n_papers"), F.countDistinct("field").alias("n_fields"))
    return x.withColumn("pct", F.round(100 * F.col("n_papers") / li.agg(F.countDistinct("pmid").alias("n")).scalar(), 2))


def a22_review_queue(spark, sf_dir):
    """Slots by review priority: few contributing fields first, then papers."""
    s = a18_slot_frequency(spark, sf_dir)
    prio = F.when(F.col("pct") >= 25, "high").when(F.col("n_fields") < 35, "medium").otherwise("low")
    rank = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    x = s.withColumn("priority", prio)
    return x.select("slot", "priority", F.row_number().over(Window.orderBy(rank, F.col("n_papers").desc(), "slot")).alias("place"))


def a45_value_counts(spark, sf_dir):
    p = load(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("n_brands"))
    return p.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def a41_size_histogram(spark, sf_dir):
    n = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    b = F.when(F.col("n") == 1, "1").when(F.col("n") == 2, "2").when(F.col("n") <= 5, "3-5").when(F.col("n") <= 10, "6-10").when(F.col("n") <= 20, "11-20").otherwise(">20")
    return n.groupBy(b.alias("size")).agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_members"))


def a30_success_table(spark, sf_dir):
    """Rate of each supplier and its first failing orders."""
    o = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", (F.col("l_returnflag") == "R").alias("good"))
    one = o.groupBy("l_suppkey", "l_orderkey").agg(F.bool_or("good").alias("good"))
    rate = one.groupBy("l_suppkey").agg(F.count("*").alias("tries"), F.count_if("good").alias("successes"), F.round(F.count_if("good") / F.count("*"), 4).alias("rate"))
    few = R.top(one.filter("NOT good"), ["l_suppkey"], [F.col("l_orderkey")], 5).groupBy("l_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_orderkey")), lambda x: x.cast("string")), ";").alias("failures"))
    return rate.join(few, "l_suppkey", "left")


def j5_alias_members(spark, sf_dir):
    """Fields expanded by the first group that holds them: papers of all members.

    Fields of one first group have the same papers, which are counted once for the group. Lines of names that the same
    first groups hold count as one name's before they are spread over these groups.
    """
    p = load(spark, sf_dir, "part")
    groups = p.select(F.col("p_brand").alias("grp"), F.lower("p_name").alias("member")).distinct()
    first = groups.groupBy("member").agg(F.min("grp").alias("grp"))
    held = groups.join(first.select("grp").distinct(), "grp", "left_semi").groupBy(F.col("member").alias("alias")).agg(F.array_sort(F.collect_set("grp")).alias("grps"))
    parts = p.select("p_partkey", F.lower("p_name").alias("alias")).join(held, "alias").select("p_partkey", "grps").distinct()
    papers = parts.join(load(spark, sf_dir, "lineitem"), F.col("p_partkey") == F.col("l_partkey")).select("grps", F.col("l_orderkey").alias("pmid")).distinct()
    counts = papers.select(F.explode("grps").alias("grp"), "pmid").groupBy("grp").agg(F.countDistinct("pmid").alias("n_papers"))
    return first.join(counts, "grp").select("member", "n_papers")


def j8_compress_runs(spark, sf_dir):
    """Lines of orders with many lines are replaced by their order and customer."""
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    n = li.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    x = li.join(n, "l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    to = F.when(F.col("n") > 5, F.array(F.concat(F.lit("o"), "l_orderkey"), F.concat(F.lit("c"), "o_custkey"))).otherwise(F.array(F.concat_ws(".", F.lit("l"), "l_orderkey", "l_linenumber", "l_partkey")))
    return x.select(F.explode(to).alias("accession")).distinct().groupBy(F.left("accession", F.lit(1)).alias("kind")).agg(F.count("*").alias("n"))


def j15_section_index(spark, sf_dir):
    """Target (word), paper, section: distinct, counted."""
    d = load(spark, sf_dir, "documents").select("doc_id", "source", F.explode(F.array("lang", "source")).alias("target"))
    return d.select("target", "doc_id", "source").distinct().groupBy("target").agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_sections"))


def j19_target_samples(spark, sf_dir):
    """Customers reached directly, over orders, or over their nation."""
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    own = c.filter("c_acctbal < 0").select("c_custkey")
    via = o.filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    nation = c.join(load(spark, sf_dir, "supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("c_nationkey")).distinct(), "c_nationkey").select("c_custkey")
    return own.union(via).union(nation).distinct().agg(F.count("*").alias("n"), F.sum("c_custkey").alias("s"))


def j20_rollups(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ";").alias("priorities"), F.min_by("o_orderstatus", "o_orderkey").alias("first_status"), F.count("*").alias("n"))


def j25_longest_text(spark, sf_dir):
    """The longest turn of each conversation and role, first on ties, where a role is needed."""
    c = load(spark, sf_dir, "conversations").filter("role <> 'system'")
    return c.groupBy("conv_id", "role").agg(F.max_by("turn", F.struct(F.length("text").alias("n"), (-F.col("turn")).alias("t"))).alias("turn"), F.max(F.length("text")).alias("n_chars"))


def j30_grouped_children(spark, sf_dir):
    """Parts under the part of a tenth of their key, where that one exists."""
    p = load(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_partkey") / 10).alias("parent"))
    heads = p.select(F.col("p_partkey").alias("parent"), F.lit(True).alias("known"))
    x = p.join(heads, "parent", "left")
    return x.groupBy(F.coalesce("known", F.lit(False)).alias("has_parent")).agg(F.count("*").alias("n"), F.countDistinct("parent").alias("n_parents"))


def f3_sections(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.element_at(F.array(*[F.lit(x) for x in ("Methods", "materials and methods", "TABLE", "appendix", "odd", "", " Findings ")]), (F.col("doc_id") % 7).cast("int") + 1).alias("s"))
    return d.groupBy(N.section(F.col("s")).alias("section"), N.is_excluded_section(F.trim("s")).alias("excluded")).agg(F.count("*").alias("n"))


def f12_verdicts(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    raw = F.element_at(F.array(F.col("p_name"), F.col("p_retailprice").cast("string"), F.concat(F.lit("illumina "), "p_name"), F.concat(F.lit("growth "), "p_name"), F.concat("p_name", F.lit(" 2019")), F.lit("pH"), F.lit("!"), F.repeat(F.lit("long"), F.lit(20))), (F.col("p_partkey") % 8).cast("int") + 1)
    return p.select(N.verdict(raw, F.when(F.col("p_size") < 5, " ").otherwise(F.col("p_type"))).alias("v")).groupBy("v.verdict").agg(F.count("*").alias("n"))


def w4_representative(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_brand", F.element_at(F.array(F.replace("p_name", F.lit(" "), F.lit("_")), F.replace("p_name", F.lit(" "), F.lit("")), F.concat(F.initcap("p_type"), F.lit("Name")), F.concat(F.split("p_name", " ")[0], F.lit("%"))), (F.col("p_partkey") % 4).cast("int") + 1).alias("name"), (F.col("p_partkey") % 101).alias("papers"))
    return N.representatives(p, "p_brand", "name", "papers")


def w14_short_aliases(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_brand", "p_name").distinct()
    return R.top(p, ["p_brand"], [F.length("p_name"), F.lower("p_name")], 12).groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "p_name"))), lambda x: x["p_name"]), ", ").alias("aliases"))


def w15_fanout(spark, sf_dir):
    p = load(spark, sf_dir, "part").groupBy("p_name").agg(F.countDistinct("p_brand").alias("fanout")).filter("fanout >= 15")
    return p.orderBy(F.col("fanout").desc(), "p_name").limit(25)


def sm3_section_sample(spark, sf_dir):
    """Two sections for each target, and the targets of each chosen section."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.array("lang", "source")).alias("target"))
    chosen = S.stratified(d, ["target"], "doc_id", 2).select("doc_id").distinct()
    x = d.join(chosen, "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n"))
    return x.agg(F.min("n").alias("least"), F.max("n").alias("most"))


def sm5_strata(spark, sf_dir):
    """All combinations of segment, priority and era (dimensions are short lists), with their sizes, empty ones included."""
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    era = F.when(F.year("o_orderdate") <= 1996, "early").when(F.year("o_orderdate") <= 1998, "middle").otherwise("late")
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("c_mktsegment", "o_orderstatus", era.alias("era")).groupBy("c_mktsegment", "o_orderstatus", "era").agg(F.count("*").alias("n"))
    dims = c.select("c_mktsegment").distinct().withColumn("o_orderstatus", F.explode(F.array(F.lit("F"), F.lit("O"), F.lit("P"), F.lit("X")))).withColumn("era", F.explode(F.array(F.lit("early"), F.lit("middle"), F.lit("late"))))
    return dims.join(x, ["c_mktsegment", "o_orderstatus", "era"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def c3_merge_kinds(spark, sf_dir):
    """Approved merges applied through chains, counted by what they end in."""
    from tidewrack.operators.graph import compressed

    p = load(spark, sf_dir, "part")
    m = spark.createDataFrame([("ECONOMY", "SMALL"), ("SMALL", "MEDIUM"), ("PROMO", "LARGE")], "s string, t string")
    end = compressed(m, "s", "t").withColumnRenamed("s", "p_type")
    return p.join(F.broadcast(end), "p_type", "left").groupBy(F.coalesce("t", "p_type").alias("kind")).agg(F.count("*").alias("n"))


def c7_pruned_schema(spark, sf_dir):
    from tidewrack.plans.scalars import m16_prune

    return m16_prune(spark, sf_dir).groupBy("decision").agg(F.count("*").alias("n"))


def r9_mapping_validation(spark, sf_dir):
    """Answers matched to fields and slots in any case; the first of each field; missing ones UNMAPPED."""
    p = load(spark, sf_dir, "part")
    fields = p.select(F.col("p_name").alias("field")).distinct()
    slots = p.select(F.col("p_type").alias("slot")).distinct()
    answers = p.select(F.upper("p_name").alias("f"), F.when(F.col("p_size") % 4 == 0, "nonsense").otherwise(F.lower("p_type")).alias("s"), F.col("p_partkey").alias("ord"))
    ok = answers.join(slots, F.lower("s") == F.lower("slot")).groupBy(F.lower("f").alias("k")).agg(F.min_by("slot", "ord").alias("slot"))
    return fields.join(ok, F.lower("field") == F.col("k"), "left").select("field", F.coalesce("slot", F.lit("UNMAPPED")).alias("slot"))


def u1_paper_environment(spark, sf_dir):
    """Model calls behind the deterministic stub: environments of documents."""
    from tidewrack.operators.completion import STAGES, LengthStub, complete

    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    got = complete(d, "doc_id", F.col("text"), STAGES["paper_environment"], lambda: LengthStub("label", ["Open_ocean", "Coastal_waters", "Lake", "Wetlands", "Others"]))
    return got.groupBy(F.col("a.label").alias("label"), "is_valid").agg(F.count("*").alias("n"))


def v1_funnel(spark, sf_dir):
    from tidewrack.plans.profiles import _vectors

    v = _vectors(spark, sf_dir)
    return v.agg(F.count("*").alias("all_keys"), F.count_if(F.col("total_papers") >= 3).alias("mainstream"), F.count_if(F.col("total_papers") >= 10).alias("frequent"), F.count_if(F.col("n_envs_present") == 4).alias("everywhere"))


QUERIES = {f.__name__: f for f in (
    a4_concat_parts, a5_relation_flags, w7_best_relation, a8_side_tags, a15_rule_hits, a38_root_collisions, a18_slot_frequency, a22_review_queue, a45_value_counts, a41_size_histogram, a30_success_table, j5_alias_members, j8_compress_runs, j15_section_index, j19_target_samples,
    j20_rollups, j25_longest_text, j30_grouped_children, f3_sections, f12_verdicts, w4_representative, w14_short_aliases, w15_fanout, sm3_section_sample, sm5_strata, c3_merge_kinds, c7_pruned_schema, r9_mapping_validation, u1_paper_environment, v1_funnel,
)}


def _sql() -> dict[str, str]:
    from tidewrack.plans.profiles import VECTORS
    from tidewrack.plans.scalars import SQL as SCALARS

    deco = SCALARS["t7_decompose"]
    head, tail = deco.rsplit(" SELECT p_partkey, root", 1)
    dd = head + ", dd AS MATERIALIZED (SELECT p_partkey, root" + tail + ")"
    rel = "r AS (SELECT l_orderkey AS pmid, ['label-metadata', 'accession-metadata', 'accession-label', 'accession-label-metadata', 'unknown'][l_partkey % 5 + 1] AS relation, l_suppkey % 3 = 0 AS good FROM lineitem)"
    slot = "sf AS (SELECT p_brand AS slot, count(DISTINCT l_orderkey) AS n_papers, count(DISTINCT p_name) AS n_fields, round(100 * count(DISTINCT l_orderkey) / (SELECT count(DISTINCT l_orderkey) FROM lineitem), 2) AS pct FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_brand)"
    return {
        "a4_concat_parts": "SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS digest, count(*) AS n_parts FROM conversations GROUP BY conv_id",
        "a5_relation_flags": "WITH " + rel + ", f AS (SELECT pmid, bool_or(relation = 'accession-metadata' AND good) AS a, bool_or(relation = 'accession-label-metadata' AND good) AS b, bool_or(relation = 'accession-label' AND good) AS al, bool_or(relation = 'label-metadata') AS lm FROM r GROUP BY pmid) SELECT coalesce(nullif(CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN al AND lm THEN 'C' ELSE '' END, ''), 'none') AS build_mode, count(*) AS n FROM f GROUP BY 1",
        "w7_best_relation": "SELECT l_orderkey, first(['unknown', 'label-metadata', 'accession-metadata', 'accession-label', 'accession-label-metadata'][l_partkey % 5 + 1] ORDER BY l_partkey % 5 DESC, l_linenumber) AS relation, max(l_partkey % 5 + 1) AS priority FROM lineitem GROUP BY l_orderkey",
        "a8_side_tags": dd + " SELECT p_brand, tag, value, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT p_partkey, '{t}' AS tag, {t} AS value FROM dd" for t in ("stat", "unit", "qualifier", "isotope", "aggregation")) + ") JOIN part USING (p_partkey) WHERE value IS NOT NULL GROUP BY ALL",
        "a15_rule_hits": dd + " SELECT " + ", ".join(f"count({t}) AS {t}" for t in ("stat", "unit", "qualifier", "isotope", "aggregation", "replicate", "taxon")) + ", count(*) FILTER (substances <> '') AS substance FROM dd",
        "a38_root_collisions": dd + ", u AS (SELECT DISTINCT name, root FROM dd JOIN names USING (p_partkey)), s AS (SELECT root, count(*) AS n_keys FROM u GROUP BY root) SELECT n_keys, count(*) AS n_roots, min(root) AS first FROM s GROUP BY n_keys",
        "a18_slot_frequency": "WITH " + slot + " SELECT slot, n_papers, n_fields, pct FROM sf",
        "a22_review_queue": "WITH " + slot + ", q AS (SELECT *, CASE WHEN pct >= 25 THEN 'high' WHEN n_fields < 35 THEN 'medium' ELSE 'low' END AS priority FROM sf) SELECT slot, priority, row_number() OVER (ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, n_papers DESC, slot) AS place FROM q",
        "a45_value_counts": "SELECT p_type, count(*) AS n, count(DISTINCT p_brand) AS n_brands, round(count(*) / (SELECT count(*) FROM part), 6) AS share FROM part GROUP BY p_type",
        "a41_size_histogram": "WITH s AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT CASE WHEN n <= 2 THEN CAST(n AS VARCHAR) WHEN n <= 5 THEN '3-5' WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' ELSE '>20' END AS size, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_members FROM s GROUP BY 1",
        "a30_success_table": "WITH o AS (SELECT l_suppkey, l_orderkey, bool_or(l_returnflag = 'R') AS good FROM lineitem GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, good ORDER BY l_orderkey) AS rn FROM o) SELECT l_suppkey, count(*) AS tries, count(*) FILTER (good) AS successes, round(count(*) FILTER (good) / count(*), 4) AS rate, string_agg(CAST(l_orderkey AS VARCHAR), ';' ORDER BY l_orderkey) FILTER (NOT good AND rn <= 5) AS failures FROM f GROUP BY l_suppkey",
        "j5_alias_members": "WITH g AS (SELECT DISTINCT p_brand AS grp, lower(p_name) AS member FROM part), f AS (SELECT member, min(grp) AS grp FROM g GROUP BY member), pp AS (SELECT DISTINCT lower(p_name) AS alias, l_orderkey AS pmid FROM part JOIN lineitem ON p_partkey = l_partkey), e AS (SELECT f.member, g.member AS alias FROM f JOIN g USING (grp)) SELECT member, count(DISTINCT pmid) AS n_papers FROM e JOIN pp USING (alias) GROUP BY member",
        "j8_compress_runs": "WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey), a AS (SELECT 'o' || l_orderkey AS a FROM n JOIN orders ON o_orderkey = l_orderkey WHERE n > 5 UNION SELECT 'c' || o_custkey FROM n JOIN orders ON o_orderkey = l_orderkey WHERE n > 5 UNION SELECT 'l.' || l.l_orderkey || '.' || l_linenumber || '.' || l_partkey FROM lineitem l JOIN n USING (l_orderkey) JOIN orders ON o_orderkey = l.l_orderkey WHERE n <= 5) SELECT a[1] AS kind, count(*) AS n FROM a GROUP BY 1",
        "j15_section_index": "SELECT target, count(*) AS n, count(DISTINCT source) AS n_sections FROM (SELECT DISTINCT unnest([lang, source]) AS target, doc_id, source FROM documents) GROUP BY target",
        "j19_target_samples": "SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS s FROM (SELECT c_custkey FROM customer WHERE c_acctbal < 0 UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' UNION SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000))",
        "j20_rollups": "SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ';') AS priorities, arg_min(o_orderstatus, o_orderkey) AS first_status, count(*) AS n FROM orders GROUP BY o_custkey",
        "j25_longest_text": "SELECT conv_id, role, first(turn ORDER BY length(text) DESC, turn) AS turn, max(length(text)) AS n_chars FROM conversations WHERE role <> 'system' GROUP BY ALL",
        "j30_grouped_children": "WITH p AS (SELECT p_partkey, p_partkey // 10 AS parent FROM part) SELECT parent IN (SELECT p_partkey FROM p) AS has_parent, count(*) AS n, count(DISTINCT parent) AS n_parents FROM p GROUP BY 1",
        "f3_sections": "SELECT ['METHODS', 'METHODS', 'TABLE', 'SUPPL', 'unknown', 'unknown', 'RESULTS'][doc_id % 7 + 1] AS section, doc_id % 7 = 3 AS excluded, count(*) AS n FROM documents GROUP BY ALL",
        "f12_verdicts": "SELECT CASE WHEN p_partkey % 8 = 6 THEN 'dropped: no key' WHEN p_size < 5 THEN 'dropped: no evidence' ELSE ['accepted', 'dropped: value', 'dropped: instrument', 'dropped: experiment', 'review: digits', 'accepted', '', 'review: long'][p_partkey % 8 + 1] END AS verdict, count(*) AS n FROM part GROUP BY 1",
        "w14_short_aliases": "WITH a AS (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name), lower(p_name)) AS rn FROM (SELECT DISTINCT p_brand, p_name FROM part)) SELECT p_brand, string_agg(p_name, ', ' ORDER BY rn) FILTER (rn <= 12) AS aliases FROM a GROUP BY p_brand",
        "w15_fanout": "SELECT p_name, count(DISTINCT p_brand) AS fanout FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) >= 15 ORDER BY fanout DESC, p_name LIMIT 25",
        "sm5_strata": "WITH x AS (SELECT c_mktsegment, o_orderstatus, CASE WHEN year(o_orderdate) <= 1996 THEN 'early' WHEN year(o_orderdate) <= 1998 THEN 'middle' ELSE 'late' END AS era FROM orders JOIN customer ON o_custkey = c_custkey), c AS (SELECT c_mktsegment, o_orderstatus, era, count(*) AS n FROM x GROUP BY ALL) SELECT s.c_mktsegment, o.o_orderstatus, e.era, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT c_mktsegment FROM customer) s CROSS JOIN (VALUES ('F'), ('O'), ('P'), ('X')) o(o_orderstatus) CROSS JOIN (VALUES ('early'), ('middle'), ('late')) e(era) LEFT JOIN c ON c.c_mktsegment = s.c_mktsegment AND c.o_orderstatus = o.o_orderstatus AND c.era = e.era",
        "c3_merge_kinds": "SELECT CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'MEDIUM' WHEN p_type = 'PROMO' THEN 'LARGE' ELSE p_type END AS kind, count(*) AS n FROM part GROUP BY 1",
        "c7_pruned_schema": "SELECT decision, count(*) AS n FROM (" + SCALARS["m16_prune"] + ") GROUP BY decision",
        "r9_mapping_validation": "WITH a AS (SELECT lower(p_name) AS k, CASE WHEN p_size % 4 > 0 THEN p_type END AS slot, p_partkey AS ord FROM part), o AS (SELECT k, arg_min(slot, ord) AS slot FROM a WHERE slot IS NOT NULL GROUP BY k) SELECT field, coalesce(slot, 'UNMAPPED') AS slot FROM (SELECT DISTINCT p_name AS field FROM part) LEFT JOIN o ON k = lower(field)",
        "u1_paper_environment": "SELECT ['Open_ocean', 'Coastal_waters', 'Lake', 'Wetlands', 'Others'][(length('Which environments does this abstract sample?') + 1 + least(length(coalesce(text, '')), 2000)) % 5 + 1] AS label, true AS is_valid, count(*) AS n FROM documents GROUP BY ALL",
        "v1_funnel": "WITH " + VECTORS + " SELECT count(*) AS all_keys, count(*) FILTER (total_papers >= 3) AS mainstream, count(*) FILTER (total_papers >= 10) AS frequent, count(*) FILTER (n_envs_present = 4) AS everywhere FROM vec",
    }


SQL = _sql()
