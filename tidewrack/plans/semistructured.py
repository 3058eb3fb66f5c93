"""JSON, tables in texts, chunks, evidence, incremental state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewrack.functions import evidence as E
from tidewrack.functions import json_repair as J
from tidewrack.operators import tables as TP
from tidewrack.plans.proxies import load


def js_props(spark, sf_dir):
    k = F.from_json("props", "k INT")["k"]
    return load(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _answers(spark, sf_dir):
    """Model answers with JSON of orders, spoiled in the usual ways."""
    o = load(spark, sf_dir, "orders")
    body = F.concat(F.lit('{"key": "'), "o_orderkey", F.lit('", "status": "'), "o_orderstatus", F.lit('"'))
    spoiled = [
        F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("}\n```\nDone.")), F.concat(body, F.lit(",}")), F.concat(body, F.lit("} {\"key\": \"x\"}")),
        F.concat(F.lit("[ "), body, F.lit("}, ] and so on")), F.concat(F.lit("Answer: "), body), F.lit("no answer at all"),
    ]
    return o.select("o_orderkey", "o_orderstatus", F.element_at(F.array(*spoiled), (F.col("o_orderkey") % 6).cast("int") + 1).alias("answer"))


def js10_repair(spark, sf_dir):
    x = _answers(spark, sf_dir).select("o_orderkey", J.extracted(F.col("answer"), ["key", "status"]).alias("j"))
    first = F.from_json("j", "array<struct<key: string, status: string>>")[0]
    return x.select("o_orderkey", first["key"].alias("key"), first["status"].alias("status"))


def js1_clean(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", J.cleaned(F.concat(F.lit("{“a”：1}  {‘b’，"), F.col("o_orderkey").cast("string"), F.lit("}] ["))).alias("text"))


def _sheets(spark, sf_dir):
    """Orders as tab-separated tables of their lines."""
    li = load(spark, sf_dir, "lineitem")
    row = F.concat_ws("\t", F.concat(F.lit("SRR"), "l_orderkey", "l_linenumber"), F.concat(F.lit("s"), "l_linenumber"), F.col("l_quantity").cast("int"), F.when(F.col("l_partkey") % 5 == 0, "NA").otherwise(F.col("l_partkey").cast("string")))
    g = li.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", row.alias("row")))), lambda x: x["row"]), "\r\n").alias("body"))
    return g.select("l_orderkey", F.concat(F.lit("Table 1\r\nRun accession\tSample label\tDepth (m)\tPart\r\n"), "body").alias("text"))


def tp1_tp2_tables(spark, sf_dir):
    t = F.col("text")
    return _sheets(spark, sf_dir).groupBy(TP.is_table(t).alias("is_table"), TP.columns(t).alias("n_columns")).agg(F.count("*").alias("n"))


def tp4_table_extract(spark, sf_dir):
    c = TP.cells(_sheets(spark, sf_dir), "l_orderkey", "text", F.array(F.lit("depth"), F.lit("part")))
    r = TP.relations(c, "l_orderkey")
    return r.groupBy("field").agg(F.count("*").alias("n"), F.countDistinct("accession").alias("n_accessions"), F.sum(F.col("value").cast("bigint")).alias("total"), F.min("label").alias("first_label"))


def tp6_best_reading(spark, sf_dir):
    """Tables of which every other one has its fields as lines."""
    li = load(spark, sf_dir, "lineitem").filter("l_quantity <= 40")
    part = F.when(F.col("l_partkey") % 5 == 0, "NA").otherwise(F.col("l_partkey").cast("string"))
    g = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.concat(F.lit("SRR"), "l_orderkey", "l_linenumber").alias("run"), F.concat(F.lit("s"), "l_linenumber").alias("label"), F.col("l_quantity").cast("int").cast("string").alias("depth"), part.alias("part")))).alias("x"))
    names = ["Run accession", "Sample label", "Depth (m)", "Part"]
    column = lambda n: F.transform("x", lambda r: r[n])
    turned = F.concat_ws("\n", *[F.concat_ws("\t", F.lit(n), F.array_join(column(c), "\t")) for n, c in zip(names, ("run", "label", "depth", "part"), strict=True)])
    upright = F.concat_ws("\n", F.lit("\t".join(names)), F.array_join(F.transform("x", lambda r: F.concat_ws("\t", r["run"], r["label"], r["depth"], r["part"])), "\n"))
    sheets = g.filter(F.size("x") >= 2).select("l_orderkey", F.when(F.col("l_orderkey") % 2 == 0, upright).otherwise(turned).alias("text"))
    r = TP.best_relations(sheets, "l_orderkey", "text", F.array(F.lit("depth"), F.lit("part")))
    return r.groupBy("turned", "field").agg(F.count("*").alias("n"), F.countDistinct("accession").alias("n_accessions"), F.sum(F.col("value").cast("bigint")).alias("total"))


def t16_chunks(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "text", F.explode(E.chunks(F.col("text"), 2000, 150)).alias("c"))
    return d.select("doc_id", "c.start", "c.end", F.md5(F.substring(F.col("text"), F.col("c.start") + 1, F.col("c.end") - F.col("c.start")).cast("binary")).alias("hash"))


def t18_evidence(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "text", E.evidence(F.col("text"), F.array(F.lit("token"), F.lit("the"), F.lit("der"))).alias("e"))
    return d.select("doc_id", "e.start", "e.end", F.md5(E.quoted(F.col("text"), F.col("e.start"), F.col("e.end"), 300).cast("binary")).alias("quote"))


def t19_validated(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    v = E.validated(F.lit(-20) + (F.col("doc_id") % 40).cast("int"), F.length("text") + 30 - (F.col("doc_id") % 90).cast("int"), F.col("text"), 40, 3000)
    return d.select("doc_id", v.alias("v")).select("doc_id", "v.start", "v.end")


def st1_resume(spark, sf_dir):
    """Work that is left after a first run: keys without a result, and the last result of each key."""
    from tidewrack.streaming.checkpoints import merged, remaining

    e = load(spark, sf_dir, "events").select(F.col("event_id").alias("key"), "event_type", F.col("user_id").alias("group"))
    done = e.filter("key % 3 = 0").select("key", F.lit("first").alias("result"), F.lit(1).alias("version"))
    again = e.filter("key % 9 = 0").select("key", F.lit("second").alias("result"), F.lit(2).alias("version"))
    state = merged(done, again, ["key"], "version")
    left = remaining(e, state, "key").agg(F.count("*").alias("n"), F.lit("left").alias("what"))
    return left.unionByName(state.groupBy(F.col("result").alias("what")).agg(F.count("*").alias("n")))


QUERIES = {f.__name__: f for f in (js_props, js10_repair, js1_clean, tp1_tp2_tables, tp4_table_extract, tp6_best_reading, t16_chunks, t18_evidence, t19_validated, st1_resume)}
SHEETS = "sh AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey), ok AS (SELECT l_orderkey FROM sh WHERE n >= 2)"
SQL = {
    "js_props": "SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1",
    "js10_repair": "SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 5 THEN CAST(o_orderkey AS VARCHAR) END AS key, CASE WHEN o_orderkey % 6 < 5 THEN o_orderstatus END AS status FROM orders",
    "js1_clean": "SELECT o_orderkey, '{\"a\"：1},{''b'',' || o_orderkey || '}],[' AS text FROM orders",
    "tp1_tp2_tables": "WITH " + SHEETS + " SELECT n >= 2 AS is_table, 4 AS n_columns, count(*) AS n FROM sh GROUP BY ALL",
    "tp4_table_extract": "WITH " + SHEETS + ", l AS (SELECT * FROM lineitem JOIN ok USING (l_orderkey)) SELECT 'Depth (m)' AS field, count(*) AS n, count(DISTINCT 'SRR' || l_orderkey || l_linenumber) AS n_accessions, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS total, min('s' || l_linenumber) AS first_label FROM l UNION ALL SELECT 'Part', count(*), count(DISTINCT 'SRR' || l_orderkey || l_linenumber), CAST(sum(l_partkey) AS BIGINT), min('s' || l_linenumber) FROM l WHERE l_partkey % 5 > 0",
    "tp6_best_reading": "WITH k AS (SELECT l_orderkey FROM lineitem WHERE l_quantity <= 40 GROUP BY l_orderkey HAVING count(*) >= 2), l AS (SELECT *, CAST(l_orderkey % 2 AS INT) AS turned FROM lineitem JOIN k USING (l_orderkey) WHERE l_quantity <= 40) SELECT turned, 'Depth (m)' AS field, count(*) AS n, count(DISTINCT 'SRR' || l_orderkey || l_linenumber) AS n_accessions, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS total FROM l GROUP BY turned UNION ALL SELECT turned, 'Part', count(*), count(DISTINCT 'SRR' || l_orderkey || l_linenumber), CAST(sum(l_partkey) AS BIGINT) FROM l WHERE l_partkey % 5 > 0 GROUP BY turned",
    "t19_validated": "WITH a AS (SELECT doc_id, length(text) AS n, -20 + doc_id % 40 AS s, length(text) + 30 - doc_id % 90 AS e FROM documents), b AS (SELECT *, least(greatest(s, 0), n) AS cs, least(greatest(e, 0), n) AS ce FROM a) SELECT doc_id, CASE WHEN ok THEN cs END AS start, CASE WHEN ok THEN ce END AS \"end\" FROM (SELECT *, abs(s - cs) + abs(e - ce) <= 50 AND ce - cs BETWEEN 40 AND 3000 AS ok FROM b)",
    "st1_resume": "SELECT count(*) FILTER (event_id % 3 > 0) AS n, 'left' AS what FROM events UNION ALL SELECT count(*) FILTER (event_id % 3 = 0 AND event_id % 9 > 0), 'first' FROM events UNION ALL SELECT count(*) FILTER (event_id % 9 = 0), 'second' FROM events",
}
