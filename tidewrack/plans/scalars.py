"""String, date and value functions over names and values made from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewrack.functions import text as T
from tidewrack.functions import values as V
from tidewrack.plans.proxies import PARTS, load, parts


def t1_t6_keys(spark, sf_dir):
    r = F.col("raw")
    return parts(spark, sf_dir).select(
        "p_partkey", T.key_joined(r).alias("t1"), T.key_strict(r, {"bolts": "bolt", "small": "little"}).alias("t2"), T.key_loose(r).alias("t3"), T.key_plain(r).alias("t4"), T.quantity_kind(r).alias("t5"), T.column_name(r).alias("t6"),
    )


def _names(spark, sf_dir):
    """Field names with stat, unit and replicate endings, from parts."""
    k = F.col("p_partkey")
    pick = lambda words, m: F.element_at(F.array(*[F.lit(w) for w in words]), (k % m % len(words)).cast("int") + 1)
    return load(spark, sf_dir, "part").select(
        "p_partkey", "p_brand",
        F.concat(pick(["", "mean_", "annual_", "137cs_", "bacterial_", "max_daily_"], 6), F.split("p_name", " ")[1], F.lit("_"), pick(["nitrate", "carbon", "depth", "toc", "no3_n"], 5), pick(["", "_sd", "_concentration", "_mg_l", "_umol_per_l", "_mean_m", "_2", "_m_3"], 8)).alias("name"),
    )


def _pick(words: list[str], m: int) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + f"][p_partkey % {m} % {len(words)} + 1]"


NAMES = "names AS (SELECT p_partkey, p_brand, " + " || ".join([_pick(["", "mean_", "annual_", "137cs_", "bacterial_", "max_daily_"], 6), "split_part(p_name, ' ', 2) || '_'", _pick(["nitrate", "carbon", "depth", "toc", "no3_n"], 5), _pick(["", "_sd", "_concentration", "_mg_l", "_umol_per_l", "_mean_m", "_2", "_m_3"], 8)]) + " AS name FROM part)"


def t7_decompose(spark, sf_dir):
    d = T.decompose(F.col("name"))
    x = _names(spark, sf_dir).select("p_partkey", d.alias("d"))
    return x.select("p_partkey", "d.root", "d.stat", "d.qualifier", "d.unit", "d.replicate", "d.aggregation", "d.isotope", "d.taxon", F.array_join("d.substances", " ").alias("substances"))


def _decompose_sql() -> str:
    from tidewrack import constants as K

    alt = lambda words: "|".join(sorted(set(words), key=lambda w: (-len(w), w)))
    ctes, n = ["s0 AS (SELECT p_partkey, name AS root, CAST(NULL AS VARCHAR) AS stat, CAST(NULL AS VARCHAR) AS qualifier, CAST(NULL AS VARCHAR) AS unit, CAST(NULL AS VARCHAR) AS replicate, CAST(NULL AS VARCHAR) AS aggregation, CAST(NULL AS VARCHAR) AS isotope, CAST(NULL AS VARCHAR) AS taxon FROM names)"], 0
    tags = ["stat", "qualifier", "unit", "replicate", "aggregation", "isotope", "taxon"]

    def step(tag: str, pattern: str, rest: int, hit: int, keep: bool = True) -> None:
        nonlocal n
        left, found = f"trim(regexp_extract(root, '{pattern}', {rest}), '_')", f"regexp_extract(root, '{pattern}', {hit})"
        ok = f"{found} <> '' AND length({left}) >= 2" + (f" AND {tag} IS NULL" if keep else "")
        cols = ", ".join(f"CASE WHEN {ok} THEN {found} ELSE {tag} END AS {t}" if t == tag else t for t in tags)
        ctes.append(f"s{n + 1} AS (SELECT p_partkey, CASE WHEN {ok} THEN {left} ELSE root END AS root, {cols} FROM s{n})")
        n += 1

    step("replicate", r"^(.*?)_(\d{1,2})$", 1, 2)
    step("stat", f"^(.*?)_({alt(K.STAT_SUFFIXES)})$", 1, 2)
    step("qualifier", f"^(.*?)_({alt(K.QUALIFIER_SUFFIXES)})$", 1, 2)
    step("unit", f"^(.*?)_({alt(K.UNIT_SUFFIXES)})$", 1, 2)
    step("unit", f"^(.*?)_({alt(K.UNIT_SUFFIXES)})$", 1, 2, False)
    for _ in range(4):
        for tag, words in (("stat", K.STAT_PREFIXES), ("aggregation", K.AGGREGATION_PREFIXES), ("isotope", K.ISOTOPES), ("taxon", K.TAXA)):
            step(tag, f"^({alt(words)})_(.*)$", 2, 1)
    element = "MAP {" + ", ".join(f"'{w}': '{e}'" for e, words in K.SUBSTANCES.items() for w in words) + "}"
    return "WITH " + NAMES + ", " + ", ".join(ctes) + f" SELECT p_partkey, root, {', '.join(tags)}, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(root, '_'), lambda t: {element}[t]), lambda e: e IS NOT NULL))), ' ') AS substances FROM s{n}"


def t10_t11_comparable(spark, sf_dir):
    c = T.comparable(F.col("name"))
    return _names(spark, sf_dir).select("p_partkey", c.alias("comparable"), F.array_join(F.array_sort(T.name_tokens(c)), " ").alias("tokens"))


def t13_variants(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", F.explode(T.qk_variants(F.col("name"))).alias("variant"))


def t14_t15_t20_clips(spark, sf_dir):
    t = F.col("text")
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(T.truncated(t, 400).cast("binary")).alias("truncated"), F.md5(F.substring(t, 101, 50).cast("binary")).alias("slice"), T.segment_hash(t).alias("hash"))


def t21_accessions(spark, sf_dir):
    from tidewrack.operators.matching import accessions_in

    o = load(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(" ", F.lit("runs"), F.concat(F.element_at(F.array(F.lit("SRR"), F.lit("ERX"), F.lit("SAMN"), F.lit("PRJNA"), F.lit("SRR_"), F.lit("DRS")), (F.col("o_orderkey") % 6).cast("int") + 1), "o_orderkey"), F.lit("and"), F.concat(F.lit("SAMEA"), "o_custkey"), F.lit(".")).alias("text"))
    return accessions_in(o, "o_orderkey", "text")


def t23_t25_t28(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    std, can, raw = F.when(F.col("p_size") % 3 == 0, F.lower("p_type")), F.when(F.col("p_size") % 2 == 0, F.replace("p_name", F.lit(" "), F.lit("_"))).otherwise(" "), F.col("p_brand")
    return p.select("p_partkey", T.slot(std, can, raw).alias("slot"), T.section_tier(F.concat_ws(" ", "p_type", F.when(F.col("p_size") > 30, "Results").when(F.col("p_size") > 10, "Main Text"))).alias("tier"), T.acronym(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("acronym"), T.record_id(F.col("p_partkey"), std, F.col("p_brand")).alias("rid"))


def t35_units(spark, sf_dir):
    u = F.element_at(F.array(*[F.lit(x) for x in ("Meters", "°C", "mg/L", "PSU", "furlong", " KM ", "µmol/kg", "", "Hours")]), (F.col("p_partkey") % 9).cast("int") + 1)
    return load(spark, sf_dir, "part").select("p_partkey", T.unit(u).alias("unit"))


def t41_labels(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_custkey", F.split(F.concat_ws(",", F.when(F.col("c_custkey") % 2 == 0, "Lake"), F.when(F.col("c_custkey") % 3 == 0, " Wetlands"), F.lit("Others"), F.when(F.col("c_custkey") % 5 == 0, "Lake"), F.lit("Desert")), ",").alias("l"))
    return c.select("c_custkey", F.array_join(T.environment_labels(F.col("l")), ",").alias("labels"))


def t43_field_values(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("size: "), "p_size", F.lit(" || type:"), "p_type", F.lit(" ||  : x || brand: "), F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise("")).alias("s"))
    return p.select("p_partkey", F.explode(T.field_values(F.col("s"))).alias("x")).select("p_partkey", "x.field", "x.value")


def d1_year_bins(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    y = F.when(F.col("o_orderkey") % 11 == 0, "abc").otherwise((F.year("o_orderdate") + F.col("o_orderkey") % 30).cast("string"))
    return o.groupBy(V.year_bin(y).alias("bin"), V.era(y.try_cast("int")).alias("era")).agg(F.count("*").alias("n"))


def d3_dates(spark, sf_dir):
    d = F.col("o_orderdate")
    f = [F.date_format(d, p) for p in ("yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "d/M/yyyy", "yyyy-MM", "yyyy", "MMM yyyy", "MMMM yyyy", "yyyy-MM-dd HH:mm:ss")]
    raw = F.element_at(F.array(*f, F.lit("around noon"), F.lit("")), (F.col("o_orderkey") % 11).cast("int") + 1)
    return load(spark, sf_dir, "orders").select("o_orderkey", V.timestamp(raw).alias("v")).select("o_orderkey", "v.text", "v.status")


def d4_duration(spark, sf_dir):
    raw = F.concat((F.col("p_size") / 4).cast("string"), F.element_at(F.array(*[F.lit(x) for x in (" days", " h", "min", " parsecs", " seconds")]), (F.col("p_partkey") % 5).cast("int") + 1))
    return load(spark, sf_dir, "part").select("p_partkey", V.duration(raw).alias("v")).select("p_partkey", "v.text", "v.status")


def _measured(spark, sf_dir):
    raw = F.concat(F.element_at(F.array(F.lit(""), F.lit("-"), F.lit("~"), F.lit("+")), (F.col("p_partkey") % 4).cast("int") + 1), (F.col("p_size") / 8).cast("string"), F.element_at(F.array(*[F.lit(x) for x in (" m", "", " Metres", " ft", "°C")]), (F.col("p_partkey") % 5).cast("int") + 1))
    return load(spark, sf_dir, "part").select("p_partkey", "p_size", raw.alias("raw"))


MEASURED = "meas AS (SELECT p_partkey, p_size, ['', '-', '~', '+'][p_partkey % 4 + 1] || CAST(p_size / 8 AS VARCHAR) || [' m', '', ' Metres', ' ft', '°C'][p_partkey % 5 + 1] AS raw FROM part)"


def m4_float_unit(spark, sf_dir):
    v = V.float_with_unit(F.col("raw"), F.array(F.lit("meter")))
    return _measured(spark, sf_dir).select("p_partkey", v.alias("v")).select("p_partkey", "v.num", "v.unit", "v.status")


def m5_m7_plain(spark, sf_dir):
    raw = F.element_at(F.array((F.col("p_size") / 8).cast("string"), F.lit("Yes"), F.lit("0"), F.lit("x"), F.concat(F.lit("-"), (F.col("p_size") / 8).cast("string"))), (F.col("p_partkey") % 5).cast("int") + 1)
    p = load(spark, sf_dir, "part").select("p_partkey", V.float_only(raw).alias("f"), V.integer(raw).alias("i"), V.boolean(raw).alias("b"))
    return p.select("p_partkey", F.col("f.num").alias("num"), F.col("i.num").alias("whole"), F.col("b.flag").alias("flag"))


def m8_latlon(spark, sf_dir):
    a, b = (F.col("p_size") / 2).cast("string"), (F.col("p_size") * 1.5).cast("string")
    raw = F.element_at(F.array(F.concat(a, F.lit(" N, "), b, F.lit(" W")), F.concat(F.lit("-"), a, F.lit(", "), b), F.concat(a, F.lit("°s "), b, F.lit("°E")), F.lit("north pole")), (F.col("p_partkey") % 4).cast("int") + 1)
    return load(spark, sf_dir, "part").select("p_partkey", V.lat_lon(raw).alias("v")).select("p_partkey", F.col("v.num").alias("lat"), F.col("v.num2").alias("lon"), "v.status")


def m9_range(spark, sf_dir):
    s = F.col("p_size").cast("string")
    raw = F.element_at(F.array(F.concat(s, F.lit("-"), (F.col("p_size") + 5).cast("string"), F.lit(" m")), F.concat(s, F.lit(" to 99 km, 5-6 m")), s, F.concat(s, F.lit("–70"))), (F.col("p_partkey") % 4).cast("int") + 1)
    return load(spark, sf_dir, "part").select("p_partkey", V.value_range(raw).alias("v")).select("p_partkey", F.col("v.num").alias("low"), F.col("v.num2").alias("high"), "v.unit", "v.status")


def m10_enum(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", V.enum(F.concat(F.col("p_type"), F.when(F.col("p_size") > 25, "-like").otherwise("")), F.lit("[economy|small|Large|stand]")).alias("v")).select("p_partkey", "v.text", "v.status")


def m11_m12(spark, sf_dir):
    s = F.col("p_size").cast("string")
    raw = F.when(F.col("p_size") % 2 == 0, F.concat(s, F.lit(" : 4"))).otherwise(F.concat(F.lit("sieve;"), s, F.lit(" mm")))
    p = load(spark, sf_dir, "part").select("p_partkey", V.ratio(raw).alias("r"), V.compound(raw).alias("c"))
    return p.select("p_partkey", F.col("r.num").alias("n1"), F.col("r.num2").alias("n2"), F.col("r.status").alias("status"), F.col("c.text").alias("text"), F.col("c.num").alias("num"), F.col("c.unit").alias("unit"))


def m14_dispatch(spark, sf_dir):
    n = F.element_at(F.array(*[F.lit(x) for x in ("float_with_unit", "integer", "range", "passthrough", "unknown")]), (F.col("p_size") % 5).cast("int") + 1)
    v = V.normalized(F.col("raw"), n, F.lit(""), F.array().cast("array<string>"))
    return _measured(spark, sf_dir).select("p_partkey", n.alias("normalizer"), v.alias("v")).groupBy("normalizer", "v.status", "v.kind").agg(F.count("*").alias("n"))


def m16_prune(spark, sf_dir):
    from tidewrack.operators.curation import prune_decision
    from tidewrack.plans.profiles import a29_tries_success

    return a29_tries_success(spark, sf_dir).select("l_suppkey", prune_decision(F.col("tries"), F.col("successes"), 595, 0.345).alias("decision"))


QUERIES = {f.__name__: f for f in (
    t1_t6_keys, t7_decompose, t10_t11_comparable, t13_variants, t14_t15_t20_clips, t21_accessions, t23_t25_t28, t35_units, t41_labels, t43_field_values, d1_year_bins, d3_dates, d4_duration, m4_float_unit, m5_m7_plain, m8_latlon, m9_range, m10_enum, m11_m12, m14_dispatch, m16_prune,
)}
_SUFFIX = "CASE " + " ".join(f"WHEN suffix(t, '{s}') AND length(t) > {len(s) + 2} THEN left(t, length(t) - {len(s)})" for s in ["_nmol_kg", "_nmolkg", "_g_kg", "_gkg", "_percent", "_pct", "_pc", "_m", "_cm", "_mm", "_km", "_degc", "_degk"]) + " ELSE t END"
SQL = {
    "t1_t6_keys": "WITH " + PARTS + r""", a AS (SELECT p_partkey, raw, lower(trim(raw)) AS l FROM parts), b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(l, '[^\w\s/\-,]', '', 'g'), '[/,\s]+', '_', 'g'), '[^a-z0-9_-]', '', 'g'), '_+', '_', 'g'), '^[_-]+|[_-]+$', '', 'g') AS k FROM a)
SELECT p_partkey, translate(l, ' -', '__') AS t1, array_to_string(list_transform(string_split(k, '_'), lambda t: CASE t WHEN 'bolts' THEN 'bolt' WHEN 'small' THEN 'little' ELSE t END), '_') AS t2, regexp_replace(regexp_replace(regexp_replace(l, '[\s/\-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS t3, l AS t4,
 regexp_replace(regexp_replace(regexp_replace(regexp_replace(l, '[\s\-/]+', '_', 'g'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS t5, lower(trim(regexp_replace(regexp_replace(raw, '\([^)]*\)', '', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '_')) AS t6 FROM b""",
    "t7_decompose": _decompose_sql(),
    "t10_t11_comparable": "WITH " + NAMES + ", a AS (SELECT p_partkey, lower(trim(name)) AS t FROM names), b AS (SELECT p_partkey, trim(regexp_replace(" + _SUFFIX + ", '[_ ]+', '_', 'g'), '_') AS c FROM a) SELECT p_partkey, c AS comparable, array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace(regexp_replace(c, '([0-9])([^0-9_])', '\\1_\\2', 'g'), '([^0-9_])([0-9])', '\\1_\\2', 'g'), '_'), lambda t: t <> ''))), ' ') AS tokens FROM b",
    "t13_variants": "WITH " + NAMES + ", v AS (SELECT p_partkey, name, unnest(list_distinct([regexp_replace(name, '_(concentration|content|level|value|rate)$', ''), regexp_replace(name, '^(total|mean|average)_', ''), CASE WHEN regexp_matches(name, '[a-z]{3}s$') THEN left(name, length(name) - 1) ELSE name END, regexp_replace(name, '^(.+)_of_(.+)$', '\\2_\\1')])) AS variant FROM names) SELECT p_partkey, variant FROM v WHERE variant <> name",
    "t14_t15_t20_clips": "SELECT doc_id, md5(CASE WHEN length(text) <= 400 THEN text ELSE left(text, 280) || chr(10) || '...' || chr(10) || right(text, 120) END) AS truncated, md5(substr(text, 101, 50)) AS slice, md5(text) AS hash FROM documents",
    "t21_accessions": r"WITH o AS (SELECT o_orderkey, 'runs ' || ['SRR', 'ERX', 'SAMN', 'PRJNA', 'SRR_', 'DRS'][o_orderkey % 6 + 1] || o_orderkey || ' and SAMEA' || o_custkey || '.' AS text FROM orders), a AS (SELECT DISTINCT o_orderkey, unnest(regexp_extract_all(text, '\b(PRJ[NEDB][AB]\d+|SAM[EN]A?\d+|SAMD\d+|[SED]RX\d+|[SED]RR\d+|[SED]RP\d+|[SED]RS\d+)\b')) AS accession FROM o) SELECT o_orderkey, accession, CASE WHEN accession LIKE 'SAM%' THEN 'biosample' WHEN accession LIKE 'PRJ%' THEN 'bioproject' WHEN accession[3] = 'S' THEN 'sra_sample' WHEN accession[3] = 'X' THEN 'sra_experiment' WHEN accession[3] = 'R' THEN 'sra_run' ELSE 'sra_study' END AS level FROM a",
    "t23_t25_t28": "WITH a AS (SELECT *, CASE WHEN p_size % 3 = 0 THEN lower(p_type) END AS std, CASE WHEN p_size % 2 = 0 THEN replace(p_name, ' ', '_') ELSE ' ' END AS can, lower(concat_ws(' ', p_type, CASE WHEN p_size > 30 THEN 'Results' WHEN p_size > 10 THEN 'Main Text' END)) AS sec FROM part) SELECT p_partkey, coalesce('mixs:' || nullif(trim(std), ''), 'internal:' || nullif(trim(can), ''), 'internal:' || lower(nullif(trim(p_brand), ''))) AS slot, CASE WHEN regexp_matches(sec, 'method|result') THEN 1 WHEN regexp_matches(sec, 'intro|discussion|main text|abstract') THEN 2 ELSE 3 END AS tier, split_part(p_name, ' ', 1)[1] || split_part(p_name, ' ', 2)[1] AS acronym, p_partkey || '|' || coalesce(std, '') || '|' || p_brand AS rid FROM a",
    "t35_units": "SELECT p_partkey, ['meter', 'degC', 'mg/L', 'PSU', 'furlong', 'kilometer', 'umol/kg', '', 'hour'][p_partkey % 9 + 1] AS unit FROM part",
    "t41_labels": "SELECT c_custkey, CASE WHEN c_custkey % 2 > 0 AND c_custkey % 3 > 0 AND c_custkey % 5 > 0 THEN 'Others' ELSE concat_ws(',', CASE WHEN c_custkey % 2 = 0 THEN 'Lake' END, CASE WHEN c_custkey % 3 = 0 THEN 'Wetlands' END, CASE WHEN c_custkey % 5 = 0 AND c_custkey % 2 > 0 THEN 'Lake' END) END AS labels FROM customer",
    "t43_field_values": "SELECT p_partkey, 'size' AS field, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part UNION ALL SELECT p_partkey, 'brand', p_brand FROM part WHERE p_size > 25",
    "d1_year_bins": "WITH y AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE year(o_orderdate) + o_orderkey % 30 END AS y FROM orders) SELECT CASE WHEN y BETWEEN 2020 AND 2026 THEN '2020-2026' WHEN y >= 2000 AND y < 2020 THEN (y // 5 * 5) || '-' || (y // 5 * 5 + 5) ELSE 'unknown' END AS bin, CASE WHEN y <= 2015 THEN 'early' WHEN y <= 2020 THEN 'middle' WHEN y > 2020 THEN 'late' ELSE 'unknown' END AS era, count(*) AS n FROM y GROUP BY ALL",
    "d3_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 11 >= 9 THEN NULL ELSE strftime(CASE o_orderkey % 11 WHEN 4 THEN date_trunc('month', o_orderdate) WHEN 6 THEN date_trunc('month', o_orderdate) WHEN 7 THEN date_trunc('month', o_orderdate) WHEN 5 THEN date_trunc('year', o_orderdate) ELSE o_orderdate END, '%Y-%m-%dT%H:%M:%S') END AS text, CASE WHEN o_orderkey % 11 >= 9 THEN 'failed' ELSE 'ok' END AS status FROM orders",
    "d4_duration": "WITH a AS (SELECT p_partkey, p_partkey % 5 AS u, CASE WHEN p_size % 4 = 0 THEN CAST(p_size // 4 AS VARCHAR) ELSE printf('%.6f', p_size / 4) END AS d FROM part) SELECT p_partkey, CASE u WHEN 0 THEN 'P' || d || 'D' WHEN 1 THEN 'PT' || d || 'H' WHEN 2 THEN 'PT' || d || 'M' WHEN 4 THEN 'PT' || d || 'S' END AS text, CASE WHEN u = 3 THEN 'failed' ELSE 'ok' END AS status FROM a",
    "m4_float_unit": "WITH " + MEASURED + " SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN NULL WHEN 1 THEN -(p_size / 8) ELSE p_size / 8 END AS num, CASE WHEN p_partkey % 4 = 2 THEN NULL ELSE ['meter', '', 'meter', 'ft', 'degC'][p_partkey % 5 + 1] END AS unit, CASE WHEN p_partkey % 4 = 2 THEN 'failed' ELSE ['ok', 'failed', 'ok', 'out_of_preferred', 'out_of_preferred'][p_partkey % 5 + 1] END AS status FROM meas",
    "m5_m7_plain": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size / 8 WHEN 2 THEN 0.0 WHEN 4 THEN -(p_size / 8) END AS num, CASE p_partkey % 5 WHEN 0 THEN trunc(p_size / 8) WHEN 2 THEN 0.0 WHEN 4 THEN -trunc(p_size / 8) END AS whole, CASE p_partkey % 5 WHEN 1 THEN true WHEN 2 THEN false END AS flag FROM part",
    "m8_latlon": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size / 2 WHEN 1 THEN -(p_size / 2) WHEN 2 THEN -(p_size / 2) END AS lat, CASE p_partkey % 4 WHEN 0 THEN CAST(-(p_size * 1.5) AS DOUBLE) WHEN 1 THEN CAST(p_size * 1.5 AS DOUBLE) WHEN 2 THEN CAST(p_size * 1.5 AS DOUBLE) END AS lon, CASE WHEN p_partkey % 4 = 3 THEN 'failed' ELSE 'ok' END AS status FROM part",
    "m9_range": "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 2 THEN CAST(p_size AS DOUBLE) END AS low, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size + 5 AS DOUBLE) WHEN 1 THEN 99.0 WHEN 3 THEN 70.0 END AS high, CASE p_partkey % 4 WHEN 0 THEN 'meter' WHEN 1 THEN 'kilometer' WHEN 3 THEN '' END AS unit, ['ok', 'out_of_preferred', 'failed', 'ok'][p_partkey % 4 + 1] AS status FROM part",
    "m10_enum": "WITH a AS (SELECT p_partkey, lower(p_type) || CASE WHEN p_size > 25 THEN '-like' ELSE '' END AS s FROM part), b AS (SELECT *, CASE WHEN list_contains(['economy', 'small', 'large', 'stand'], s) THEN s ELSE list_filter(['economy', 'small', 'large', 'stand'], lambda o: contains(s, o) OR contains(o, s))[1] END AS text FROM a) SELECT p_partkey, text, CASE WHEN text IS NULL THEN 'failed' ELSE 'ok' END AS status FROM b",
    "m11_m12": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS n1, CASE WHEN p_size % 2 = 0 THEN 4.0 END AS n2, CASE WHEN p_size % 2 = 0 THEN 'ok' ELSE 'failed' END AS status, CASE WHEN p_size % 2 = 0 THEN p_size || ' : 4' ELSE 'sieve' END AS text, CASE WHEN p_size % 2 > 0 THEN CAST(p_size AS DOUBLE) END AS num, CASE WHEN p_size % 2 > 0 THEN 'millimeter' END AS unit FROM part",
    "m14_dispatch": "WITH " + MEASURED + ", a AS (SELECT *, ['float_with_unit', 'integer', 'range', 'passthrough', 'unknown'][p_size % 5 + 1] AS normalizer FROM meas), b AS (SELECT normalizer, CASE normalizer WHEN 'float_with_unit' THEN CASE WHEN p_partkey % 4 = 2 THEN 'failed' ELSE 'ok' END WHEN 'integer' THEN CASE WHEN p_partkey % 4 = 2 OR p_partkey % 5 <> 1 THEN 'failed' ELSE 'ok' END WHEN 'range' THEN 'failed' ELSE 'ok' END AS status, CASE normalizer WHEN 'float_with_unit' THEN 'measurement' WHEN 'integer' THEN 'integer' WHEN 'range' THEN 'range' ELSE 'text' END AS kind FROM a) SELECT normalizer, status, kind, count(*) AS n FROM b GROUP BY ALL",
    "m16_prune": "SELECT l_suppkey, CASE WHEN t < 595 THEN 'kept_observe' WHEN s / t < 0.345 THEN 'pruned' ELSE 'kept' END AS decision FROM (SELECT l_suppkey, count(DISTINCT l_orderkey) AS t, count(DISTINCT l_orderkey) FILTER (l_returnflag = 'R') AS s FROM lineitem GROUP BY l_suppkey)",
}
