"""Golden cases and small brute-force comparisons of the functions."""

import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewrack.functions import evidence, json_repair, stats
from tidewrack.functions import text as T
from tidewrack.functions import values as V


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("r")).first()["r"]


@pytest.mark.parametrize(("key", "root", "tags", "substances"), [
    ("area_1", "area", {"replicate": "1"}, []), ("area_km2", "area", {"unit": "km2"}, []), ("depth_m", "depth", {"unit": "m"}, []), ("2_m", "2_m", {}, []), ("100_m", "100", {"unit": "m"}, []),
    ("137cs_activity_concentration", "activity", {"qualifier": "concentration", "isotope": "137cs"}, []), ("137cs_sd", "137cs", {"stat": "sd"}, []), ("14c_age_yr_bp", "age", {"unit": "yr_bp", "isotope": "14c"}, []),
    ("mean_annual_sea_surface_temperature", "sea_surface_temperature", {"stat": "mean", "aggregation": "annual"}, []), ("archaeal_16s_rrna_gene_copies_l", "16s_rrna_gene_copies", {"unit": "l", "taxon": "archaeal"}, []),
    ("ammonium_umol_per_l", "ammonium", {"unit": "umol_per_l"}, ["nitrogen"]), ("no3_n", "no3_n", {}, ["nitrogen"]), ("c_n_ratio", "c_n", {"unit": "ratio"}, ["carbon", "nitrogen"]),
    ("total_phosphorus", "total_phosphorus", {}, ["phosphorus"]), ("chlorophyll_a_concentration", "chlorophyll_a", {"qualifier": "concentration"}, ["chlorophyll"]),
])
def test_decompose(spark, key, root, tags, substances):
    r = one(spark, key, T.decompose)
    found = {t: r[t] for t in ("stat", "qualifier", "unit", "replicate", "aggregation", "isotope", "taxon") if r[t]}
    assert (r["root"], found, r["substances"]) == (root, tags, substances)


@pytest.mark.parametrize(("a", "b", "yes"), [("salinity_psu", "salinity", True), ("reef_type", "reeftype", True), ("latitude", "longitude", False), ("no3", "no2", True)])
def test_similar(spark, a, b, yes):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(T.similar(F.col("a"), F.col("b")).alias("r")).first()["r"] == yes


@pytest.mark.parametrize(("raw", "preferred", "num", "unit", "status"), [
    ("25.0 m", ["meter"], 25.0, "meter", "ok"), ("25", ["meter"], 25.0, "", "failed"), ("25 ft", ["meter"], 25.0, "ft", "out_of_preferred"), ("~25 m", [], None, None, "failed"), ("-2.5e1 °C", [], -25.0, "degC", "ok"), (None, [], None, None, "failed"),
])
def test_float_with_unit(spark, raw, preferred, num, unit, status):
    r = one(spark, raw, lambda c: V.float_with_unit(c, F.array(*[F.lit(p) for p in preferred]).cast("array<string>")))
    assert (r["num"], r["unit"], r["status"]) == (num, unit, status)


@pytest.mark.parametrize(("raw", "text"), [("5 days", "P5D"), ("1.5 h", "PT1.500000H"), ("2 parsecs", None), (None, None)])
def test_duration(spark, raw, text):
    assert one(spark, raw, V.duration)["text"] == text


@pytest.mark.parametrize(("raw", "text"), [("07/03/2019", "2019-03-07T00:00:00"), ("2019-07", "2019-07-01T00:00:00"), ("2019", "2019-01-01T00:00:00"), ("July 2019", "2019-07-01T00:00:00"), ("2019-02-30", None), ("x", None)])
def test_timestamp(spark, raw, text):
    assert one(spark, raw, V.timestamp)["text"] == text


def test_other_values(spark):
    assert tuple(one(spark, "12.5 N, 45 W", V.lat_lon)[k] for k in ("num", "num2")) == (12.5, -45.0)
    r = one(spark, "5-10 m, 20-30 m", V.value_range)
    assert (r["num"], r["num2"], r["unit"], r["status"]) == (5, 10, "meter", "out_of_preferred")
    assert one(spark, "Daytime", lambda c: V.enum(c, F.lit("[day|night]")))["text"] == "day"
    assert one(spark, "Y", V.boolean)["flag"] is True
    assert tuple(one(spark, "3 : 4", V.ratio)[k] for k in ("num", "num2")) == (3.0, 4.0)
    assert [one(spark, y, V.year_bin) for y in ("1999", "2004", "2005", "2026", "abc")] == ["unknown", "2000-2005", "2005-2010", "2020-2026", "unknown"]
    assert one(spark, "SAME123", T.accession_level) == "unknown"
    assert one(spark, "SAMEA123", T.accession_level) == "biosample"


@pytest.mark.parametrize("table", [(1, 4999, 499999, 495000), (5, 1495, 50000, 50000), (700, 4300, 90000, 910000), (2000, 30, 20, 200000), (400, 4600, 90000, 910000), (3000, 10**6, 2900, 10**6)])
def test_fisher_of_many_papers(spark, table):
    a, b, c, d = table
    lg = lambda x: math.lgamma(x + 1)
    terms = [lg(a + b) + lg(c + d) + lg(a + c) + lg(b + d) - lg(a + b + c + d) - lg(a + k) - lg(b - k) - lg(c - k) - lg(d + k) for k in range(min(b, c) + 1)]
    p = min(1.0, math.exp(max(terms)) * sum(math.exp(t - max(terms)) for t in terms))
    df = spark.createDataFrame([table], "a bigint, b bigint, c bigint, d bigint")
    assert math.isclose(df.select(stats.fisher_greater(*[F.col(c) for c in "abcd"]).alias("p")).first()["p"], p, rel_tol=1e-5, abs_tol=1e-300)


@pytest.mark.parametrize("table", [(8, 2, 1, 5), (3, 4, 5, 6), (12, 30, 20, 200), (1, 0, 0, 900), (0, 4, 4, 4), (3, -1, 4, 4)])
def test_fisher(spark, table):
    a, b, c, d = table
    n = a + b + c + d
    p = sum(math.comb(a + b, k) * math.comb(c + d, a + c - k) / math.comb(n, a + c) for k in range(a, min(a + b, a + c) + 1)) if a > 0 and min(table) >= 0 else 1.0
    df = spark.createDataFrame([tuple(float(x) for x in table)], "a double, b double, c double, d double")
    assert math.isclose(df.select(stats.fisher_greater(*[F.col(c) for c in "abcd"]).alias("p")).first()["p"], p, rel_tol=1e-8)


@pytest.mark.parametrize(("vector", "h", "share", "category"), [
    ((50, 50, 50, 50), 1.0, 0.25, "Universal"), ((20, 12, 0, 0), 0.4772, 0.625, "Cross-biome common"), ((40, 0, 0, 0), 0, 1.0, "Signature"), ((5, 0, 0, 0), 0, 1.0, "Niche"), ((3, 1, 1, 0), 0.6855, 0.6, "Niche"), ((0, 0, 0, 0), 0, 0, "Niche"),
])
def test_category(spark, vector, h, share, category):
    df = spark.createDataFrame([vector], "a int, b int, c int, d int")
    cs = {c: F.col(c) for c in "abcd"}
    name, s = stats.dominant(cs)
    e = stats.entropy(list(cs.values()))
    r = df.select(e.alias("h"), s.alias("s"), name.alias("n"), stats.category(e, s, F.expr("a + b + c + d")).alias("c")).first()
    assert (round(r["h"], 4), r["s"], r["c"]) == (h, share, category) and r["n"] == "a"


def test_chunks():
    assert evidence.chunk_spans("abcdefghij", 4, 1) == [(0, 4), (3, 7), (6, 10)]
    assert evidence.chunk_spans("", 4, 1) == [(0, 0)]
    assert evidence.chunk_spans("abcdef. xyz" * 3, 5, 1)[0] == (0, 7)


def test_evidence():
    text = "Nothing here. Depth was 5 m and salinity 30. Something else."
    a, b = evidence.locate(text, ["depth", "salinity"], 10, 200)
    assert text[a:b].strip() == "Depth was 5 m and salinity 30."
    assert evidence.locate(text, ["absent"], 10, 200) is None


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=8), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4), max_leaves=12))
@settings(max_examples=150, deadline=None)
def test_sound_json_is_kept(value):
    for text in (json.dumps(value), json.dumps(value, indent=1)):
        assert json_repair.repaired(text) == value


@pytest.mark.parametrize(("text", "value"), [
    ('{"a": 1,}', [{"a": 1}]), ('Sure:\n```json\n[{"a": 1}]\n```', [{"a": 1}]), ('{"a": 1} {"a": 2}', [{"a": 1}, {"a": 2}]), ('[{"a": "x\ny"}]', [{"a": "x\ny"}]), ('{"a": [1, 2', [{"a": [1, 2]}]), ('{"a": "}"} tail', [{"a": "}"}]), ("none", None), (None, None), ("", None),
])
def test_repair(text, value):
    assert json_repair.extract(text) == value
