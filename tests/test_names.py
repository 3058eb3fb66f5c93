import pytest
from pyspark.sql import functions as F

from tidewrack.functions import names

#: One or two groups for each rule, in the order of the rules: names with their papers, and the name that the rule picks.
GROUPS = [
    ({"silt/clay": 90, "silt_clay": 3}, "silt_clay"), ({"flow(m)": 12, "flow": 2}, "flow"),  # odd characters lose
    ({"pH": 7, "acidity_of_water": 90}, "pH"), ({"tds": 1, "water_salts": 40}, "tds"),  # accepted short names win
    ({"so4": 70, "water_sulphates": 2}, "water_sulphates"), ({"+mg": 4, "hardness": 1}, "hardness"),  # formulas and odd signs lose
    ({"wd": 55, "wind": 2}, "wind"),  # under four characters
    ({"mean_height_of_the_waves_near_shore": 30, "wave_height": 1}, "wave_height"),  # over thirty characters
    ({"waveHeight": 20, "wave_heights": 1}, "wave_heights"),  # camel case
    ({"windspeed": 80, "wind_speed": 1}, "wind_speed"), ({"sampleplace": 9, "place": 1}, "place"),  # a missed underscore
    ({"cover": 50, "ice_salinity": 1}, "ice_salinity"),  # a full word wins
    ({"tides": 3, "swell": 8}, "swell"),  # most papers
    ({"gauges": 4, "gauge": 4}, "gauge"), ({"fetch": 5, "cliff": 5}, "cliff"),  # shortest, then first in the alphabet
]


def test_representatives(spark):
    rows = [(i, n, p) for i, (members, _) in enumerate(GROUPS) for n, p in members.items()] + [(99, None, 1), (99, "", 2)]
    got = {r.g: r.representative for r in names.representatives(spark.createDataFrame(rows, "g int, n string, p int"), "g", "n", "p").collect()}
    assert got == {i: best for i, (_, best) in enumerate(GROUPS)}


@pytest.mark.parametrize(("raw", "evidence", "key", "verdict"), [
    ("Sample Depths (m)", "x", "sample_depth_m", "accepted"), ("pH", "x", "ph", "accepted"), ("10um", "x", "10um", "dropped: value"), ("5ug", "x", "5ug", "dropped: value"), ("20ul", "x", "20ul", "dropped: value"), ("12.5", "x", "125", "dropped: value"), ("illumina_run", "x", "illumina_run", "dropped: instrument"), ("qubit3", "x", "qubit3", "dropped: instrument"),
    ("growth rate", "x", "growth_rate", "dropped: experiment"), ("a" * 61, "x", "a" * 61, "review: long"), ("depth 2019 cruise", "x", "depth_2019_cruise", "review: digits"), ("!", "x", None, "dropped: no key"), ("depth", " ", "depth", "dropped: no evidence"), (None, "x", None, "dropped: no key"),
])
def test_verdicts(spark, raw, evidence, key, verdict):
    r = spark.createDataFrame([(raw, evidence)], "r string, e string").select(names.verdict(F.col("r"), F.col("e")).alias("v")).first()["v"]
    assert (r["key"], r["verdict"]) == (key, verdict)


def test_sections(spark):
    rows = [("Methods ", "METHODS"), ("materials & methods", "METHODS"), ("concl", "CONCL"), ("appendix", "SUPPL"), ("odd", "unknown"), (None, "unknown")]
    df = spark.createDataFrame([(a,) for a, _ in rows], "s string").select(names.section(F.col("s")).alias("r"))
    assert [r.r for r in df.collect()] == [b for _, b in rows]
    t = spark.createDataFrame([("TABLE", "a.txt"), ("x", "b.CSV"), ("x", "table_1.pdf"), ("x", "fig.pdf")], "s string, f string")
    assert [r.r for r in t.select(names.is_table_like(F.col("s"), F.col("f")).alias("r")).collect()] == [True, True, True, False]
    assert [r.r for r in t.select(names.is_excluded_section(F.lit("ref"), []).alias("r")).collect()] == [True] * 4
