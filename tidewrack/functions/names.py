"""Field names: the clearest representative of a group, the verdict on a discovered name, sections of papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.functions import text as T

# Full words that make a name clear.
FULL_WORDS = (
    "iron calcium sodium magnesium potassium copper zinc cadmium mercury lead aluminum chromium nickel manganese barium strontium arsenic selenium cobalt uranium silver "
    "chloride sulfate sulfide bromide fluoride phosphorus nitrogen carbon oxygen hydrogen argon ammonium ammonia nitrate nitrite phosphate silicate bicarbonate carbonate "
    "chlorophyll alkalinity salinity temperature conductivity turbidity dissolved particulate depth latitude longitude elevation altitude coordinates collection sampling season date year "
    "habitat sediment substrate vegetation biome mixed_layer water_table apparent_oxygen potential_temperature soil_moisture kjeldahl organic_matter suspended total inorganic organic"
).split()
# Short names that stay, roots before which an underscore is missed, characters that make a name unclear,
# formulas that give way to full names.
SHORT_NAMES = ["ph", "bod", "cod", "tds", "tss"]
ROOTS = ["sampling", "collection", "sample", "water", "sediment", "soil"]
ODD_CHARACTERS = "/\\|%@#()[]{}<>−–—+"
FORMULAS = "nh4 nh3 no2 no3 no nox po4 p2o5 so4 so3 s2 co2 co3 hco3 sio2 sio4 ch4 o2 h2 h2s h2o cl br f fe ca mg na k cu zn mn al pb hg cd as ni cr ba sr li mo co".split()

# Names that are always accepted, forms of values, instruments and makers, prefixes of experiments, plurals.
SCIENTIFIC = "ph doc don dop dic poc pon pop nh4 no3 no2 po4 so4 h2s co2 o2 toc ton tdn tn tp tdp chl_a chla par ntu bod cod tss tds do ec sal sst sss orp eh dom pom din dip srp".split()
VALUE_FORMS = [r"^\d+[.,]?\d*$", r"^\d{1,2}[_\-/]\w+[_\-/]\d{2,4}$", r"^\d{4}[_\-]\d{2}[_\-]\d{2}$", r"(?i)^-?\d+[.,]?\d*\s*°\s*[cfnesw]", r"^-?\d+[.,]?\d*°", r"^[><≤≥±]\s*\d", r"^\d+[.,]?\d*\s*[µuμmMgGkKlL][gGmMlLmM]?$"]
INSTRUMENTS = "zeiss sigma invitrogen thermo agilent illumina niskin qubit nanodrop bioanalyzer qiagen promega bd_biosciences beckman waters shimadzu".split()
EXPERIMENTS = "growth_ incubation_ optimum_ storage_ treatment_ cultivation_ induction_".split()
PLURALS = {
    "numbers": "number", "counts": "count", "samples": "sample", "measurements": "measurement", "concentrations": "concentration", "temperatures": "temperature", "depths": "depth", "salinities": "salinity",
    "locations": "location", "sites": "site", "stations": "station", "replicates": "replicate", "fractions": "fraction", "sources": "source", "volumes": "volume", "dates": "date",
}
LONGEST_KEY = 60

# Sections that are left out, and spellings of each section.
EXCLUDED_SECTIONS = ["TITLE", "REF", "FIG", "COMP_INT", "AUTH_CONT", "REVIEW_INFO", "APPENDIX"]
SECTIONS = {
    "ABSTRACT": ["abstract"], "INTRO": ["intro", "introduction", "background"], "METHODS": ["method", "methods", "materials and methods", "materials & methods", "experimental"], "RESULTS": ["result", "results", "finding", "findings"],
    "DISCUSS": ["discussion", "discuss"], "CONCL": ["conclusion", "conclusions", "concl"], "SUPPL": ["supplement", "supplementary", "supporting", "appendix"], "TABLE": ["table", "tables"],
}


def representatives(members: DataFrame, group: str, name: str, papers: str) -> DataFrame:
    """The clearest name of each group: without odd characters, an accepted short name, no formula, not too short or
    long, no camel case, no missing underscore, with a full word, most papers, shortest, first in the alphabet."""
    n = F.col(name)
    low = F.lower(n)
    plain = F.translate(low, "- ", "__")
    no_bar = ~F.contains(n, F.lit("_"))
    peers = Window.partitionBy(group, F.replace(low, F.lit("_"), F.lit("")))
    has_peer = no_bar & (F.max((~no_bar).cast("int")).over(peers) > 0)
    rooted = F.coalesce(*[F.when(F.startswith(n, F.lit(r)) & (F.length(n) > len(r) + 2), F.lit(True)) for r in ROOTS], F.lit(False))
    missing = (n == low) & (n != F.upper(n)) & no_bar & (F.length(n) >= 7) & rooted
    camel = (n != low) & (n != F.upper(n)) & no_bar & (F.length(n) >= 5)
    short_ok = low.isin(*SHORT_NAMES)
    stem = F.regexp_extract(F.regexp_replace(low, "^[+−–-]+|[+−–-]+$", ""), "^([^_-]*)", 1)
    full = F.coalesce(*[F.when(F.contains(plain, F.lit(w)), F.lit(True)) for w in FULL_WORDS], F.lit(False))
    odd = F.translate(n, ODD_CHARACTERS, "") != n
    bit = lambda c: c.cast("int")
    score = F.struct(
        bit(odd).alias("odd"), (-bit(short_ok)).alias("short_ok"), bit(stem.isin(*FORMULAS)).alias("formula"), bit((F.length(n) < 4) & ~short_ok).alias("short"), bit(F.length(n) > 30).alias("long"), bit(camel).alias("camel"),
        bit(has_peer | missing).alias("missing"), (-bit(full)).alias("full"), (-F.col(papers)).alias("papers"), F.length(n).alias("n"), n.alias("name"),
    )
    named = members.filter(F.coalesce(n, F.lit("")) != "").withColumn("__score", score)
    return named.groupBy(group).agg(F.min("__score")["name"].alias("representative"), F.count("*").alias("n_members"))


def verdict(raw: Column, evidence: Column) -> Column:
    """struct of key, evidence and verdict (accepted, review or dropped, with the reason)."""
    key, clip = T.key_strict(raw, PLURALS), T.clipped(evidence)
    made = F.transform(F.array(F.struct(key.alias("key"), clip.alias("evidence"))), lambda x: F.struct(x["key"].alias("key"), x["evidence"].alias("evidence"), _ruling(x["key"], x["evidence"]).alias("verdict")))
    return made[0]


def _ruling(key: Column, evidence: Column) -> Column:
    brand = "|".join(INSTRUMENTS)
    return (
        F.when(key.isNull(), "dropped: no key").when(F.coalesce(evidence, F.lit("")) == "", "dropped: no evidence").when(key.isin(*SCIENTIFIC), "accepted")
        .when(key.rlike("|".join(VALUE_FORMS)), "dropped: value").when(key.rlike(rf"^(?:{brand})[0-9a-z_-]*$|(?:^|_)(?:{brand})(?:_|$)"), "dropped: instrument")
        .when(key.rlike("^(?:" + "|".join(EXPERIMENTS) + ")"), "dropped: experiment").when(F.length(key) > LONGEST_KEY, "review: long").when(key.rlike(r"\d{4}"), "review: digits").otherwise("accepted")
    )


def section(raw: Column) -> Column:
    """canonical section; its own name in any case, else a known spelling, else ``unknown``."""
    low = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    table = F.create_map(*[F.lit(x) for s, all_ in SECTIONS.items() for a in all_ for x in (a, s)])
    return F.when(F.upper(low).isin(*SECTIONS), F.upper(low)).otherwise(F.coalesce(F.element_at(table, low), F.lit("unknown")))


def is_excluded_section(raw: Column, excluded: list[str] | None = None) -> Column:
    """an empty override falls back to the default."""
    return F.upper(raw).isin(*(excluded or EXCLUDED_SECTIONS))


def is_table_like(section_type: Column, source: Column) -> Column:
    """F8."""
    s = F.lower(source)
    has = lambda *words: s.rlike("|".join(w.replace(".", r"\.") for w in words))
    return (F.upper(F.trim(section_type)) == "TABLE") | has(".xlsx", ".xls", ".csv", ".tsv") | (F.contains(s, F.lit("table")) & has(".docx", ".pdf"))
