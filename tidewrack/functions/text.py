"""String functions of field names, accessions, units and evidence (all null in, null out unless said otherwise)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewrack import constants as K


def key_joined(c: Column) -> Column:
    """Trimmed, lower-cased, spaces and hyphens as underscores."""
    return F.translate(F.lower(F.trim(c)), " -", "__")


def key_strict(c: Column, plurals: dict[str, str] | None = None) -> Column:
    """Word characters only, separators as single underscores, plural tokens mapped; null under two characters."""
    kept = F.regexp_replace(F.lower(F.trim(c)), r"[^\w\s/\-,]", "")
    joined = F.regexp_replace(F.regexp_replace(kept, r"[/,\s]+", "_"), r"[^a-z0-9_-]", "")
    bare = F.regexp_replace(F.regexp_replace(joined, "_+", "_"), r"^[_-]+|[_-]+$", "")
    if plurals:
        table = F.create_map(*[F.lit(x) for kv in plurals.items() for x in kv])
        bare = F.array_join(F.transform(F.split(bare, "_"), lambda t: F.coalesce(F.element_at(table, t), t)), "_")
    return F.when(F.length(bare) >= 2, bare)


def key_loose(c: Column) -> Column:
    """Lower-cased, runs of white space, slashes and hyphens as one underscore, ends stripped."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[\s/\-]+", "_"), "_+", "_"), "^_+|_+$", "")


def key_plain(c: Column) -> Column:
    """T4."""
    return F.lower(F.trim(c))


def quantity_kind(c: Column) -> Column:
    """T5: letters, digits and single underscores; ``other`` when nothing is left."""
    x = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[\s\-/]+", "_"), r"[^a-z0-9_]", "")
    x = F.regexp_replace(F.regexp_replace(x, "_+", "_"), "^_|_$", "")
    return F.coalesce(F.nullif(x, F.lit("")), F.lit("other"))


def column_name(c: Column) -> Column:
    """Without parentheses, everything else that is not alphanumeric as one underscore, lower-cased."""
    x = F.regexp_replace(F.regexp_replace(c, r"\([^)]*\)", ""), r"[^A-Za-z0-9]+", "_")
    return F.lower(F.regexp_replace(x, "^_+|_+$", ""))


def comparable(c: Column) -> Column:
    """The form in which names are compared; the first matching unit ending goes if more than two characters stay."""
    t = F.regexp_replace(F.lower(F.trim(c)), r"\([^)]*\)", "")
    cut = F.coalesce(*[F.when(F.endswith(t, F.lit(s)) & (F.length(t) > len(s) + 2), F.left(t, F.length(t) - len(s))) for s in K.SIMILARITY_SUFFIXES], t)
    return F.regexp_replace(F.regexp_replace(cut, r"[_\s]+", "_"), "^_+|_+$", "")


def name_tokens(c: Column) -> Column:
    """Distinct parts between underscores and between digits and other characters."""
    return F.array_distinct(F.filter(F.split(c, r"_+|(?<=\D)(?=\d)|(?<=\d)(?=\D)"), lambda t: t != ""))


def similar(a: Column, b: Column) -> Column:
    """Equal, token Jaccard, edit distance or containment of comparable forms."""
    x, y = comparable(a), comparable(b)
    return similar_forms(x, y, name_tokens(x), name_tokens(y))


def similar_forms(x: Column, y: Column, s: Column, t: Column) -> Column:
    """J11 on comparable forms and their tokens."""
    jaccard = F.size(F.array_intersect(s, t)) / F.size(F.array_union(s, t))
    short, long = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    cap = F.greatest(F.lit(K.EDIT_CAP), F.floor(short * K.EDIT_RATIO).cast("int"))
    smaller = F.when(F.length(x) < F.length(y), x).otherwise(y)
    larger = F.when(F.length(x) < F.length(y), y).otherwise(x)
    inside = (short > 0) & F.contains(larger, smaller) & (short / long >= K.SUBSTRING_RATIO)
    edits = F.call_function("levenshtein", x, y, cap)  # -1 beyond the cap, where it stops counting
    return (x == y) | inside | ((long - short <= cap) & (edits >= 0)) | ((F.size(s) > 0) & (F.size(t) > 0) & (jaccard >= K.TOKEN_JACCARD))


def qk_variants(c: Column) -> Column:
    """Literal variants of a quantity kind: without a qualifying suffix or prefix, singular, and ``x_of_y`` turned."""
    cut = lambda p: F.regexp_replace(c, p, "")
    turned = F.regexp_replace(c, r"^(.+)_of_(.+)$", "$2_$1")
    forms = [cut("_(concentration|content|level|value|rate)$"), cut("^(total|mean|average)_"), cut("(?<=[a-z]{3})s$"), turned]
    return F.array_except(F.array_distinct(F.array(*forms)), F.array(c))


def truncated(c: Column, most: int) -> Column:
    """70 % of the room for the head, the rest for the tail, a marker between."""
    head = int(most * 0.7)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.left(c, F.lit(head)), F.lit("\n...\n"), F.right(c, F.lit(most - head))))


def clipped(c: Column, most: int = 500) -> Column:
    """Squeezed white space; longer than ``most``: cut, with an ellipsis."""
    x = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.rtrim(F.left(x, F.lit(most))), F.lit(" ...")))


def accessions(c: Column) -> Column:
    """Archive accessions in a text, in order, repeats included."""
    return F.regexp_extract_all(c, F.lit(K.ACCESSION), F.lit(1))


def accession_level(c: Column) -> Column:
    """Level by the longest known prefix, else ``unknown``."""
    known = sorted(K.LEVEL_OF_PREFIX.items(), key=lambda kv: -len(kv[0]))
    return F.coalesce(*[F.when(F.startswith(c, F.lit(p)), F.lit(v)) for p, v in known], F.lit("unknown"))


def slot(standard: Column, canonical: Column, raw: Column) -> Column:
    """Namespaced slot from the first of standard slot, canonical name and raw name that is not blank."""
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(F.concat(F.lit("mixs:"), full(standard)), F.concat(F.lit("internal:"), full(canonical)), F.concat(F.lit("internal:"), F.lower(full(raw))))


def section_tier(c: Column) -> Column:
    """T25."""
    has = lambda *words: F.lower(c).rlike("|".join(words))
    return F.when(has("method", "result"), 1).when(has("intro", "discussion", "main text", "abstract"), 2).otherwise(3)


def acronym(c: Column) -> Column:
    """Initials of the parts of a name of two parts or more, else null."""
    parts = F.filter(F.split(c, "_"), lambda t: t != "")
    return F.when(F.size(parts) >= 2, F.array_join(F.transform(parts, lambda t: F.left(t, F.lit(1))), ""))


def record_id(*parts: Column) -> Column:
    """Parts joined by pipes; null counts as empty."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def segment_hash(c: Column) -> Column:
    """T34."""
    return F.md5(c.cast("binary"))


def unit(c: Column) -> Column:
    """Canonical unit; unknown ones lower-cased, blank and null ones empty."""
    spelled = {s: u for u, all_ in K.UNITS.items() for s in all_}
    table = F.create_map(*[F.lit(x) for kv in spelled.items() for x in kv])
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.coalesce(F.element_at(table, low), low)


def listed(c: Column, separator: str = ",") -> Column:
    """Parts, trimmed, without blank ones and ``(empty)``."""
    parts = F.transform(F.split(c, rf"[{separator}]"), lambda x: F.trim(x))
    return F.filter(parts, lambda t: ~t.isin("", "(empty)"))


def normalizer_of(syntax: Column) -> Column:
    """The value normaliser that a value syntax asks for."""
    s = F.lower(F.trim(syntax))
    return (
        F.when(s == "{float} {unit}", "float_with_unit").when(s == "{float}", "float").when(s == "{integer}", "integer").when(s == "{boolean}", "boolean")
        .when(s == "{timestamp}", "timestamp").when(s == "{duration}", "duration").when(s == "{float} {float}", "lat_lon").when(s.rlike(r"^\[.*\|.*\]$"), "enum")
        .when(s.rlike(r"^\{text\};\{float\} \{unit\}$"), "compound").when(s.rlike(r"^\{float\} *- *\{float\}"), "range").otherwise("passthrough")
    )


def alias(c: Column, target: Column) -> Column:
    """Trimmed alias; null if blank or equal to its target in any case."""
    t = F.trim(c)
    return F.when((t != "") & (F.lower(t) != F.lower(F.trim(target))), t)


def environment_labels(labels: Column, valid: list[str] | None = None, other: str = K.OTHER_ENVIRONMENT) -> Column:
    """Valid labels in order, once each; ``other`` goes if a target label stays."""
    targets = valid or K.ENVIRONMENTS
    kept = F.array_distinct(F.filter(F.transform(labels, lambda x: F.trim(x)), lambda x: x.isin(*targets, other)))
    return F.when(F.size(F.array_remove(kept, other)) > 0, F.array_remove(kept, other)).otherwise(kept)


def field_values(c: Column) -> Column:
    """Array of (field, value) from ``field: value || field: value``; blank ones dropped."""
    pairs = F.transform(F.split(c, r"\|\|"), lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("field"), F.trim(F.when(F.contains(p, F.lit(":")), F.regexp_replace(p, "^[^:]*:", ""))).alias("value")))
    return F.filter(pairs, lambda x: (x["field"] != "") & x["value"].isNotNull() & (x["value"] != ""))


def decompose(key: Column) -> Column:
    """Struct of root, stat, qualifier, unit, replicate, aggregation, isotope, taxon and sorted substances.

    Suffixes go in the order replicate, stat, qualifier, unit (up to two units, the second names the tag); then up to
    four passes take off stat, aggregation, isotope and taxon prefixes whose tags are empty. A part goes only if two
    characters or more stay. Substances are read from the root that is left.
    """
    alternatives = lambda words: "|".join(sorted(set(words), key=lambda w: (-len(w), w)))
    bare = lambda c: F.regexp_replace(c, "^_+|_+$", "")
    none = F.lit(None).cast("string")
    state = F.struct(key.alias("root"), *[none.alias(t) for t in ("stat", "qualifier", "unit", "replicate", "aggregation", "isotope", "taxon")])

    def strip(s: Column, tag: str, pattern: str, rest: int, hit: int, keep: bool = True) -> Column:
        found = F.regexp_extract(s["root"], pattern, hit)
        left = bare(F.regexp_extract(s["root"], pattern, rest))
        ok = (found != "") & (F.length(left) >= 2)
        if keep:
            ok = ok & s[tag].isNull()
        return F.when(ok, s.withField("root", left).withField(tag, found)).otherwise(s)

    def chain(s: Column, steps) -> Column:
        # each step reads the struct of the one before through a one-element array, so that it is computed once
        for step in steps:
            s = F.transform(F.array(s), step)[0]
        return s

    suffix = lambda tag, words, keep: lambda s: strip(s, tag, rf"^(.*?)_({words})$", 1, 2, keep)
    prefix = lambda tag, words: lambda s: strip(s, tag, rf"^({words})_(.*)$", 2, 1)
    units = alternatives(K.UNIT_SUFFIXES)
    steps = [suffix("replicate", r"\d{1,2}", True), suffix("stat", alternatives(K.STAT_SUFFIXES), True), suffix("qualifier", alternatives(K.QUALIFIER_SUFFIXES), True), suffix("unit", units, True), suffix("unit", units, False)]
    once = [prefix("stat", alternatives(K.STAT_PREFIXES)), prefix("aggregation", alternatives(K.AGGREGATION_PREFIXES)), prefix("isotope", alternatives(K.ISOTOPES)), prefix("taxon", alternatives(K.TAXA))]
    done = chain(state, steps + once * 4)
    element = F.create_map(*[F.lit(x) for e, words in K.SUBSTANCES.items() for w in words for x in (w, e)])
    substance = lambda s: F.array_sort(F.array_distinct(F.filter(F.transform(F.split(s["root"], "_"), lambda t: F.element_at(element, t)), lambda e: e.isNotNull())))
    return F.transform(F.array(done), lambda s: s.withField("substances", substance(s)))[0]


def root_tokens(root: Column) -> Column:
    """Parts of a root without stopwords."""
    return F.filter(F.split(root, "_"), lambda t: (t != "") & ~t.isin(*K.STOPWORDS))


# Tokens of the sampling context; environments by their spellings; categories of reasons by their words.
CONTEXT_TOKENS = (
    "sampling sample sampled samp sampl collection collected collecting collect coll collector isolation isolated isolating "
    "situ measured measurement measure measuring environmental environment study studied water waters"
).split()
ENVIRONMENT_KEYS = {"open_ocean": "Open_ocean", "coastal_waters": "Coastal_waters", "wetlands": "Wetlands", "lake": "Lake", "ocean": "Open_ocean", "coastal": "Coastal_waters", "wetland": "Wetlands"}
REASON_WORDS = {
    "analysis_result": ["丰度", "计数", "拷贝数", "生物量", "覆盖度", "reads", "qPCR", "菌落", "OTU", "ASV", "物种", "群落", "比值"],
    "identifier": ["编号", "航次", "数据集", "站点编号", "站点名称", "site_id", "Cruise", "国家代码", "Project"],
    "processing": ["过滤", "孔径", "试剂", "提取", "保存", "采样工具", "样品保存", "pore", "filter", "preservation", "库建", "测序", "reagent"],
    "study_design": ["实验", "模拟", "处理参数", "treatment", "experimental", "施加", "添加", "研究设计", "培养"],
    "bio_object": ["体长", "体重", "size", "生物个体", "年龄", "性别", "身长", "宿主", "prawn", "urchin", "stem", "植物", "生物属性", "龄"],
    "descriptive": ["描述", "自由文本", "综合描述", "定性", "注释"],
}


def core_tokens(root: Column) -> Column:
    """Root tokens without those of the sampling context, once each."""
    return F.array_distinct(F.array_except(root_tokens(root), F.array(*[F.lit(t) for t in CONTEXT_TOKENS])))


def reason_category(reason: Column) -> Column:
    """The first category with a word that the reason holds."""
    r = F.coalesce(reason, F.lit(""))
    has = lambda words: F.coalesce(*[F.when(F.contains(r, F.lit(w)), F.lit(True)) for w in words], F.lit(False))
    return F.coalesce(*[F.when(has(words), F.lit(c)) for c, words in REASON_WORDS.items()], F.lit("other"))


def environment_key(env: Column) -> Column:
    """A known spelling's environment, else the lower-cased text."""
    low = F.lower(env)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ENVIRONMENT_KEYS.items() for x in kv]), low), low)


def environment_labels_of(text: Column) -> Column:
    """Labels from a text of parts between commas."""
    return environment_labels(F.split(text, ","))


def prefixed_name(name: Column, version: Column) -> Column:
    """A file name under the version of its prompt, once."""
    prefix = F.concat(version, F.lit("_"))
    return F.when(F.startswith(name, prefix), name).otherwise(F.concat(prefix, name))


def description(key: Column, subtype: Column, kind: Column, modifiers: Column) -> Column:
    """One line about a key: what it is a field of, what it measures if that says more, and with which modifiers."""
    kind = F.coalesce(kind, F.lit(""))
    parts = [
        key, F.when(F.coalesce(subtype, F.lit("")) != "", F.concat(F.lit("a "), subtype, F.lit(" field"))),
        F.when((kind != "") & (kind != key) & (kind != "other"), F.concat(F.lit("measuring "), kind)),
        F.when(F.trim(F.coalesce(modifiers, F.lit(""))) != "", F.concat(F.lit("with modifiers "), F.replace(modifiers, F.lit("|"), F.lit(", ")))),
    ]
    return F.concat(F.concat_ws(". ", *parts), F.lit("."))


def tier_text(papers: Column, pct: Column, least: int) -> Column:
    """Why a field is in its tier."""
    high = F.format_string("High literature frequency (%d PMIDs, %.1f%%) >= absolute threshold (%d PMIDs); no MIxS equivalent", papers, pct, F.lit(least))
    low = F.format_string("Low literature frequency (%d PMIDs, %.1f%%), below Tier 2 threshold (%d PMIDs)", papers, pct, F.lit(least))
    return F.when(papers >= least, high).otherwise(low)


def metadata_words(names: Column, generic: list[str]) -> Column:
    """Words of two characters or more in a list of names, without generic ones, sorted."""
    words = F.flatten(F.transform(names, lambda n: F.regexp_extract_all(F.lower(n), F.lit(r"[a-z0-9]{2,}"), F.lit(0))))
    return F.array_sort(F.array_except(F.array_distinct(words), F.array(*[F.lit(g) for g in generic]).cast("array<string>")))
