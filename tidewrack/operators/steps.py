"""Steps between the stages: which items go on, how results come back to their inputs, summaries of what was kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.operators.ranking import last_wins, top

# Fixed value: the failed family, and the label of items that no model sees.
FAILED, OTHERS = "FAILED", "Others"


def relation_input(items: DataFrame, targets: DataFrame, paper: str, section: str, abstract: str = "ABSTRACT") -> DataFrame:
    """items of target papers that have an abstract, without the abstracts themselves."""
    with_abstract = items.filter(F.upper(section) == abstract).select(paper)
    return items.join(targets.select(paper), paper, "left_semi").join(with_abstract, paper, "left_semi").filter(F.upper(section) != abstract)


def prefiltered(items: DataFrame, known: Column, label: str = "label") -> DataFrame:
    """The synthetic record of an item that the pre-filter keeps from the model."""
    return items.filter(~F.coalesce(known, F.lit(False))).select("*", F.lit(OTHERS).alias(label), F.lit("prefilter").alias("origin"))


def routed(items: DataFrame, whitelist: DataFrame, key: str, term: str) -> DataFrame:
    """Items with a whitelisted key wait for the model (label null), the others get a synthetic record."""
    marked = items.join(whitelist.select(F.lower(term).alias("__t")).distinct(), F.lower(F.trim(key)) == F.col("__t"), "left")
    queue = marked.filter("__t IS NOT NULL").select("*", F.lit(None).cast("string").alias("label"), F.lit("model").alias("origin"))
    return queue.unionByName(prefiltered(marked, F.col("__t").isNotNull())).drop("__t")


def without_failed(rows: DataFrame, family: str) -> DataFrame:
    """rows of families that came out; null families stay."""
    return rows.filter(~F.col(family).eqNullSafe(F.lit(FAILED)))


def without_singletons(members: DataFrame, family: str, member: str, least: int = 2) -> DataFrame:
    """members of families of at least so many different ones."""
    sizes = members.groupBy(family).agg(F.countDistinct(member).alias("__n")).filter(F.col("__n") >= least)
    return members.join(sizes.select(family), family, "left_semi")


def target_accessions(accessions: DataFrame, samples: DataFrame, links: DataFrame) -> DataFrame:
    """accessions that are a target sample, or are linked to one, or are or are linked to a project with one.

    ``accessions``: acc; ``samples``: sample, project (target samples only); ``links``: acc, other.
    """
    good = samples.select(F.col("sample").alias("acc")).union(samples.select(F.col("project").alias("acc"))).filter("acc IS NOT NULL").distinct()
    over = links.join(good.withColumnRenamed("acc", "other"), "other", "left_semi").select("acc")
    return accessions.join(good.union(over).distinct(), "acc", "left_semi")


def odd_keys(rows: DataFrame, key: str, spaces: list[str]) -> DataFrame:
    """number of keys in and outside of the known name spaces."""
    ok = F.coalesce(*[F.when(F.startswith(F.col(key), F.lit(s + ":")), F.lit(s)) for s in spaces], F.lit("none"))
    return rows.groupBy(ok.alias("space")).agg(F.count("*").alias("n"))


def joined_last(left: DataFrame, right: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Left join after only the last row of each key is kept on the right, so that no left row multiplies."""
    return left.join(last_wins(right, [key], ordinal).drop(ordinal), key, "left")


def inherited(kinds: DataFrame, overlaps: DataFrame, decisions: DataFrame, rejected: DataFrame) -> DataFrame:
    """Decision on each new group. ``kinds``: new, kind; ``overlaps``: new, old, exact; ``decisions``: old, approved.

    Exact: the old group's; partial: approved if any old one is; new: approved unless rejected by name.
    """
    old = overlaps.join(decisions, "old").groupBy("new").agg(F.bool_or(F.when(F.col("exact"), F.col("approved"))).alias("own"), F.bool_or("approved").alias("any"))
    marked = kinds.join(old, "new", "left").join(rejected.select("new", F.lit(True).alias("no")), "new", "left")
    ruling = F.when(F.col("kind") == "exact", F.col("own")).when(F.col("kind") == "partial", F.col("any")).otherwise(F.col("no").isNull())
    return marked.select("new", "kind", F.coalesce(ruling, F.lit(False)).alias("approved"))


def with_more_aliases(canonicals: DataFrame, raw: DataFrame, key: Column, normalized: str = "normalized", alias: str = "raw_key") -> DataFrame:
    """J28, SRC19: raw keys of a canonical's normalised key join its aliases, once each and sorted."""
    more = raw.groupBy(F.col(normalized).alias("__k")).agg(F.collect_set(alias).alias("__more"))
    joined = canonicals.withColumn("__k", key).join(more, "__k", "left").drop("__k")
    return joined.withColumn("aliases", F.array_sort(F.array_distinct(F.concat("aliases", F.coalesce("__more", F.array().cast("array<string>")))))).drop("__more")


def consistent(predicted: DataFrame, given: DataFrame, by: str, parts: list[str]) -> DataFrame:
    """Whether the identity that a model gave back is that of its input, null and empty being the same."""
    same = F.lit(True)
    for c in parts:
        same = same & (F.coalesce(F.col(f"p.{c}"), F.lit("")) == F.coalesce(F.col(f"g.{c}"), F.lit("")))
    return given.alias("g").join(predicted.alias("p"), by, "left").select(by, (same & F.col(f"p.{parts[0]}").isNotNull()).alias("ok"))


def split_coverage(all_: DataFrame, kept: DataFrame, papers: str) -> DataFrame:
    """A3: rows and summed papers of the kept part, of all, and their percentages."""
    total = all_.agg(F.count("*").alias("n_all"), F.sum(papers).alias("papers_all"))
    part = kept.agg(F.count("*").alias("n_kept"), F.sum(papers).alias("papers_kept"))
    return total.join(part).withColumn("pct", F.round(100 * F.col("papers_kept") / F.col("papers_all"), 2)).withColumn("pct_rows", F.round(100 * F.col("n_kept") / F.col("n_all"), 2))


def by_environment(facts: DataFrame, env: str, paper: str) -> DataFrame:
    """Distinct papers of each environment."""
    return facts.groupBy(env).agg(F.countDistinct(paper).alias("n_papers"))


def in_several(facts: DataFrame, env: str, paper: str) -> DataFrame:
    """Papers of more than one environment."""
    return facts.groupBy(paper).agg(F.countDistinct(env).alias("n_envs")).filter("n_envs > 1")


def distributions(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of every value of several columns, as (column, value, n); null counts as a value."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x"))
    return long.groupBy("x.column", "x.value").agg(F.count("*").alias("n"))


def family_preview(members: DataFrame, family: str, member: str, k: int) -> DataFrame:
    """The ``k`` largest families."""
    return members.groupBy(family).agg(F.countDistinct(member).alias("size")).orderBy(F.col("size").desc(), family).limit(k)


def longest_name(members: DataFrame, group: str, name: str) -> DataFrame:
    """Most tokens, longest, first in the alphabet."""
    return members.groupBy(group).agg(F.min(F.struct((-F.size(F.split(F.col(name), "_"))).alias("t"), (-F.length(name)).alias("l"), F.col(name).alias("n")))["n"].alias("canonical"))


def frequent_name(members: DataFrame, group: str, name: str, frequency: str) -> DataFrame:
    """Most frequent, shortest, first in the alphabet."""
    return members.groupBy(group).agg(F.min(F.struct((-F.col(frequency)).alias("f"), F.length(name).alias("l"), F.col(name).alias("n")))["n"].alias("representative"))


def first_evidence(rows: DataFrame, key: str, ordinal: str, n: int) -> DataFrame:
    """W5e: the first ``n`` rows of each key, repeats included."""
    return top(rows, [key], [F.col(ordinal)], n)


def ordered_distinct(values: Column) -> Column:
    """Trimmed values in order, once each, without blank ones."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != ""))


def ordered_labels(rows: DataFrame, paper: str, labels: str, ordinal: str) -> DataFrame:
    """Labels of a paper's rows in order, once each."""
    listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(ordinal, labels))), lambda x: x[labels]))
    return rows.groupBy(paper).agg(F.array_distinct(listed).alias("labels"))


def first_in_any_case(rows: DataFrame, by: str, value: str, ordinal: str) -> DataFrame:
    """Of values that agree but for case and blanks around them, the first."""
    return top(rows.withColumn("__v", F.lower(F.trim(value))), [by, "__v"], [F.col(ordinal)], 1).drop("rn", "__v")


def merged_sources(**sources: DataFrame) -> DataFrame:
    """Rows of several sources with the name of theirs."""
    out = None
    for name, rows in sources.items():
        marked = rows.withColumn("source", F.lit(name))
        out = marked if out is None else out.unionByName(marked, allowMissingColumns=True)
    return out


def inverted(canonicals: DataFrame, canonical: str, aliases: str) -> DataFrame:
    """Canonical of each alias, and of itself, in long form."""
    return canonicals.select(F.explode(F.concat(F.array(canonical), aliases)).alias("key"), F.col(canonical).alias("canonical")).distinct()


def paper_environments(rows: DataFrame, envs: str, targets: list[str]) -> DataFrame:
    """Rows with at least one target environment, and only those."""
    kept = F.filter(envs, lambda e: e.isin(*targets))
    return rows.withColumn(envs, kept).filter(F.size(envs) > 0)


def success_rates(targets: DataFrame, results: DataFrame, target: str, good: Column) -> DataFrame:
    """Tries, successes and rate (4 digits) of every target, zeros for those never tried."""
    counts = results.groupBy(target).agg(F.count("*").alias("tries"), F.count_if(good).alias("successes"))
    out = targets.select(target).distinct().join(counts, target, "left").fillna(0, ["tries", "successes"])
    return out.withColumn("rate", F.when(F.col("tries") > 0, F.round(F.col("successes") / F.col("tries"), 4)).otherwise(F.lit(0.0)))


def finalized(accessions: DataFrame, identities: DataFrame, values: DataFrame) -> DataFrame:
    """Accessions that have an identity and values: environment (the accession's, else the identity's) and sorted labels.

    ``accessions``: acc, env; ``identities``: acc, env, label; ``values``: acc.
    """
    own = identities.groupBy("acc").agg(F.min("env").alias("__env"), F.array_sort(F.collect_set("label")).alias("labels"))
    return accessions.join(values.select("acc"), "acc", "left_semi").join(own, "acc").select("acc", F.coalesce("env", "__env").alias("env"), "labels")


def shared_prompt(sections: DataFrame, paper: str, section: str, text: str, ordinal: str, most: int) -> DataFrame:
    """Sections of a paper as one context of at most ``most`` characters, each under its name: the reference's own clip."""
    one = F.concat(F.lit("["), F.col(section), F.lit("]\n"), F.col(text))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), one.alias("t")))), lambda x: x["t"]), "\n\n")
    return sections.groupBy(paper).agg(F.left(joined, F.lit(most)).alias("context"))


def provenance(**columns: Column) -> Column:
    """A struct of where a value comes from; blank texts as null."""
    return F.struct(*[F.when(F.trim(c.cast("string")) != "", c).alias(n) for n, c in columns.items()])


def main_list(rows: DataFrame, total: DataFrame, name: str, papers: str, musts: list[str]) -> DataFrame:
    """Coverage of a list in percent of all papers, and which names that must be there none contains."""
    pct = rows.agg(F.sum(papers).alias("s")).join(total.agg(F.sum(papers).alias("t"))).select(F.lit("coverage").alias("check"), F.round(100 * F.col("s") / F.col("t"), 2).cast("string").alias("value"))
    found = rows.agg(*[F.coalesce(F.bool_or(F.contains(F.col(name), F.lit(m))), F.lit(False)).alias(m) for m in musts])
    long = found.select(F.explode(F.array(*[F.struct(F.lit(m).alias("check"), F.col(m).cast("string").alias("value")) for m in musts])).alias("x")).select("x.*")
    return pct.unionByName(long)


def snapshot(table: DataFrame, path: str, version: int) -> None:
    """ST3: a whole version of a table in a folder of its number."""
    table.write.mode("overwrite").parquet(f"{path}/version={version}")


def newest(spark, path: str) -> DataFrame:
    """ST3: the rows of the highest version."""
    rows = spark.read.parquet(path)
    return rows.join(rows.agg(F.max("version").alias("version")), "version").drop("version")


def overlapping(members: DataFrame, primary: DataFrame, member: str, chunk: str) -> DataFrame:
    """Rows of partitions whose member has its primary family in the chunk."""
    return members.join(primary.select(member, chunk), [member, chunk], "left_semi")


def share_in_group(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Counts of values inside groups with their share."""
    n = rows.groupBy(by, value).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(by)), 6))
