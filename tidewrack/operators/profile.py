"""Occurrence facts and profiles of keys over environments (facts: key, env, paper)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack import constants as K
from tidewrack.functions import stats


def env_vectors(facts: DataFrame, envs: list[str]) -> DataFrame:
    """A1: distinct papers of each key by environment as columns env_<E>, total_papers (a paper of several environments
    counts in each) and n_envs_present. One shuffle by (key, env, paper) whose partial step drops repeats, one by key."""
    distinct = facts.filter(F.col("env").isin(*envs)).select("key", "env", "paper").distinct()
    counts = distinct.groupBy("key").agg(*[F.count_if(F.col("env") == e).alias(f"env_{e}") for e in envs])
    columns = [F.col(f"env_{e}") for e in envs]
    return counts.withColumn("total_papers", reduce(lambda a, b: a + b, columns)).withColumn("n_envs_present", reduce(lambda a, b: a + b, [(c > 0).cast("int") for c in columns]))


def classified(vectors: DataFrame, envs: list[str]) -> DataFrame:
    """M1, M2: h_norm, dominant_env, dominant_share and category."""
    counts = {e: F.col(f"env_{e}") for e in envs}
    name, share = stats.dominant(counts)
    out = vectors.withColumn("h_norm", stats.entropy(list(counts.values()))).withColumn("dominant_env", name).withColumn("dominant_share", share)
    return out.withColumn("category", stats.category(F.col("h_norm"), F.col("dominant_share"), F.col("total_papers")))


def mainstream(vectors: DataFrame, least: int = K.MAINSTREAM_PAPERS) -> tuple[DataFrame, DataFrame]:
    """keys of at least so many papers, and the others."""
    return vectors.filter(F.col("total_papers") >= least), vectors.filter(F.col("total_papers") < least)


def inverted_index(facts: DataFrame, *by: str) -> DataFrame:
    """Number of papers and their sorted ids, joined by spaces, for each key or (key, environment)."""
    return facts.groupBy(*by).agg(F.countDistinct("paper").alias("n_papers"), F.array_join(F.array_sort(F.collect_set(F.col("paper").cast("string"))), " ").alias("papers"))


def document_frequency(keys: DataFrame, tokens: Column) -> DataFrame:
    """Keys that hold each token."""
    return keys.select("key", F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def coverage_curve(keys: DataFrame, tokens: Column, thresholds: list[int]) -> DataFrame:
    """Share of keys with a token of at least each frequency, and number of such tokens."""
    exploded = keys.select("key", F.explode(F.array_distinct(tokens)).alias("token"))
    df = document_frequency(keys, tokens)
    best = exploded.join(df, "token").groupBy("key").agg(F.max("df").alias("df"))
    n_keys = [F.count_if(F.col("df") >= t).alias(f"k{t}") for t in thresholds]
    n_tokens = [F.count_if(F.col("df") >= t).alias(f"t{t}") for t in thresholds]
    one = best.agg(F.count("*").alias("n"), *n_keys).join(df.agg(*n_tokens))
    rows = F.array(*[F.struct(F.lit(t).alias("tau"), F.col(f"k{t}").alias("n_keys"), F.col(f"t{t}").alias("n_headwords"), (F.col(f"k{t}") / F.col("n")).alias("coverage")) for t in thresholds])
    return one.select(F.inline(rows))


def headword_threshold(keys: DataFrame, tokens: Column, target: float) -> DataFrame:
    """The greatest frequency at which the share of keys still reaches ``target``; else the smallest one."""
    df = document_frequency(keys, tokens)
    best = keys.select("key", F.explode(F.array_distinct(tokens)).alias("token")).join(df, "token").groupBy("key").agg(F.max("df").alias("df"))
    hist = best.groupBy("df").agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.orderBy(F.col("df").desc()))
    share = hist.select("df", (above / F.sum("n").over(Window.partitionBy())).alias("coverage"))
    return share.agg(F.coalesce(F.max(F.when(F.col("coverage") >= target, F.col("df"))), F.min("df")).alias("tau"))


def threshold_grid(vectors: DataFrame, grid: list[tuple]) -> DataFrame:
    """Counts of the four categories under each combination of thresholds (h_univ, n_univ, n_cross, h_sig, s_sig).

    Keys are first grouped by what the thresholds can tell apart, so the grid meets counts, not keys.
    """
    cut = lambda c, values: reduce(lambda a, b: a + b, [(F.col(c) > v).cast("int") for v in sorted(set(values))])
    hs, ns, ss = [g[0] for g in grid] + [g[3] for g in grid], [g[1] for g in grid] + [g[2] for g in grid] + [K.PAPERS_SIGNATURE], [g[4] for g in grid]
    low = sorted({g[3] for g in grid})
    under = reduce(lambda a, b: a + b, [(F.col("h_norm") >= v).cast("int") for v in low])
    cells = vectors.groupBy(cut("h_norm", hs).alias("h"), under.alias("g"), cut("total_papers", ns).alias("n"), cut("dominant_share", ss).alias("s")).count()
    above = lambda values, v: sorted(set(values)).index(v)
    rows = []
    for hu, nu, nc, hsig, ssig in grid:
        sig = (F.col("g") <= low.index(hsig)) & (F.col("s") > above(ss, ssig)) & (F.col("n") > above(ns, K.PAPERS_SIGNATURE))
        univ = ~sig & (F.col("h") > above(hs, hu)) & (F.col("n") > above(ns, nu))
        cross = ~sig & ~univ & (F.col("h") > above(hs, hsig)) & (F.col("h") <= above(hs, hu)) & (F.col("n") > above(ns, nc))
        total = lambda c: F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0))
        rows.append((hu, nu, nc, hsig, ssig, total(univ), total(cross), total(sig), total(~(sig | univ | cross))))
    one = cells.agg(*[x.alias(f"c{i}_{j}") for i, r in enumerate(rows) for j, x in enumerate(r[5:])])
    names = ["universal", "cross_biome", "signature", "niche"]
    made = F.array(*[F.struct(F.lit(float(r[0])).alias("h_univ"), F.lit(r[1]).alias("n_univ"), F.lit(r[2]).alias("n_cross"), F.lit(float(r[3])).alias("h_sig"), F.lit(float(r[4])).alias("s_sig"), *[F.col(f"c{i}_{j}").alias(n) for j, n in enumerate(names)]) for i, r in enumerate(rows)])
    return one.select(F.inline(made))


def merged_duplicates(rows: DataFrame, by: list[str], sums: list[str], best: str, name: str) -> DataFrame:
    """Sums over rows that agree in ``by`` (nulls agree), the name of the row of greatest ``best`` (then least name)."""
    return rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums], F.count("*").alias("n_merged"), F.min_by(name, F.struct(-F.col(best), F.col(name))).alias(name))


def collapsed(rows: DataFrame, by: list[str], sums: list[str], best: str, name: str, variants: str) -> DataFrame:
    """The same without rows of a null key; distinct ``variants`` listed, null or blank ones as ``(empty)``."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by])
    listed = F.array_join(F.array_sort(F.collect_set(F.coalesce(F.nullif(F.trim(variants), F.lit("")), F.lit("(empty)")))), "|")
    return rows.filter(known).groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums], F.min_by(name, F.struct(-F.col(best), F.col(name))).alias(name), listed.alias("variants"))


def enriched(facts: DataFrame, envs: list[str]) -> DataFrame:
    """For each key its papers by environment, enrichment over the mean percentage, one-sided Fisher p-values
    and category. Papers are counted once overall; an environment's papers are those of any key in it."""
    distinct = facts.filter(F.col("env").isin(*envs)).select("key", "env", "paper").distinct()
    size = distinct.select("env", "paper").distinct().agg(F.struct(*[F.count_if(F.col("env") == e).alias(f"size_{e}") for e in envs]))
    total = facts.select("paper").distinct().agg(F.count("*"))
    counts = distinct.groupBy("key").agg(*[F.count_if(F.col("env") == e).alias(f"n_{e}") for e in envs])
    x = counts.withColumn("__size", size.scalar()).withColumn("papers_all", total.scalar()).select("*", "__size.*").drop("__size")
    x = x.withColumn("total_papers", reduce(lambda a, b: a + b, [F.col(f"n_{e}") for e in envs]))
    pct = {e: F.when(F.col(f"size_{e}") > 0, 100 * F.col(f"n_{e}") / F.col(f"size_{e}")).otherwise(0.0) for e in envs}
    mean = reduce(lambda a, b: a + b, pct.values()) / len(envs)
    present, significant = [], []
    for e in envs:
        a = F.col(f"n_{e}")
        p = stats.fisher_greater(a.cast("double"), (F.col("total_papers") - a).cast("double"), (F.col(f"size_{e}") - a).cast("double"), (F.col("papers_all") - F.col(f"size_{e}") - F.col("total_papers") + a).cast("double"))
        x = x.withColumn(f"p_{e}", p).withColumn(f"e_{e}", F.when(mean > 0, pct[e] / mean).otherwise(0.0))
        present.append(((a >= K.PRESENT_PAPERS) & (pct[e] >= K.PRESENT_PERCENT)).cast("int"))
        significant.append(((F.col(f"p_{e}") < K.ALPHA) & (F.col(f"e_{e}") >= K.ENRICHED)).cast("int"))
    x = x.withColumn("n_present", reduce(lambda a, b: a + b, present)).withColumn("n_enriched", reduce(lambda a, b: a + b, significant))
    level = F.when(F.col("n_enriched") > 0, F.col("n_enriched")).otherwise(F.greatest(F.lit(1), F.col("n_present")))
    x = x.withColumn("basis", F.when(F.col("n_enriched") > 0, "enrichment").otherwise("count"))
    return x.withColumn("category", F.when(level >= 3, "Universal").when(level == 2, "Shared").otherwise("Signature")).filter("n_present > 0")


def tiers(fields: DataFrame, papers: str, mapped: str, excluded: Column, least: int = K.TIER2_PAPERS) -> DataFrame:
    """1 for mapped fields; of others 0 where excluded, 2 from ``least`` papers, else 3."""
    return fields.withColumn("tier", F.when(F.col(mapped).isNotNull(), 1).when(excluded, 0).when(F.col(papers) >= least, 2).otherwise(3))


def dominant_vote(votes: DataFrame, group: str, value: str, order: str, ignored: str = K.OTHER_ENVIRONMENT) -> DataFrame:
    """Most frequent value of each group that is neither blank nor ``ignored``; ties go to the first seen; none:
    ``unknown``."""
    counted = votes.groupBy(group, value).agg(F.count_if((F.trim(value) != "") & (F.col(value) != ignored)).alias("n"), F.min(order).alias("o"))
    best = F.min_by(value, F.struct(-F.col("n"), F.col("o")))
    return counted.groupBy(group).agg(F.when(F.max("n") > 0, best).otherwise("unknown").alias("dominant"))


def group_sizes(groups: DataFrame, by: str) -> DataFrame:
    """Number, least, greatest and index-based percentiles (no interpolation) of group sizes.

    Sizes are counted first; percentiles come from the running count over distinct sizes, not from a list of all.
    """
    sizes = groups.groupBy(by).count().groupBy("count").agg(F.count("*").alias("n"))
    w = Window.orderBy("count")
    run = sizes.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy()))
    at = lambda p: F.min(F.when(F.col("upto") > p, F.col("count")))
    return run.agg(F.max("total").alias("n_groups"), F.min("count").alias("least"), at(F.floor(F.col("total") / 2)).alias("p50"), at(F.floor(F.col("total") * 0.9)).alias("p90"), at(F.floor(F.col("total") * 0.99)).alias("p99"), F.max("count").alias("most"))


def first_seen_rounds(events: DataFrame, target: str, round_: str) -> DataFrame:
    """Targets seen up to each round, and how many are new in it; rounds without new targets included."""
    first = events.groupBy(target).agg(F.min(round_).alias(round_)).groupBy(round_).agg(F.count("*").alias("fresh"))
    rounds = events.select(round_).distinct().join(first, round_, "left").select(round_, F.coalesce("fresh", F.lit(0)).alias("n_new"))
    return rounds.withColumn("n_total", F.sum("n_new").over(Window.orderBy(round_)))


def saturated(rounds: DataFrame, round_: str, deltas: dict[str, str], threshold: float = 0.05, consecutive: int = 2, least: int = 3) -> DataFrame:
    """Whether every delta is under ``threshold`` of its total in the last rounds, of at least ``least``."""
    small = reduce(lambda a, b: a & b, [(F.col(d) / F.greatest(F.col(t), F.lit(1))) < threshold for d, t in deltas.items()])
    back = rounds.withColumn("small", small).withColumn("age", F.row_number().over(Window.orderBy(F.col(round_).desc())))
    return back.agg(F.count("*").alias("n_rounds"), F.coalesce(F.bool_and(F.when(F.col("age") <= consecutive, F.col("small"))), F.lit(False)).alias("quiet")).select("n_rounds", (F.col("quiet") & (F.col("n_rounds") >= least)).alias("saturated"))
