"""Joins: fallbacks, priorities, fuzzy matches, set operations on keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack import constants as K
from tidewrack.functions import text as T
from tidewrack.operators.ranking import top


def fallback_join(left: DataFrame, right: DataFrame, first: str, second: str, key: str, value: str) -> DataFrame:
    """Value by the first key, else by the second; ``right`` holds one row of each key."""
    a = right.select(F.col(key).alias(first), F.col(value).alias("__a"))
    b = right.select(F.col(key).alias(second), F.col(value).alias("__b"))
    return left.join(a, first, "left").join(b, second, "left").withColumn(value, F.coalesce("__a", "__b")).drop("__a", "__b")


def alias_index(names: DataFrame, alias: str, target: str, ordinal: str) -> DataFrame:
    """J14, SRC8, R12: one target of each alias: a target's own name before foreign aliases, then the first; collisions."""
    own = (F.lower(F.col(alias)) == F.lower(F.col(target))).cast("int")
    return names.groupBy(F.lower(alias).alias("alias")).agg(F.min_by(target, F.struct(-own, F.col(ordinal))).alias("target"), F.countDistinct(target).alias("n_targets"))


def overlap_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tokens: str, least: float, smaller: bool = True, last: Column | None = None) -> DataFrame:
    """Best match of each left row by shared tokens over the size of the smaller (or larger) token set.

    An equi-join on tokens: pairs without a shared token never meet. Equal token sets meet once, however many rows have
    them; the best row of a right set stands for it. Ties: rows with ``last`` come last, then by id.
    """
    rows = lambda df: df.withColumn("__set", F.array_sort(F.array_distinct(tokens)))
    own, other = rows(left.select(left_id, tokens)), rows(right.select(right_id, tokens, (last if last is not None else F.lit(0)).alias("__last")))
    best = other.groupBy("__set").agg(F.min(F.struct("__last", right_id)).alias("best"))
    a = own.select("__set").distinct().select(F.col("__set").alias("sa"), F.size("__set").alias("na"), F.explode("__set").alias("token"))
    b = best.select(F.col("__set").alias("sb"), "best", F.size("__set").alias("nb"), F.explode("__set").alias("token"))
    n = F.least("na", "nb") if smaller else F.greatest("na", "nb")
    scored = a.join(b, "token").groupBy("sa", "sb", "best", "na", "nb").agg(F.count("*").alias("shared")).withColumn("score", F.col("shared") / n)
    found = top(scored.filter(F.col("score") >= least), ["sa"], [F.col("score").desc(), F.col("best")], 1)
    return own.join(found.select(F.col("sa").alias("__set"), F.col(f"best.{right_id}").alias(right_id), "score"), "__set").select(left_id, right_id, "score")


#: Names of one block of a bucket.
BLOCK = 256


def similar_pairs(names: DataFrame, bucket: str, name: str) -> DataFrame:
    """Pairs of different names of one bucket that are similar (see ``functions.text.similar``).

    Names of equal comparable forms are pairs without a comparison; different forms are compared once, whatever names have
    them. The forms of a bucket are dealt over blocks, each of which meets all forms of the bucket in a task of its own.
    """
    made = names.select(bucket, F.col(name).alias("__n"), T.comparable(F.col(name)).alias("__x"))
    forms = made.select(bucket, "__x").distinct().withColumn("__t", T.name_tokens(F.col("__x")))
    parts = forms.groupBy(bucket).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("__parts"))
    sized = forms.join(parts, bucket)
    a = sized.select(bucket, F.pmod(F.xxhash64("__x"), F.col("__parts")).cast("int").alias("__block"), F.col("__x").alias("xa"), F.col("__t").alias("ta"))
    b = sized.select(bucket, F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__block"), F.col("__x").alias("xb"), F.col("__t").alias("tb"))
    near = a.join(b, [bucket, "__block"]).filter((F.col("xa") < F.col("xb")) & T.similar_forms(F.col("xa"), F.col("xb"), F.col("ta"), F.col("tb"))).select(bucket, "xa", "xb")
    same = forms.select(bucket, F.col("__x").alias("xa"), F.col("__x").alias("xb"))
    left, right = (made.select(bucket, F.col("__x").alias(x), F.col("__n").alias(n)) for x, n in (("xa", "p"), ("xb", "q")))
    pairs = near.union(same).join(left, [bucket, "xa"]).join(right, [bucket, "xb"]).filter("xa < xb OR p < q")
    return pairs.select(bucket, F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def overlaps(old: DataFrame, new: DataFrame, group: str, member: str) -> DataFrame:
    """New, old, exact: groups that share a member, and whether their members are equal. Null is no member.

    Groups meet by distinct members, with sizes beside them: equal sets share all members of both.
    """
    sized = lambda x, g: x.filter(F.col(member).isNotNull()).select(F.col(group).alias(g), member).distinct()
    o, n = sized(old, "old"), sized(new, "new")
    so, sn = o.groupBy("old").agg(F.count("*").alias("so")), n.groupBy("new").agg(F.count("*").alias("sn"))
    met = n.join(o, member).groupBy("new", "old").agg(F.count("*").alias("shared")).join(so, "old").join(sn, "new")
    return met.select("new", "old", ((F.col("shared") == F.col("so")) & (F.col("shared") == F.col("sn"))).alias("exact"))


def set_overlap(old: DataFrame, new: DataFrame, group: str, member: str) -> DataFrame:
    """Each new group's relation to the old ones by their members: exact, partial or new."""
    kind = F.when(F.max("exact"), "exact").otherwise("partial")
    met = overlaps(old, new, group, member).groupBy("new").agg(kind.alias("kind"), F.count("*").alias("n_old"))
    return new.select(F.col(group).alias("new")).distinct().join(met, "new", "left").select("new", F.coalesce("kind", F.lit("new")).alias("kind"), F.coalesce("n_old", F.lit(0)).alias("n_old"))


def cde_lookup(rows: DataFrame, cde: DataFrame, env: str, key: str) -> DataFrame:
    """Normaliser by (environment, key), else by the key in the first environment that has it, else passthrough."""
    exact = cde.select(F.col("env").alias(env), F.col("key").alias(key), F.col("normalizer").alias("__a"))
    anywhere = cde.groupBy(F.col("key").alias(key)).agg(F.min_by("normalizer", "ord").alias("__b"))
    return rows.join(exact, [env, key], "left").join(anywhere, key, "left").withColumn("normalizer", F.coalesce("__a", "__b", F.lit("passthrough"))).drop("__a", "__b")


def accessions_in(texts: DataFrame, id_: str, text: str) -> DataFrame:
    """Distinct accessions of each text with their level."""
    found = texts.select(id_, F.explode(F.array_distinct(T.accessions(F.col(text)))).alias("accession"))
    return found.withColumn("level", T.accession_level(F.col("accession")))


def targets_or_all(pairs: DataFrame, sections: DataFrame, hits: DataFrame, section: str, target: str) -> DataFrame:
    """targets that a section's keys hit; all of them where none is hit."""
    some = hits.select(section, target).distinct()
    without = sections.join(some.select(section).distinct(), section, "left_anti")
    return some.unionByName(without.join(pairs.select(target).distinct()).select(section, target))


def dead_letters(items: DataFrame, done: DataFrame, key: str, text: str, section: str, excluded: list[str], least: int = 200) -> DataFrame:
    """F6, SNK5: items that are not done yet, with the reason for which they are left out (null: they are kept)."""
    todo = items.join(done.select(key).distinct(), key, "left_anti")
    reason = F.when(F.upper(F.trim(section)).isin(*excluded), "excluded section").when(F.length(F.trim(text)) < least, "short text").when(F.col(text).isNull(), "no text")
    return todo.withColumn("reason", reason)


def fuzzy_overlap(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tokens: str, project: Column) -> DataFrame:
    return overlap_join(left, right, left_id, right_id, tokens, K.LABEL_OVERLAP, last=project)
