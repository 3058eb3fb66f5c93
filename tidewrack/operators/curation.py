"""Decision tables applied to state, and reconciliation of model output with its input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.operators.ranking import ranked

#: Actions of mapping decisions, strongest first.
ACTIONS = ["EXCLUDE", "FORCE_UNMAPPED", "FORCE_SLOT"]


def review_decisions(mapped: DataFrame, decisions: DataFrame, field: str = "field") -> DataFrame:
    """One decision for each field (strongest action, then first); EXCLUDE drops the field, FORCE_UNMAPPED and FORCE_SLOT
    set its slot, but nothing that is UNMAPPED is promoted."""
    rank = F.coalesce(*[F.when(F.col("action") == a, F.lit(i)) for i, a in enumerate(ACTIONS)], F.lit(99))
    one = decisions.groupBy(field).agg(F.min_by(F.struct("action", "target_slot"), F.struct(rank, F.col("ord"))).alias("d"))
    out = mapped.join(one, field, "left").filter(~F.col("d.action").eqNullSafe(F.lit("EXCLUDE")))
    slot = F.when(F.col("d.action") == "FORCE_UNMAPPED", "UNMAPPED").when((F.col("d.action") == "FORCE_SLOT") & (F.col("slot") != "UNMAPPED"), F.col("d.target_slot")).otherwise(F.col("slot"))
    return out.withColumn("slot", slot).drop("d")


def prune_decision(tries: Column, successes: Column, least: int = 5, floor: float = 0.1) -> Column:
    """M16."""
    return F.when(tries < least, "kept_observe").when(successes / tries < floor, "pruned").otherwise("kept")


def reconciled(groups: DataFrame, members: DataFrame, family: str = "family", member: str = "member") -> DataFrame:
    """Groups of a partition made to fit its input: unknown members go, of repeated ones the first stays, missing ones
    become groups of their own (a null group number)."""
    real = groups.join(members.select(family, member).distinct(), [family, member], "left_semi")
    first = ranked(real, [family, member], [F.col("grp"), F.col("pos")]).filter("rn = 1").select(family, member, "grp")
    missing = members.select(family, member).distinct().join(first, [family, member], "left_anti").select(family, member, F.lit(None).cast("bigint").alias("grp"))
    return first.unionByName(missing)


def canonical_edits(synonyms: DataFrame, decisions: list[dict]) -> DataFrame:
    """Ordered edits of (canonical, alias): REMOVE_ALIAS, SPLIT, MERGE, RENAME; each sees the ones before. The list is a
    curator's, so it is a loop on the driver; the table is not."""
    out = synonyms
    for d in decisions:
        name, action = d["canonical"], d["action"]
        here = F.col("canonical") == name
        if action == "REMOVE_ALIAS":
            out = out.filter(~(here & (F.col("alias") == d["alias"])))
        elif action == "SPLIT":
            target = F.coalesce(*[F.when(F.col("alias").isin(*g["members"]), F.lit(g["canonical"])) for g in d["split_groups"]], F.col("canonical"))
            out = out.withColumn("canonical", F.when(here, target).otherwise(F.col("canonical")))
        elif action == "MERGE":
            out = out.withColumn("canonical", F.when(F.col("canonical") == d["merge_with"], F.lit(name)).otherwise(F.col("canonical")))
        elif action == "RENAME":
            out = out.withColumn("canonical", F.when(here, F.lit(d["new_name"])).otherwise(F.col("canonical")))
        else:
            raise ValueError(f"unknown action {action}")
    return out


def expanded(rows: DataFrame, expansion: DataFrame, key: str) -> DataFrame:
    """Keys replaced by their expansion, in any case; the original is kept, so doing it again changes nothing."""
    table = expansion.groupBy(F.lower("raw_key").alias("__k")).agg(F.min_by("normalized", "ord").alias("__n"))
    original = F.coalesce(F.col("raw_key_original"), F.col(key)) if "raw_key_original" in rows.columns else F.col(key)
    out = rows.withColumn("raw_key_original", original).withColumn("__k", F.lower("raw_key_original"))
    return out.join(table, "__k", "left").withColumn(key, F.coalesce("__n", "raw_key_original")).drop("__k", "__n")
