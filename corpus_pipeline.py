"""The corpus pipeline: five stages from ``documents`` to token ids.

Every stage takes tables with nulls in any column, empty and very long texts, repeated rows, no rows, and further columns
of any names, which it passes on. Each stage takes (spark, docs, sf_dir) and returns the rows that the next one works on; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.llm.bpe import Tokenizer
from tidewrack.llm.common import materialize, small_batches, table
from tidewrack.llm.decontamination import drop_contaminated
from tidewrack.llm.jaccard_join import drop_similar
from tidewrack.llm.queries import vocabulary_path
from tidewrack.llm.secret_scan import redact
from tidewrack.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. The classifier is trained on the labelled rows of ``docs``.

    Null and empty texts are scored as texts without n-grams; without labels of both kinds every score is the share of
    toxic labels, and nothing goes below a half.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 connect stays: the one of the least id.

    Texts without words, null ones too, stay; of rows equal in id and text one stays.
    """
    return drop_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates (a twentieth of their words or more) go; texts without words stay."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; n_chars, where there is one, follows and is null for null texts."""
    masked = redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns) if "n_chars" in docs.columns else masked


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns but the text, token ids of every text, and whether they decode to the text again.

    Null counts as the empty text; columns named ids, n_tokens and round_trip give way.
    """
    small_batches(spark)
    coder = Tokenizer(spark, vocabulary_path())
    made = ("text", "ids", "n_tokens", "round_trip")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (*made, "n_chars")]
    text = F.coalesce(F.col("text"), F.lit(""))
    coded = docs.select(*kept, text.alias("text"), coder.encode(text).alias("ids"))
    return coded.select(*kept, "ids", F.size("ids").cast("bigint").alias("n_tokens"), (coder.decode(F.col("ids")) == F.col("text")).alias("round_trip"))


STAGES = [("toxicity", toxicity), ("near duplicates", near_duplicates), ("decontamination", decontaminate), ("secrets", secrets), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express neither the classifier nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None
