"""The test tables in the shape of the domain's facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Environments of the documents proxy (languages) and of the events proxy.
LANGS = ["en", "fr", "de", "es"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, env, paper): ASCII words of documents, their language, their id."""
    docs = load(spark, sf_dir, "documents")
    return docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))).alias("key"), F.col("lang").alias("env"), F.col("doc_id").alias("paper"))


def event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, env, paper, ord): event type, k mod 4, user."""
    k = F.get_json_object("props", "$.k").cast("int")
    return load(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.concat(F.lit("e"), (k % 4).cast("string")).alias("env"), F.col("user_id").alias("paper"), F.col("event_id").alias("ord"))


#: SQL of the same facts.
OCCURRENCES = "occ AS (SELECT key, lang AS env, doc_id AS paper FROM (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS key FROM documents))"
EVENT_FACTS = "facts AS (SELECT event_type AS key, 'e' || (CAST(json_extract_string(props, '$.k') AS INT) % 4) AS env, user_id AS paper, event_id AS ord FROM events)"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field names: part name, brand, type and size put together in the ways that names come."""
    return load(spark, sf_dir, "part").select(
        "p_partkey", F.concat_ws("", F.lit(" "), F.initcap("p_name"), F.lit("-"), F.lower("p_type"), F.lit(" ("), F.col("p_size"), F.lit(" mm)/"), F.col("p_brand"), F.lit(" ")).alias("raw"),
    )


PARTS = "parts AS (SELECT p_partkey, ' ' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || '-' || lower(p_type) || ' (' || p_size || ' mm)/' || p_brand || ' ' AS raw FROM part)"
