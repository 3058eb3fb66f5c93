"""JSON, JSON lines, delimited and plain text sources, and sinks. Paths are any that Spark can read; schemas are declared.

Readers that must keep the order of lines number them (``ord``) by the name of the file, the start of the block that a
task reads, and the position in it: the order of ``ord`` is that of the lines, however Spark packs files into tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewrack.operators.ranking import last_wins


def _numbered(df: DataFrame) -> DataFrame:
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return df.withColumn("ord", at)


def json_array(spark: SparkSession, path: str, schema) -> DataFrame:
    """SRC1: files that each hold an array of objects."""
    return _numbered(spark.read.schema(schema).option("multiLine", True).json(path))


def ragged_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC2: an object, an array, or arrays in an array (flattened once); anything but objects is dropped."""
    value = F.parse_json("value")
    kind = F.schema_of_variant("v")
    rows = spark.read.text(path, wholetext=True).select(value.alias("v"))
    one = F.when(F.startswith(kind, F.lit("ARRAY")), F.variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
    flat = rows.select(F.explode(one).alias("v"))
    flat = flat.select(F.explode(one).alias("v")).filter(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")))
    return flat.select(F.from_json(F.to_json("v"), schema).alias("x")).select("x.*")


def json_lines(spark: SparkSession, path: str, schema: T.StructType, keys: list[str] | None = None) -> DataFrame:
    """SRC18, X15, X16: JSON lines, broken ones left out; with ``keys``, the last record of each."""
    marked = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    read = spark.read.schema(marked).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    good = _numbered(read).filter(F.col("_corrupt").isNull()).drop("_corrupt")
    return last_wins(good, keys, "ord") if keys else good


def pairs(spark: SparkSession, path: str, separator: str = r"\s+", least: int = 2, exact: bool = False, as_int: bool = False) -> DataFrame:
    """SRC3: id and year on each line; short lines are skipped (with ``exact``, longer ones too), of repeated ids the last
    holds; with ``as_int``, years that are no numbers are skipped."""
    rows = _numbered(spark.read.text(path)).select("ord", F.split(F.trim("value"), separator).alias("p"))
    rows = rows.filter(F.size("p") == least if exact else F.size("p") >= least).select("ord", F.col("p")[0].alias("id"), F.col("p")[1].alias("year"))
    if as_int:
        rows = rows.withColumn("year", F.col("year").try_cast("int")).filter(F.col("year").isNotNull())
    return last_wins(rows, ["id"], "ord").select("id", "year")


#: Columns of an accession list.
ACCESSION_COLUMNS = ["run", "bioproject", "biosample", "sra_study_old", "sra_study", "sra_sample", "sra_experiment", "pmid"]


def accession_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: tab-separated lines of eight columns or more, trimmed."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("p")).filter(F.size("p") >= len(ACCESSION_COLUMNS))
    return rows.select(*[F.trim(F.col("p")[i]).alias(c) for i, c in enumerate(ACCESSION_COLUMNS)])


def accession_papers(accessions: DataFrame) -> DataFrame:
    """SRC5: paper and accession, from lists of papers joined by semicolons."""
    return accessions.select(F.explode(F.split("pmid", ";")).alias("pmid"), "run", "biosample").withColumn("pmid", F.trim("pmid")).filter("pmid <> ''").distinct()


def whitelist(spark: SparkSession, path: str) -> DataFrame:
    """SRC6: lower-cased terms, and the singular of those that end in s."""
    t = spark.read.text(path).select(F.lower(F.trim("value")).alias("term")).filter("term <> ''")
    return t.union(t.filter(F.endswith("term", F.lit("s"))).select(F.left("term", F.length("term") - 1))).distinct()


def delimited(spark: SparkSession, path: str, schema, separator: str = ",", comments: bool = False) -> DataFrame:
    """SRC14, SRC15: delimited text with a header; null and empty text stay apart only if quoted."""
    reader = spark.read.schema(schema).option("header", True).option("sep", separator).option("enforceSchema", False)
    return _numbered((reader.option("comment", "#") if comments else reader).csv(path))


def synonyms(groups: DataFrame) -> DataFrame:
    """SRC8: canonical of each alias (rows: canonical, aliases): a canonical's own name first, else the first group."""
    named = groups.select("ord", "canonical", F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    own = (F.col("alias") == F.col("canonical")).cast("int")
    return named.groupBy("alias").agg(F.min_by("canonical", F.struct(-own, F.col("ord"))).alias("canonical"))


def write_json(df: DataFrame, path: str) -> None:
    """SNK1."""
    df.write.mode("overwrite").json(path)


def write_index(df: DataFrame, path: str, by: str, value: str) -> None:
    """SNK3: sorted inverted index, one object for each key."""
    df.groupBy(by).agg(F.array_sort(F.collect_set(value)).alias(value)).repartitionByRange(by).sortWithinPartitions(by).write.mode("overwrite").json(path)


def append_lines(df: DataFrame, path: str) -> None:
    """SNK4."""
    df.write.mode("append").json(path)


def split_by_reason(df: DataFrame, kept: str, dropped: str, reason: str = "reason") -> None:
    """SNK5: rows without a reason, and rows with one."""
    df.filter(F.col(reason).isNull()).drop(reason).write.mode("overwrite").parquet(kept)
    df.filter(F.col(reason).isNotNull()).write.mode("overwrite").parquet(dropped)


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """SNK12: a folder for each value."""
    df.write.mode("overwrite").partitionBy(by).option("header", True).csv(path)


def nested(rows: DataFrame, by: str, fields: list[str], name: str) -> DataFrame:
    """SNK9, SNK14: one row for each group with its fields as an ordered array of structs."""
    return rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
