"""Tab-separated tables inside texts: tests, header and cells, relations of each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack import constants as K
from tidewrack.functions import text as T

#: Cells that say nothing.
EMPTY_CELLS = ["na", "none", "-", "nd", "n/a", ""]
#: Words of column names that mark labels.
LABEL_WORDS = ["sample", "label", "station", "site"]


def lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")


def tabbed(text: Column) -> Column:
    return F.filter(lines(text), lambda x: F.contains(x, F.lit("\t")))


def is_table(text: Column, tabs: int = 5, rows: int = 3) -> Column:
    """TP1."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\t"), F.lit(""))) >= tabs) & (F.size(tabbed(text)) >= rows)


def columns(text: Column) -> Column:
    """TP2: most cells of the first five tabbed lines."""
    return F.array_max(F.transform(F.slice(tabbed(text), 1, 5), lambda x: F.size(F.split(x, "\t"))))


def role(name: Column, targets: Column) -> Column:
    """Role of a column by its name."""
    n = T.column_name(name)
    return F.when(F.contains(n, F.lit("accession")) | n.isin("run", "biosample", "bioproject"), "accession").when(F.array_contains(targets, n), "field").when(F.lower(name).rlike("|".join(LABEL_WORDS)), "label").otherwise("other")


def cells(sections: DataFrame, id_: str, text: str, targets: Column) -> DataFrame:
    """TP4, TP7: one row for each cell below the header: row_no, name, role, value; empty cells are left out."""
    rows = sections.filter(is_table(F.col(text))).select(id_, tabbed(F.col(text)).alias("rows"))
    split = rows.select(id_, F.split(F.element_at("rows", 1), "\t").alias("head"), F.posexplode(F.slice("rows", 2, 1_000_000_000)).alias("row_no", "line"))
    cell = split.select(id_, "row_no", F.explode(F.arrays_zip("head", F.split("line", "\t").alias("value"))).alias("x")).select(id_, "row_no", F.trim("x.head").alias("name"), F.trim("x.value").alias("value"))
    return cell.filter(F.col("name").isNotNull() & F.col("value").isNotNull() & ~F.lower("value").isin(*EMPTY_CELLS)).withColumn("role", role(F.col("name"), targets))


def relations(cell_rows: DataFrame, id_: str) -> DataFrame:
    """TP4: accession, label and field values of each table row."""
    first = lambda r: F.min(F.when(F.col("role") == r, F.col("value")))
    keyed = cell_rows.groupBy(id_, "row_no").agg(F.min(F.when(F.col("role") == "accession", F.regexp_extract("value", K.ACCESSION, 1))).alias("accession"), first("label").alias("label"))
    return cell_rows.filter("role = 'field'").select(id_, "row_no", F.col("name").alias("field"), "value").join(keyed, [id_, "row_no"])


def transposed_cells(sections: DataFrame, id_: str, text: str, targets: Column) -> DataFrame:
    """TP5: the same cells where fields are lines and records are columns."""
    rows = sections.filter(is_table(F.col(text))).select(id_, F.explode(tabbed(F.col(text))).alias("line")).select(id_, F.split("line", "\t").alias("p"))
    cell = rows.select(id_, F.trim(F.col("p")[0]).alias("name"), F.posexplode(F.slice("p", 2, 1_000_000_000)).alias("row_no", "value")).withColumn("value", F.trim("value"))
    return cell.filter(~F.lower("value").isin(*EMPTY_CELLS)).withColumn("role", role(F.col("name"), targets)).select(id_, "row_no", "name", "value", "role")


def best_relations(sections: DataFrame, id_: str, text: str, targets: Column) -> DataFrame:
    """TP3, TP6: relations of each section by the reading that gives more; the upright one on ties."""
    upright = relations(cells(sections, id_, text, targets), id_).withColumn("turned", F.lit(0))
    turned = relations(transposed_cells(sections, id_, text, targets), id_).withColumn("turned", F.lit(1))
    both = upright.unionByName(turned)
    counts = both.groupBy(id_, "turned").agg(F.count_if(F.col("accession").isNotNull() | F.col("label").isNotNull()).alias("n"))
    best = counts.groupBy(id_).agg(F.min_by("turned", F.struct(-F.col("n"), F.col("turned"))).alias("turned"))
    return both.join(best, [id_, "turned"], "left_semi")
