"""The catalogue of outcomes: loading, validation and derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "frameworkVersion string, sample boolean, functions array<struct<id:string,name:string>>, subcategories array<struct<function:string,category:string,id:string,outcome:string>>"


class CatalogueError(ValueError):
    """A catalogue that is missing, malformed, incomplete, or has an identifier twice."""


def derive_ids(outcomes: DataFrame, id_col: str = "id") -> DataFrame:
    """Adds function_id, the text before the first dot, and category_id, the text before the first hyphen."""
    return outcomes.withColumn("function_id", F.substring_index(id_col, ".", 1)).withColumn("category_id", F.substring_index(id_col, "-", 1))


def with_names(outcomes: DataFrame, functions: DataFrame) -> DataFrame:
    """Adds function_name by function_id; an unknown one is its own name. Functions are a handful of rows."""
    names = functions.groupBy(F.col("id").alias("function_id")).agg(F.first("name").alias("__name"))
    return outcomes.join(names, "function_id", "left").withColumn("function_name", F.coalesce("__name", "function_id")).drop("__name")


def duplicates(outcomes: DataFrame, id_col: str = "id") -> DataFrame:
    return outcomes.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1")


def load(spark: SparkSession, path: str) -> DataFrame:
    """(id, function_id, category_id, function_name, category, outcome) of a catalogue file."""
    try:
        doc = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
        whole = doc.limit(1).collect()
    except Exception as error:
        raise CatalogueError(f"{path}: {error}") from error
    if not whole or not whole[0].subcategories or not whole[0].functions:
        raise CatalogueError(f"{path}: no functions or no subcategories")
    rows = doc.select(F.inline("subcategories"))
    if rows.where("id is null or id = '' or outcome is null or outcome = ''").count():
        raise CatalogueError(f"{path}: a subcategory without id or outcome")
    if twice := [r.id for r in duplicates(rows).orderBy("id").limit(10).collect()]:
        raise CatalogueError(f"{path}: duplicate id {', '.join(twice)}")
    names = doc.select(F.inline("functions"))
    return with_names(derive_ids(rows), names).select("id", "function_id", "category_id", "function_name", "category", "outcome")
