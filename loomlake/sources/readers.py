"""Files as DataFrames: whole texts, XML rules, JSON actions, key-value lines; and writers of what queries give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def whole_texts(spark: SparkSession, *paths: str) -> DataFrame:
    """path, text of each file."""
    found = spark.read.text(list(paths), wholetext=True)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def rules(spark: SparkSession, path: str) -> DataFrame:
    """class, name, inputs (array of names) of the rule elements of an XML file."""
    schema = "_class string, _name string, `rule-input` array<struct<_name:string>>"
    found = spark.read.format("xml").option("rowTag", "rule").schema(schema).load(path)
    inputs = F.transform(F.coalesce("rule-input", F.array().cast("array<struct<_name:string>>")), lambda x: x["_name"])
    return found.select(F.col("_class").alias("class"), F.col("_name").alias("name"), inputs.alias("inputs"))


def actions(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, arguments of the actions of a JSON file."""
    found = spark.read.schema("actions array<struct<arguments:array<string>>>").json(path, multiLine=True)
    return found.select(F.posexplode("actions").alias("ordinal", "_a")).select("ordinal", F.coalesce("_a.arguments", F.array()).alias("arguments"))


def key_values(spark: SparkSession, *paths: str) -> DataFrame:
    """key, value of KEY VALUE lines; of equal keys the last file's, and in it the last line's, wins.

    A line without a space raises; blank lines are left out.
    """
    out = None
    for ordinal, path in enumerate(paths):
        text = whole_texts(spark, path).select(F.posexplode(F.split("text", "\r?\n")).alias("line", "value"))
        own = text.where(F.trim("value") != "").select(F.lit(ordinal).alias("file"), "line", "value")
        out = own if out is None else out.unionAll(own)
    at = F.locate(" ", F.col("value"))
    split = out.select("file", "line", F.when(at > 0, F.substr("value", F.lit(1), at - 1)).otherwise(F.raise_error(F.lit("expected KEY VALUE"))).alias("key"), F.substr("value", at + 1).alias("value"))
    return split.groupBy("key").agg(F.max_by("value", F.struct("file", "line")).alias("value"))


def write_lines(rows: DataFrame, column: str, path: str) -> None:
    rows.select(column).write.text(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path, ignoreNullFields=False)
