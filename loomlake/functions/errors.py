"""Error codes, their messages and the general condition each belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values.
CODES = [
    (0, "success", "success", None),
    (1, "invalid_argument", "invalid argument", "invalid_argument"),
    (2, "out_of_range", "value out of range", "result_out_of_range"),
    (3, "malformed_data", "malformed data", "invalid_argument"),
    (4, "unavailable", "service unavailable", "resource_unavailable_try_again"),
]


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CODES, "code int, name string, message string, condition string")


def described(rows: DataFrame, code: Column) -> DataFrame:
    """Adds name, message and condition; an unknown code has a message that says so."""
    found = catalog(rows.sparkSession).withColumnRenamed("code", "_code")
    joined = rows.join(F.broadcast(found), code == F.col("_code"), "left").drop("_code")  # five rows
    return joined.withColumn("message", F.coalesce("message", F.lit("unknown error")))


def first_error(checks: list[tuple[Column, str]]) -> Column:
    """The code of the first check that holds, in this order, or null."""
    return F.coalesce(*(F.when(failed, F.lit(code)) for failed, code in checks))


def health(flag: Column, kind: str) -> Column:
    """status and JSON body for a liveness or readiness flag."""
    from .text import json_object

    failed = {"live": ("broker_not_live", "broker shutdown is in progress"), "ready": ("broker_not_ready", "broker is not ready")}[kind]
    good = F.struct(F.lit(200).alias("status"), json_object({"status": F.lit(kind)}).alias("body"))
    bad = F.struct(F.lit(503).alias("status"), envelope(F.lit(failed[0]), F.lit(failed[1]), F.lit(None).cast("string")).alias("body"))
    return F.when(flag, good).otherwise(bad)


def envelope(code: Column, message: Column, correlation_id: Column) -> Column:
    """The error JSON; a missing correlation id is written as null."""
    from .text import json_object

    return json_object({"code": code, "message": message, "correlation_id": correlation_id})
