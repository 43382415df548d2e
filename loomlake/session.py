"""Session factory, table loader, shared scratch space and code shipping."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def build_session(app: str = "loomlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on: UTC, ANSI, last-wins maps, AQE."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_loomlake_shipped", False):
        return spark
    folder = Path(tempfile.mkdtemp(prefix="loomlake-"))
    target = folder / "loomlake_code.zip"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for path in sorted(PACKAGE.rglob("*.py")):
            archive.write(path, os.path.join(PACKAGE.name, path.relative_to(PACKAGE)))
    target.write_bytes(buffer.getvalue())
    context.addPyFile(str(target))
    context._loomlake_shipped = True
    return spark


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir, which the cluster shares.

    Only a session in one process, as in tests, may name none; it takes a local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loomlake-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write to the shared scratch space and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path, partitionBy=list(partition_by) or None)
    found = spark.read.schema(df.schema).parquet(path)
    found._loomlake_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that materialize() has written and nothing reads any more."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._loomlake_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
