"""Sets of tables published as one version.

A version's tables are written into a folder of their own; the row that names the folder is
appended last.  Readers take the tables of the newest named folder, so a run that fails between two
tables leaves the version before whole, and no reader sees half of one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(spark: SparkSession, path: str, version: int | None = None):
    """(version, folder) of the newest published version, or of ``version``; None where there is none."""
    named = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    if not named.getFileSystem(spark._jsc.hadoopConfiguration()).exists(named):
        return None
    rows = spark.read.parquet(f"{path}/versions")
    rows = rows if version is None else rows.where(F.col("version") == version)
    return rows.agg(F.max(F.struct("version", "folder")).alias("v")).first().v


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame | Callable]) -> int:
    """Write ``tables`` as the next version and name it when all are written; returns its number (from 1).

    They are written in order; one given as a function gets a reader of the tables written before it (name ->
    DataFrame), so that what depends on a table of the same version starts from its files."""
    before = latest(spark, path)
    version = 1 if before is None else before.version + 1
    folder = f"{path}/v{version}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df = df(lambda written: spark.read.parquet(f"{folder}/{written}")) if callable(df) else df
        df.write.parquet(f"{folder}/{name}")
    spark.createDataFrame([(version, folder)], "version int, folder string").coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return version


def read_published(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame:
    """Table ``name`` of the newest version (or of ``version``)."""
    found = latest(spark, path, version)
    if found is None:
        raise ValueError(f"no published version under {path}")
    return spark.read.parquet(f"{found.folder}/{name}")
