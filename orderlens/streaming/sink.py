"""Writing a stream by micro-batch: one folder per epoch, replaced when an epoch is replayed."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_epochs(stream: DataFrame, out_path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame],
                 available_now: bool = True):
    """Start ``stream``; each micro-batch goes through ``prepare`` and to ``out_path/epoch=<id>``.

    A replayed epoch overwrites its own folder, so the table holds each batch once.  Tables
    read back from it must not depend on where the batches were cut; the readers here
    resolve repeats, order and sums over all epochs.
    """
    def handle(batch: DataFrame, epoch_id: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{out_path}/epoch={epoch_id}")

    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def compact_epochs(spark: SparkSession, out_path: str, merge: Callable[[DataFrame], DataFrame], upto: int) -> None:
    """Merge the epochs up to ``upto``, and what was compacted before, into one table and publish it.

    ``merge`` must give the same rows whether it sees all epochs or a merge of the first ones and the rest (the
    newest row per key, sums).  The table is written first, the row that names it last, so a failure between
    leaves the version before; epochs that are replayed after they were compacted change nothing.
    """
    upto_before, base, open_epochs = _versions(spark, out_path)
    if upto <= upto_before:
        return
    rows = open_epochs.where(F.col("epoch") <= upto).drop("epoch")
    path = f"{out_path}-compacted/{uuid.uuid4().hex}"
    merge(rows if base is None else base.unionByName(rows)).write.parquet(path)
    spark.createDataFrame([(upto, path)], "upto long, path string").coalesce(1).write.mode("append").parquet(f"{out_path}-versions")


def read_compacted(spark: SparkSession, out_path: str, merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The merge of the compacted table and the epochs after it; folders of compacted epochs are not read."""
    _, base, open_epochs = _versions(spark, out_path)
    rows = open_epochs.drop("epoch")
    return merge(rows if base is None else base.unionByName(rows))


def _versions(spark: SparkSession, out_path: str) -> tuple[int, DataFrame | None, DataFrame]:
    """The newest compacted epoch and table, and the epochs after it."""
    upto, base = -1, None
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{out_path}-versions")
    if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        newest = spark.read.parquet(f"{out_path}-versions").agg(F.max(F.struct("upto", "path")).alias("v")).first().v
        upto, base = newest.upto, spark.read.parquet(newest.path)
    return upto, base, spark.read.parquet(out_path).where(F.col("epoch") > upto)
