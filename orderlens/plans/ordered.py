"""Neighbours in a global order: the previous row's values, and runs of linked rows, without a window per group.

Rows are range-partitioned on the sort keys, sorted there, and each partition is read once in
order (Arrow batches), which takes values over from row to row.  What crosses a partition's edge is carried by a
table with one row per partition, broadcast: bounded by the partitions, not by the data.  One
exchange serves all; a group with a third of all rows lies over many partitions like any other rows.

The sorted partitions are written once with a reliable ``checkpoint()``, as in ``ranking``, so that edges and rows
come from the same partitions.  The keys must form a total order (a unique tie-breaker last).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from orderlens.session import checkpoint_dir, ship_package


def _shifted(cols: list[str], names: list[str]):
    """Adds to each row the place in its partition and the values of ``cols`` in the row before (null in the first)."""
    def shift(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        row, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = [batch.column(c) for c in cols]
            before = []
            for i, col in enumerate(held):
                first = pa.nulls(1, col.type) if last is None else last[i]
                before.append(pa.concat_arrays([first, col.slice(0, batch.num_rows - 1)]))
            last = [pc.take(col, pa.array([batch.num_rows - 1])) for col in held]
            place = pa.array(range(row, row + batch.num_rows), pa.int64())
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, place, *before], [*batch.schema.names, "_place", *names])
    return shift


def _carried(edges: DataFrame, value: str, keep_last: bool) -> DataFrame:
    """Per partition, the ``value`` of the partition before it (``keep_last``: the last one that isn't null)."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(edges.select("_part", F.last(value, ignorenulls=keep_last).over(before).alias("_edge")))


def with_previous(df: DataFrame, partition: list[str], order: list[Column], cols: list[str],
                  prefix: str = "prev_", num_partitions: int | None = None) -> DataFrame:
    """LAG of ``cols`` within ``partition`` groups, as ``prefix`` + name: NULL in a group's first row.

    Keys that are NULL form a group of their own.  Very large groups are split; an empty table gives no rows."""
    return _ordered(df, partition, order, cols, prefix, num_partitions).drop("_part", "_place")


def _ordered(df, partition, order, cols, prefix, num_partitions):
    spark = df.sparkSession
    checkpoint_dir(spark)
    ship_package(spark)
    n = int(num_partitions or spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(p).asc_nulls_first() for p in partition] + list(order)
    taken = list(dict.fromkeys([*partition, *cols]))
    names = [f"_before_{c}" for c in taken]
    schema = StructType([*df.schema.fields, StructField("_place", LongType()),
                         *[StructField(name, df.schema[c].dataType) for name, c in zip(names, taken)]])
    read = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(_shifted(taken, names), schema)
            .withColumn("_part", F.spark_partition_id()).checkpoint(eager=True))
    edges = read.groupBy("_part").agg(F.max_by(F.struct(*taken), F.col("_place")).alias("_last"))
    out = read.join(_carried(edges, "_last", keep_last=False), "_part", "left")
    first = F.col("_place") == 0
    value = {c: F.when(first, F.col("_edge").getField(c)).otherwise(F.col(name)) for name, c in zip(names, taken)}
    same = F.when(first, F.col("_edge").isNotNull()).otherwise(True)
    for p in partition:
        same = same & F.col(p).eqNullSafe(value[p])
    return out.select(*df.columns, *[F.when(same, value[c]).alias(prefix + c) for c in cols], "_part", "_place")


def _last_heads(name: str):
    """Carries the newest value of ``name`` (null: none here) along the rows of a partition."""
    def carry(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        last = None
        for batch in batches:
            col = batch.column(name)
            at = np.where(np.asarray(pc.is_valid(col)), np.arange(len(col)), -1)
            at = np.maximum.accumulate(at) if len(at) else at
            if last is not None:
                col, at = pa.concat_arrays([last, col]), at + 1
            found = pc.take(col, pa.array(at, pa.int64(), mask=at < 0))
            if batch.num_rows:
                last = found.slice(len(found) - 1)
            yield pa.RecordBatch.from_arrays([found if n == name else batch.column(n) for n in batch.schema.names], batch.schema.names)
    return carry


def with_runs(df: DataFrame, partition: list[str], order: list[Column], cols: list[str], linked: Column, id_col: str,
              run: str = "run", prefix: str = "prev_", num_partitions: int | None = None) -> DataFrame:
    """Islands: ``run`` is the ``id_col`` of the first row of each run of rows in which every row is ``linked`` to the one before it.

    ``linked`` is over the row and the ``prefix`` columns of the row before it in its group, NULL or false in a group's first row.
    A run that crosses partitions keeps its first row's id."""
    rows = _ordered(df, partition, order, list(dict.fromkeys([id_col, *cols])), prefix, num_partitions)
    rows = rows.withColumn(run, F.when(~F.coalesce(linked, F.lit(False)), F.col(id_col)))
    carried = rows.mapInArrow(_last_heads(run), rows.schema)
    edges = carried.groupBy("_part").agg(F.max_by(run, "_place").alias("_run"))
    return (carried.join(_carried(edges, "_run", keep_last=True), "_part", "left")
            .withColumn(run, F.coalesce(run, "_edge")).drop("_edge", "_part", "_place"))
