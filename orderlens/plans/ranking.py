"""Global row numbers and NTILE without a single-partition window.

``Window.orderBy(...)`` with no partition moves every row into one task.  Here
the rows are range-partitioned on the sort keys (the sampled bounds split a
hot key too, because the keys end in a unique tie-breaker), sorted inside each
partition, numbered locally with ``monotonically_increasing_id``, and shifted
by the row counts of the earlier partitions.  The per-partition count table
has one row per partition, so broadcasting it is bounded by the partition
count, not by the data.

The range-partitioned, locally numbered rows are written once with a
reliable ``checkpoint()`` (into the session's checkpoint folder) before the
per-partition counts are taken.  Counts and numbers therefore come from the
same partitions: a second evaluation of the range exchange could sample
different bounds when its input order comes from an upstream shuffle.  The
checkpoint also cuts the lineage, so a lost executor re-reads the written
partitions instead of renumbering.  The keys must form a total order (a
unique tie-breaker last).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.plans.ordered import with_previous  # noqa: F401  (distributed LAG, kept under this name)
from orderlens.session import checkpoint_dir

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row index in the low 33 bits


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return int(num_partitions)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_global_row_number(df: DataFrame, order: list[Column], name: str = "rn",
                           num_partitions: int | None = None, total_name: str | None = None) -> DataFrame:
    """Add ``name`` = 1-based position of each row in ``order`` (must be a total order).

    Equal to ``row_number().over(Window.orderBy(*order))``.  When ``total_name``
    is given, the total row count is added too.
    """
    n = _partitions(df, num_partitions)
    checkpoint_dir(df.sparkSession)
    ranged = (df.repartitionByRange(n, *order)
              .sortWithinPartitions(*order)
              .withColumn("_x1_pid", F.spark_partition_id())
              .withColumn("_x1_local", F.monotonically_increasing_id()
                          .bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
              .checkpoint(eager=True))
    counts = ranged.groupBy("_x1_pid").agg(F.count(F.lit(1)).alias("_x1_cnt"))
    before = Window.orderBy("_x1_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_x1_pid",
        F.coalesce(F.sum("_x1_cnt").over(before), F.lit(0)).alias("_x1_off"),
        F.sum("_x1_cnt").over(Window.partitionBy()).alias("_x1_total"),
    )
    out = (ranged.join(F.broadcast(offsets), "_x1_pid")
           .withColumn(name, F.col("_x1_off") + F.col("_x1_local") + 1))
    if total_name:
        out = out.withColumn(total_name, F.col("_x1_total"))
    return out.drop("_x1_pid", "_x1_local", "_x1_off", "_x1_total")


def ntile_from_rank(rn: Column, total: Column, k: int) -> Column:
    """NTILE(k) of a 1-based row number among ``total`` rows.

    Like SQL NTILE: the first ``total mod k`` tiles hold one row more.  With
    fewer rows than tiles each row is its own tile (no division by zero).
    """
    base = F.call_function("div", total, F.lit(k))
    rem = total % k
    big = rem * (base + 1)
    first = F.call_function("div", rn - 1, base + 1) + 1
    rest = rem + F.call_function("div", rn - 1 - big, F.nullif(base, F.lit(0))) + 1
    return F.when(rn <= big, first).otherwise(rest).cast("long")


def with_ntile(df: DataFrame, order: list[Column], k: int, name: str,
               num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = NTILE(k) over ``order`` (a total order), computed distributed."""
    ranked = with_global_row_number(df, order, "_x1_rn", num_partitions, total_name="_x1_n")
    return ranked.withColumn(name, ntile_from_rank(F.col("_x1_rn"), F.col("_x1_n"), k)).drop("_x1_rn", "_x1_n")


def top_fraction(df: DataFrame, order: list[Column], fraction: float, minimum: int = 1,
                 num_partitions: int | None = None) -> DataFrame:
    """T4: the first max(minimum, floor(N * fraction)) rows of ``order``."""
    ranked = with_global_row_number(df, order, "_x1_rn", num_partitions, total_name="_x1_n")
    k = F.greatest(F.lit(minimum).cast("long"), F.floor(F.col("_x1_n") * F.lit(fraction)).cast("long"))
    return ranked.where(F.col("_x1_rn") <= k).drop("_x1_rn", "_x1_n")


def with_position(top_k: DataFrame, order: list[Column], name: str = "posicao") -> DataFrame:
    """1-based position inside an already limited top-k result (k rows, so one
    ordered window over them is bounded by k, not by the data)."""
    return top_k.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
