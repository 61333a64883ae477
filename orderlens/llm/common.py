"""Small helpers that the operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Hashable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.session import checkpoint_dir, ship_package

#: Rows up to which a table of keys and small values is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000

#: Bytes up to which a table whose size was summed is broadcast.
BROADCAST_BYTES = 64 << 20

#: A key holding at least this share of all rows is hot; there are at most 1 / HOT_SHARE such keys.
HOT_SHARE = 0.001

#: A key with at least so many rows is hot in any case, so that no task of a join gets more rows of one key.
COLD_ROWS = 1_000_000

#: Groups up to which a join takes all of them by broadcast.
FEW_GROUPS = 20_000

#: White space that parts words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

#: What this Python worker keeps from task to task, of one step at a time.
_KEPT: dict[Hashable, Any] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there: later steps and lost
    executors start from the files."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path beside the checkpoints, which driver and executors share."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def python_ready(spark: SparkSession, rows_per_batch: int = 512) -> None:
    """The package on the executors, and Arrow batches small enough for very long texts."""
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows_per_batch:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_per_batch)


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What this Python worker keeps under ``key`` for its next tasks, made if missing.  Workers outlive their
    stage, so what another step kept goes first: an executor never holds the memory of two."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Drops what an earlier step kept; for steps that keep nothing themselves."""
    _KEPT.clear()


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def by_keys(rows: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    """Rows whose ``on`` is (or for ``left_anti``, isn't) among ``keys``: by broadcast while the counted
    keys are few, else by shuffle."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, on, how)


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str) -> DataFrame:
    """Inner join of ``rows`` with one row per group, hot groups apart.

    ``size`` names the groups' row counts.  Up to FEW_GROUPS groups are broadcast whole.  Of more, those with HOT_SHARE of the
    rows, or COLD_ROWS, are broadcast: they number 1 / HOT_SHARE at most, or a millionth of the rows; in the shuffle join of
    the rest no key holds more.  Without such groups there is nothing to part.
    """
    total, most, n = groups.agg(F.sum(size), F.max(size), F.count(F.lit(1))).first()
    if n <= FEW_GROUPS:
        return rows.join(F.broadcast(groups), on)
    limit = max(2.0, min((total or 0) * HOT_SHARE, COLD_ROWS))
    if most is not None and most < limit:
        return rows.join(groups, on)
    hot, cold = groups.where(F.col(size) >= limit), groups.where(F.col(size) < limit)
    many = rows.join(F.broadcast(hot), on)
    few = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    return many.unionByName(few)
