"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import cut, join_groups

#: Edges up to which a graph is one partition.
SMALL = 2_000


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node of ``edges``: component is its smallest node.

    Turns of large star (larger neighbours move to the smallest one) and small star (smaller
    neighbours do) until the edges are the stars themselves.  Each turn is written to the checkpoint
    folder; the driver gets counts only.  A graph of SMALL edges is one partition, as its turns would else
    be hundreds of tasks without rows.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    small = now.count() <= SMALL

    def one(df: DataFrame) -> DataFrame:
        return df.coalesce(1) if small else df

    def met(rows: DataFrame, least: DataFrame) -> DataFrame:
        return rows.join(one(least), "u") if small else join_groups(rows, least, ["u"], "_n")

    state = None
    while True:
        now = one(now)
        both = one(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")).withColumn("m", F.least("m", "u")))
        large = cut(met(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct())
        large = one(large)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")))
        moved = met(large, least)
        now = cut(one(moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
                      .unionByName(least.select("u", F.col("m").alias("v")))).distinct())
        sums = tuple(one(now).agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if sums == state:
            break
        state = sums
    now = one(now)
    return one(now.select(F.col("u").alias("node"), F.col("v").alias("component"))
               .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
