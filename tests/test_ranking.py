"""Distributed row numbers / NTILE equal Spark's single-partition window functions."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from orderlens.plans.ranking import top_fraction, with_global_row_number, with_ntile


def _data(spark, n, skew=False, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        k = 42 if (skew and i % 3 == 0) else rnd.randint(0, max(1, n // 10))
        rows.append((i, k, rnd.choice([1, 1, 2, 3])))
    return spark.createDataFrame(rows, "id long, k long, v long")


@pytest.mark.parametrize("n,skew,parts", [(0, False, 4), (3, False, 8), (5, False, 4), (23, False, 4),
                                          (500, True, 8), (1000, False, 3), (7, False, 16)])
def test_row_number_and_ntile_match_window(spark, n, skew, parts):
    df = _data(spark, n, skew)
    order = [F.col("k").desc(), F.col("v").asc(), F.col("id").asc()]
    w = Window.orderBy(*order)
    expected = {r.id: (r.rn, r.t) for r in df.select("id", F.row_number().over(w).alias("rn"),
                                                     F.ntile(5).over(w).alias("t")).collect()}
    got_rn = {r.id: r.rn for r in with_global_row_number(df, order, "rn", num_partitions=parts).collect()}
    got_t = {r.id: r.t for r in with_ntile(df, order, 5, "t", num_partitions=parts).collect()}
    assert got_rn == {k: v[0] for k, v in expected.items()}
    assert got_t == {k: v[1] for k, v in expected.items()}


def test_all_ties_broken_by_id(spark):
    df = spark.createDataFrame([(i, 1) for i in range(12)], "id long, k long")
    got = {r.id: r.t for r in with_ntile(df, [F.col("k").asc(), F.col("id").asc()], 5, "t").collect()}
    # 12 rows in 5 tiles: sizes 3,3,2,2,2
    assert [got[i] for i in range(12)] == [1, 1, 1, 2, 2, 2, 3, 3, 4, 4, 5, 5]


def test_top_fraction_at_least_one(spark):
    df = spark.createDataFrame([(i, i * 10) for i in range(5)], "id long, v long")
    top = top_fraction(df, [F.col("v").desc(), F.col("id").asc()], 0.15)
    assert [r.id for r in top.collect()] == [4]
    df2 = spark.createDataFrame([(i, i) for i in range(40)], "id long, v long")
    assert top_fraction(df2, [F.col("v").desc(), F.col("id").asc()], 0.15).count() == 6


def test_distributed_lag_matches_window(spark):
    from orderlens.plans.ranking import with_previous
    rnd = random.Random(3)
    rows = [(i, 1 if i % 3 == 0 else rnd.randint(2, 9), rnd.randint(0, 30)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g long, d long")
    w = Window.partitionBy("g").orderBy("d", "id")
    expected = {r.id: r.p for r in df.select("id", F.lag("d").over(w).alias("p")).collect()}
    got = {r.id: r.prev_d for r in with_previous(df, ["g"], [F.col("d").asc(), F.col("id").asc()], ["d"],
                                                 num_partitions=7).collect()}
    assert got == expected


def test_box_summary_edge_cases(spark):
    from orderlens.plans.stats import grouped_box
    df = spark.createDataFrame([("a", 1, 5.0), ("b", 2, 1.0), ("b", 3, 2.0), ("b", 4, 3.0), ("b", 5, 4.0),
                                ("b", 6, 100.0)], "g string, id long, v double")
    out = {r.g: r for r in grouped_box(df, ["g"], "v", "id").collect()}
    assert (out["a"].n, out["a"].q1, out["a"].mediana, out["a"].iqr, out["a"].outliers) == (1, 5.0, 5.0, 0.0, 0)
    b = out["b"]  # 1, 2, 3, 4, 100: q1 = 2, median 3, q3 = 4, upper fence 7 -> 100 is an outlier
    assert (b.q1, b.mediana, b.q3, b.bigode_superior, b.outliers) == (2.0, 3.0, 4.0, 4.0, 1)
    empty = grouped_box(df.where("v < 0"), [], "v", "id").collect()
    assert len(empty) == 1 and empty[0].n == 0 and empty[0].q1 is None and empty[0].outliers == 0


def test_histogram_constant_values(spark):
    from orderlens.plans.stats import equal_width_histogram
    df = spark.createDataFrame([(7,), (7,), (7,)], "d long")
    rows = sorted((r.bin, r.limite_inferior, r.contagem) for r in equal_width_histogram(df, "d", 4).collect())
    assert rows == [(0, 7, 3), (1, 7, 0), (2, 7, 0), (3, 7, 0)]
