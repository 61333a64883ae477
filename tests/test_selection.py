"""Selected rows, seek predicates, paging, stored retention and correlations against plain versions."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from orderlens.operators import lineage
from orderlens.plans import selection
from orderlens.plans.selection import after, first_fraction, keys_at, ordering, tile_column
from orderlens.plans.stats import correlation_matrix, grouped_box
from orderlens.sources.browse import next_page


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(11)
    rows = [(i, None if i % 17 == 0 else 7 if i % 3 == 0 else rnd.randint(-50, 50), rnd.choice(["a", "B", "é", None])) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, v long, s string").repartition(5).cache()


@pytest.mark.parametrize("sort", [[("v", True), ("id", True)], [("v", False), ("id", False)], [("s", False), ("v", True), ("id", True)]])
def test_keys_at_and_after_follow_the_order(spark, table, monkeypatch, sort):
    """Few rows and many rounds of brackets give the rows that sorting gives; a third of all rows share one value."""
    rows = table.orderBy(*ordering(sort)).collect()
    ranks = [1, 2, 700, 1500, 1501, 2999, 3000]
    want = [{c: rows[r - 1][c] for c, _ in sort} for r in ranks]
    assert keys_at(table, sort, ranks) == want
    monkeypatch.setattr(selection, "FEW", 60)
    monkeypatch.setattr(selection, "SAMPLE", 200)
    assert keys_at(table, sort, ranks[1:5]) == want[1:5]
    types = {"id": "bigint", "v": "bigint", "s": "string"}
    for r in (1, 1234, 3000):
        beyond = table.where(after(sort, rows[r - 1].asDict(), types))
        assert {x.id for x in beyond.collect()} == {x.id for x in rows[r:]}


@pytest.mark.parametrize("n,k", [(0, 5), (3, 5), (5, 5), (23, 5), (300, 7)])
def test_tiles_match_ntile(spark, table, n, k):
    df = table.orderBy("id").limit(n)
    sort = [("v", False), ("id", True)]
    rows = df.orderBy(*ordering(sort)).collect()
    want = {r.id: (i // (n // k + 1) if i < n % k * (n // k + 1) else n % k + (i - n % k * (n // k + 1)) // max(n // k, 1)) + 1 for i, r in enumerate(rows)}
    assert {r.id: r.t for r in df.withColumn("t", tile_column(df, sort, k, n)).collect()} == want


def test_no_sort_of_the_table(spark, table):
    plan = first_fraction(table, [("v", False), ("id", True)], 0.15)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan.split("InMemoryTableScan")[0]
    assert first_fraction(table, [("v", False), ("id", True)], 0.15).count() == 450


def test_pages_join_up(spark, table):
    """Keyset pages under equal and missing names hold every row once, in order."""
    sort, last, seen = [("s", True), ("v", False), ("id", True)], None, []
    df = table.limit(230)
    while page := next_page(df, None, [], sort, last, size=40).collect():
        seen += [r.id for r in page]
        last = page[-1].asDict()
    assert seen == [r.id for r in df.orderBy(*ordering(sort)).collect()]
    plan = next_page(df, "a", ["s"], sort, last)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_box_of_tied_values(spark):
    df = spark.createDataFrame([(i, 5.0 if i % 3 else float(i)) for i in range(1000)], "id long, v double")
    r = grouped_box(df, [], "v", "id").first()
    values = sorted(5.0 if i % 3 else float(i) for i in range(1000))
    at = lambda p: values[math.floor(999 * p)] + (values[math.ceil(999 * p)] - values[math.floor(999 * p)]) * (999 * p % 1)
    assert (r.q1, r.mediana, r.q3) == tuple(at(p) for p in (0.25, 0.5, 0.75))


def test_correlation_far_from_zero(spark):
    """Ten million rows around 1e9: y = x + noise of equal variance correlates by sqrt(1/2), a constant with nothing."""
    i = F.col("id")
    x, e = (i % 2) * 2 - 1, (F.floor(i / 2) % 2) * 2 - 1
    df = spark.range(10_000_000).select((x + 1_000_000_000).alias("x"), (x + e + 1_000_000_000).alias("y"), F.lit(4).alias("c"))
    got = {(r.var_x, r.var_y): r["corr"] for r in correlation_matrix(df, ["x", "y", "c"], digits=6).collect()}
    assert got["x", "y"] == got["y", "x"] == round(math.sqrt(0.5), 6) and got["x", "x"] == 1.0 and got["x", "c"] is None


def test_stored_retention(spark, tmp_path):
    """Old months go unread, the limit's month is rewritten, later months keep their files, rows without a time stay."""
    times = [dt.datetime(2024, 11, 30, 23), dt.datetime(2025, 3, 1), dt.datetime(2025, 3, 14, 9, 59, 59), dt.datetime(2025, 3, 14, 10), dt.datetime(2025, 3, 31),
             dt.datetime(2025, 4, 1), None]
    audit = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id_registro long, data_hora timestamp")
    path = f"{tmp_path}/audit"
    lineage.write_audit_table(audit, path)
    april = spark.read.parquet(path).where("mes = '2025-04'").inputFiles()
    april = [f for f in april if "2025-04" in f]
    assert lineage.retain_audit_table(spark, path, "2027-03-14 10:00:00", years=2) == 1
    left = spark.read.parquet(path)
    assert sorted(r.id_registro for r in left.collect()) == [3, 4, 5, 6]
    assert {r.id_registro for r in lineage.retain_audit(audit, "2027-03-14 10:00:00")[0].collect()} == {3, 4, 5, 6}
    files = left.inputFiles()
    assert not any("2024-11" in f for f in files) and [f for f in files if "2025-04" in f] == april
    assert lineage.retain_audit_table(spark, path, "2027-03-14 10:00:00", years=2) == 0
    assert lineage.retain_audit_table(spark, f"{tmp_path}/none", "2027-03-14", years=2) == 0
