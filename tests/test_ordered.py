"""Previous rows and runs over range partitions equal Spark's windows, whatever the edges; duplicate groups in linear space."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from orderlens.operators import lineage, rfv
from orderlens.plans.ordered import with_previous, with_runs
from tests.conftest import customer, make, order


@pytest.mark.parametrize("n,parts", [(0, 4), (1, 3), (300, 7), (300, 40), (9, 16)])
def test_previous_and_runs_match_windows(spark, n, parts):
    rnd = random.Random(n)
    rows = [(i, None if i % 11 == 0 else 1 if i % 3 == 0 else rnd.randint(2, 9), rnd.randint(0, 60)) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, g long, d long")
    w = Window.partitionBy("g").orderBy("d", "id")
    linked = F.col("d") - F.col("prev_d") < 2
    number = F.count_if(~F.coalesce(linked, F.lit(False))).over(w)
    plain = df.withColumn("prev_d", F.lag("d").over(w)).withColumn("prev_id", F.lag("id").over(w)).withColumn("no", number)
    plain = plain.withColumn("run", F.first("id").over(Window.partitionBy("g", "no").orderBy("d", "id")))
    want = {r.id: (r.prev_d, r.prev_id, r.run) for r in plain.collect()}
    order_by = [F.col("d").asc(), F.col("id").asc()]
    got = with_runs(df, ["g"], order_by, ["d"], linked, "id", num_partitions=parts).collect()
    assert {r.id: (r.prev_d, r.prev_id, r.run) for r in got} == want and len(got) == n
    assert {r.id: r.prev_d for r in with_previous(df, ["g"], order_by, ["d"], num_partitions=parts).collect()} == {i: x[0] for i, x in want.items()}


def test_one_run_over_all_partitions(spark):
    """Every row of a million-row-like run keeps the first row's id, over empty and full partitions."""
    df = spark.range(5000).select("id", F.lit(1).alias("g"))
    out = with_runs(df, ["g"], [F.col("id").asc()], [], F.col("prev_id").isNotNull(), "id", num_partitions=23)
    assert out.agg(F.min("run"), F.max("run"), F.count("prev_id")).first()[:] == (0, 0, 4999)


def test_purchase_gaps_need_no_self_join(spark):
    pedidos = make(spark, "pedidos", [order(i, i % 3, f"2025-01-{1 + i % 28:02d}", "1.00") for i in range(60)])
    plan = rfv.purchase_gaps(pedidos)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "hashpartitioning(_lag" not in plan


def _groups(rows):
    """Components of all like pairs, per criterion, by plain union-find."""
    out = set()
    for by_value in (True, False):
        head = {r["id_pedido"]: r["id_pedido"] for r in rows}
        find = lambda x: x if head[x] == x else find(head[x])
        for a in rows:
            for b in rows:
                if a["id_pedido"] < b["id_pedido"] and (a["id_cliente"], a["data_pedido"]) == (b["id_cliente"], b["data_pedido"]):
                    v, w = a["valor_total"], b["valor_total"]
                    like = min(v, w) > 0 and abs(v - w) < max(v, w) * Decimal("0.10") if by_value else a["data_entrega"] is not None and a["data_entrega"] == b["data_entrega"]
                    if like:
                        head[find(a["id_pedido"])] = find(b["id_pedido"])
        members = {}
        for r in rows:
            members.setdefault(find(r["id_pedido"]), set()).add(r["id_pedido"])
        out |= {(by_value, frozenset(m)) for m in members.values() if len(m) > 1}
    return out


def test_duplicate_groups_are_the_components_of_all_pairs(spark):
    rnd = random.Random(5)
    rows = [order(i, 1 if i % 3 else rnd.randint(2, 4), f"2025-03-0{rnd.randint(1, 3)}", rnd.choice(["0.00", f"{rnd.randint(1, 400)}.{rnd.randint(0, 99):02d}"]),
                  entrega=rnd.choice([None, "2025-03-05", "2025-03-06", "2025-03-07"])) for i in range(160)]
    clientes = make(spark, "clientes", [customer(i) for i in range(1, 5)])
    links = lineage.duplicate_links(make(spark, "pedidos", rows), clientes).collect()
    got, size = {}, {}
    for r in links:
        got.setdefault((r.por_valor, r.grupo), {r.grupo}).update((r.id_pedido_1, r.id_pedido_2))
        size[r.por_valor, r.grupo] = size.get((r.por_valor, r.grupo), 1) + 1
    assert {(k[0], frozenset(m)) for k, m in got.items()} == _groups(rows)
    assert all(len(got[k]) == n for k, n in size.items())  # n members, n - 1 links
    summed = {(r.por_valor, r.grupo): r.tamanho for r in lineage.duplicate_groups(lineage.duplicate_links(make(spark, "pedidos", rows), clientes)).collect()}
    assert summed == size


def test_duplicates_of_one_day_stay_linear(spark):
    """100,000 like orders of one customer and day: one row for each but the first, not five thousand million pairs."""
    n = 100_000
    pedidos = spark.range(n).select(F.col("id").alias("id_pedido"), F.lit(1).cast("long").alias("id_cliente"), F.lit("2025-01-01").cast("date").alias("data_pedido"),
                                    F.lit(None).cast("date").alias("data_entrega"), (F.lit(1000) + F.col("id") % 50).cast("decimal(15,2)").alias("valor_total"))
    out = lineage.duplicate_links(pedidos, make(spark, "clientes", [customer(1)]))
    r = out.agg(F.count(F.lit(1)), F.count_distinct("grupo"), F.min("similaridade")).first()
    assert r[:2] == (n - 1, 1) and r[2] > 99
