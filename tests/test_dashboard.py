"""Money text, repeatable sampling, context snapshot layout."""

from pyspark.sql import functions as F

from orderlens.functions.numeric import money_millions_text
from orderlens.operators import dashboard
from tests.conftest import D, customer, item, make, order


def test_money_text_half_even_on_exact_value(spark):
    df = spark.createDataFrame([(D("5250000.00"),), (D("5350000.00"),), (D("999999.99"),), (D("12345678.90"),)],
                               "v decimal(15,2)")
    got = [r.t for r in df.select(money_millions_text(F.col("v")).alias("t")).collect()]
    assert got == ["R$ 5.2M", "R$ 5.4M", "R$ 1.0M", "R$ 12.3M"]


def test_headline_metrics(spark):
    clientes = make(spark, "clientes", [customer(1), customer(2)])
    pedidos = make(spark, "pedidos", [order(1, 1, "2025-01-01", "18450.50"), order(2, 1, "2025-01-02", "18450.49"),
                                      order(3, 2, "2025-01-03", "99.00", status="Cancelado")])
    r = dashboard.headline_metrics(pedidos, clientes).collect()[0]
    assert (r.contratos, r.clientes, r.faturamento) == (2, 2, 36900.99)
    assert r.ticket_medio == 18450.5 and r.ticket_texto == "R$ 18.450"  # 18450.495 -> whole units, half-even


def test_sample_is_repeatable_and_capped(spark):
    pedidos = make(spark, "pedidos", [order(i, 1, "2025-01-01", "10") for i in range(1, 51)])
    itens = make(spark, "itens_pedido", [item(i, i, 1, 1, "10.00") for i in range(1, 51)])
    a = [r.id_pedido for r in dashboard.items_value_sample(pedidos, itens, "2025-01-31", n=7).collect()]
    b = [r.id_pedido for r in dashboard.items_value_sample(pedidos, itens, "2025-01-31", n=7).collect()]
    assert a == b and len(a) == 7 and len(set(a)) == 7


def test_context_snapshot_layout(spark, seed):
    snap = dashboard.context_snapshot(seed["pedidos"], seed["clientes"], seed["itens_pedido"], seed["produtos"],
                                      "2025-03-31").collect()
    sections = {}
    for r in snap:
        sections.setdefault(r.secao, []).append(r.item)
    assert sorted(sections["metricas"]) == ["clientes", "contratos", "faturamento", "ticket_medio"]
    assert len(sections["produtos"]) == 3
    assert sum(r.valor for r in snap if r.secao == "segmentos") == 4  # customers with a non-cancelled order


def test_filter_on_named_region_column(spark, seed):
    o = dashboard.filtered_orders(seed["pedidos"], seed["clientes"], seed["itens_pedido"], seed["produtos"],
                                  ref_date="2025-03-31", regiao="SP", region_column="estado")
    assert sorted(r.id_pedido for r in o.collect()) == [3]  # order 4 (SP) is cancelled
    o2 = dashboard.filtered_orders(seed["pedidos"], seed["clientes"], seed["itens_pedido"], seed["produtos"],
                                   ref_date="2025-03-31", regiao="todas", produto="soja")
    assert sorted(r.id_pedido for r in o2.collect()) == [1, 2, 3]
