"""Results past the sizes of the check data: long sequences, many divergences, large totals, NULL keys."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from orderlens import session
from orderlens.operators import divergence, inactivity, lineage, products, trends
from orderlens.plans.stats import grouped_box
from orderlens.sources import io
from tests.conftest import D, customer, item, make, order, product


def test_sequence_past_six_digits_keeps_its_digits(spark):
    pedidos = make(spark, "pedidos", [order(1, 1, "2025-01-01", "1.00"), order(2, 1, "2025-01-01", "1.00"), order(3, 1, "2025-01-02", "1.00")])
    got = [r.numero_pedido for r in lineage.order_numbers(pedidos, {2025: 999_999}).orderBy("id_pedido").collect()]
    assert got == ["AGR-2025-999999", "AGR-2025-1000000", "AGR-2025-1000001"]


def test_orders_without_a_date_stay_without_a_number(spark):
    undated = {**order(2, 1, "2025-01-01", "1.00"), "data_pedido": None}
    out = lineage.order_numbers(make(spark, "pedidos", [order(1, 1, "2025-01-01", "1.00"), undated]))
    assert [(r.id_pedido, r.numero_pedido is None, r.chave_unica is None) for r in out.orderBy("id_pedido").collect()] == [(1, False, False), (2, True, True)]


def test_every_divergence_is_listed_and_counted(spark):
    n = 620
    pedidos = make(spark, "pedidos", [order(i, 1, "2025-01-01", "10.00") for i in range(n)])
    itens = make(spark, "itens_pedido", [item(i, i, 1, 1, "9.00") for i in range(n)])
    clientes = make(spark, "clientes", [customer(1)])
    c1 = divergence.divergences_period(pedidos, itens, clientes)
    assert c1.count() == n and divergence.divergences_period(pedidos, itens, clientes, limite=5).count() == 5
    alerts = divergence.alert_counts(c1, inactivity.inactive_customers(pedidos, clientes)).first()
    assert alerts.anomalias_pendentes == n


def test_reason_follows_the_rule_that_held(spark):
    """1000.00 and 900.00 lie just 10 % apart: similarity 90.0, but only the delivery date makes them a pair."""
    rows = [order(1, 1, "2025-01-01", "1000.00", entrega="2025-01-09"), order(2, 1, "2025-01-01", "900.00", entrega="2025-01-09"),
            order(3, 1, "2025-02-01", "1000.00", entrega="2025-02-08"), order(4, 1, "2025-02-01", "900.01", entrega="2025-02-09")]
    pairs = lineage.duplicate_candidates(make(spark, "pedidos", rows), make(spark, "clientes", [customer(1)]))
    got = sorted((r.similaridade, r.motivo) for r in lineage.duplicate_alerts(pairs).collect())
    assert got == [(90.0, "Mesmo cliente e data, valores a menos de 10%"), (90.0, "Mesmo cliente, data e entrega")]


def test_months_and_products_above_ten_trillion(spark):
    big = "9999999999999.99"
    pedidos = make(spark, "pedidos", [order(i, 1, "2025-01-10", big) for i in range(12)])
    trend = trends.monthly_trend(pedidos, exact=True)
    assert trends.trend_kpis(trend).first().total_vendas == float(12 * Decimal(big))
    assert trends.trend_table(trend).first().acumulado == float(12 * Decimal(big))
    assert trends.chart_feed(trend).first().vendas_milhoes == 120000000.0
    assert trends.year_comparison(trends.year_month_matrix(pedidos, exact=True)).first().projecao == pytest.approx(12 * 12 * 9999999999999.99)
    itens = make(spark, "itens_pedido", [{**item(i, i, 1, 1, "1.00"), "quantidade": D("9999999.00"), "preco_unitario": D("999999.00"),
                                          "subtotal": D("9998998999001.00")} for i in range(12)])
    produtos = make(spark, "produtos", [product(1)])
    revenue = products.product_revenue(itens, pedidos, produtos)
    assert products.top_products_pct(revenue).first().percentual == 100
    assert products.margin_ranking(itens, pedidos, produtos).first().total_vendas > 1e13


def test_wide_months(spark):
    pedidos = make(spark, "pedidos", [order(1, 1, "2024-02-10", "10.00"), order(2, 1, "2025-03-10", "5.00")])
    wide = trends.year_columns(trends.year_month_matrix(pedidos), dt.date(2025, 3, 10)).orderBy("mes").collect()
    assert len(wide) == 12 and wide[0].mes_nome == "Jan"
    assert (wide[1].vendas_2024, wide[1].contratos_2024, wide[1].vendas_2025, wide[2].vendas_2025) == (10.0, 1, 0.0, 5.0)


def test_null_group_has_a_box(spark):
    df = spark.createDataFrame([(None, 1.0, 1), (None, 3.0, 2), ("a", 5.0, 3)], "g string, v double, id long")
    assert sorted((str(r.g), r.n, r.mediana) for r in grouped_box(df, ["g"], "v", "id").collect()) == [("None", 2, 2.0), ("a", 1, 5.0)]


def test_missing_tables_are_none_on_any_file_system(spark, tmp_path):
    make(spark, "clientes", [customer(1)]).write.parquet(f"{tmp_path}/clientes.parquet")
    got = io.load_tables(spark, f"file://{tmp_path}", names=["clientes", "produtos"])
    assert got["produtos"] is None and got["clientes"].count() == 1
    make(spark, "clientes", [customer(1)]).write.csv(f"{tmp_path}/clientes.csv", header=True)
    assert io.load_tables(spark, str(tmp_path), "csv", ["clientes"])["clientes"].first().id_cliente == 1


def test_cluster_needs_a_shared_checkpoint_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        session.checkpoint_dir(Session())
