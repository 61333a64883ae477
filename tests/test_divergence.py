"""Divergence detection and set-based correction."""

import datetime as dt

from pyspark.sql import functions as F

from orderlens.operators import divergence, products, trends
from orderlens.model import LOG_CORRECOES
from tests.conftest import D, customer, item, make, order, product

WHEN = "2025-07-01 09:00:00"


def _orders(spark):
    clientes = make(spark, "clientes", [customer(1)])
    pedidos = make(spark, "pedidos", [
        order(1, 1, "2025-01-01", "100.00"), order(2, 1, "2025-01-01", "100.01"),
        order(3, 1, "2025-01-01", "100.02"), order(4, 1, "2025-01-01", "105.00"),
        order(5, 1, "2025-01-01", "50.00"), order(6, 1, "2025-01-01", "0.00")])
    itens = make(spark, "itens_pedido", [item(1, 1, 1, 1, "100.00"), item(2, 2, 1, 1, "100.00"),
                                         item(3, 3, 1, 1, "100.00"), item(4, 4, 1, 1, "100.00"),
                                         item(6, 6, 1, 1, "0.00")])
    return clientes, pedidos, itens


def test_tolerance(spark):
    clientes, pedidos, itens = _orders(spark)
    ids = {r.id_pedido for r in divergence.divergences_all(pedidos, itens, clientes).collect()}
    assert ids == {3, 4}  # 0.00 and 0.01 are within tolerance; order 5 has no lines
    rel = {r.id_pedido for r in divergence.divergences_relative(pedidos, itens).collect()}
    assert rel == set()  # exactly 5 % is not above 5 %


def test_seed_gaps(spark, seed):
    out = {r.id_pedido: r for r in divergence.divergences_all(seed["pedidos"], seed["itens_pedido"],
                                                               seed["clientes"]).collect()}
    assert out[5].diferenca == 1050.0 and out[5].tipo_anomalia == "Superfaturado"
    assert out[1].diferenca == 74914.72


def test_correct_orders_statuses(spark):
    clientes, pedidos, itens = _orders(spark)
    log0 = spark.createDataFrame([], LOG_CORRECOES)
    result, log, corrected = divergence.correct_orders(pedidos, itens, pedidos.select("id_pedido"), log0,
                                                       quando=WHEN)
    st = {r.id_pedido: (r.status, r.valor_novo) for r in result.collect()}
    assert st[1][0] == "SEM_DIVERGENCIA" and st[2][0] == "SEM_DIVERGENCIA"
    assert st[3] == ("CORRIGIDO", 100.0) and st[5] == ("CORRIGIDO", 0.0)  # no lines -> 0
    assert sorted(r.id_correcao for r in log.collect()) == [1, 2, 3]
    vals = {r.id_pedido: r.valor_total for r in corrected.collect()}
    assert vals[4] == D("100.00") and vals[2] == D("100.01")


def test_latest_correction_and_rediverge(spark):
    clientes, pedidos, itens = _orders(spark)
    t = lambda s: dt.datetime.fromisoformat(s)
    log = spark.createDataFrame([
        (1, 3, "valor_total", D("100.02"), D("100.00"), "MANUAL", "u", "m", t("2025-02-01 10:00:00")),
        (2, 3, "valor_total", D("100.00"), D("100.02"), "AUTOMATICA", "u", "m", t("2025-03-01 10:00:00")),
        (3, 4, "status", None, None, "MANUAL", "u", "m", t("2025-03-01 10:00:00"))], LOG_CORRECOES)
    view = {r.id_pedido: r for r in divergence.anomaly_view(pedidos, itens, clientes, log).collect()}
    assert view[3].status_correcao == "CORRIGIDO" and view[3].tipo_correcao == "AUTOMATICA"
    assert view[4].status_correcao == "PENDENTE"  # a correction of another field does not count
    corrected, new_log, summary = divergence.correct_all_pending(pedidos, itens, clientes, log, quando=WHEN)
    assert [r.id_pedido for r in new_log.collect()] == [4]
    assert new_log.collect()[0].id_correcao == 4  # continues after the high-water mark
    assert summary.collect()[0].total_corrigidas == 1


def test_top_products_properties(spark, seed):
    out = products.top_share_of_total(seed["itens_pedido"], seed["pedidos"], seed["produtos"], "2025-06-30").collect()
    assert 1 <= len(out) <= 5
    vals = [r.total_vendas for r in out]
    assert vals == sorted(vals, reverse=True) and all(v > 0 for v in vals)
    assert all(0 <= r.percentual <= 100 for r in out)


def test_margin_cost_fallback(spark):
    produtos = make(spark, "produtos", [product(1, custo=None), product(2, custo="50.00")])
    clientes = make(spark, "clientes", [customer(1)])
    pedidos = make(spark, "pedidos", [order(1, 1, "2025-06-01", "300"), order(2, 1, "2025-06-01", "0", "Cancelado")])
    itens = make(spark, "itens_pedido", [item(1, 1, 1, 1, "100.00"), item(2, 1, 2, 2, "100.00"),
                                         item(3, 2, 1, 1, "200.00")])
    out = {r.id_produto: r for r in products.margin_ranking(itens, pedidos, produtos, "2025-06-30").collect()}
    # product 1: no reference cost -> 65 % of its mean price over all lines (100, 200) = 97.50
    assert out[1].total_custo == 97.5 and out[1].margem_bruta == 2.5
    assert out[2].total_custo == 100.0 and out[2].margem_pct == 50.0
    _ = clientes


def test_monthly_growth_missing_month(spark):
    pedidos = make(spark, "pedidos", [order(1, 1, "2024-11-05", "100.00"), order(2, 1, "2025-01-05", "150.00"),
                                      order(3, 1, "2025-02-05", "0.00"), order(4, 1, "2025-03-05", "10.00")])
    out = {r.mes_ano: r for r in trends.monthly_trend(pedidos).collect()}
    assert out["2024-11"].crescimento is None
    assert out["2025-01"].crescimento == 50.0  # previous existing month, not the calendar one
    assert out["2025-03"].crescimento is None  # previous month is zero
    ytd = {r.mes_ano: r.acumulado_ano for r in trends.monthly_trend_ytd(pedidos).collect()}
    assert ytd["2025-01"] == 150.0 and ytd["2025-03"] == 160.0
    m = trends.year_month_matrix(pedidos, "2025-03-31")
    assert m.count() == 24 and m.where(F.col("vendas") > 0).count() == 3


def test_approx_distinct_option(spark, seed):
    exact = {r.id_produto: r.total_contratos for r in products.top_share_of_total(
        seed["itens_pedido"], seed["pedidos"], seed["produtos"], "2025-06-30").collect()}
    approx = {r.id_produto: r.total_contratos for r in products.top_share_of_total(
        seed["itens_pedido"], seed["pedidos"], seed["produtos"], "2025-06-30", approx_distinct=True).collect()}
    assert exact == approx  # small counts are exact in the sketch


def test_anomaly_view_show_resolved(spark):
    clientes, pedidos, itens = _orders(spark)
    t = lambda s: dt.datetime.fromisoformat(s)
    log = spark.createDataFrame([(1, 2, "valor_total", D("100.50"), D("100.01"), "MANUAL", "u", "m",
                                  t("2025-02-01 10:00:00"))], LOG_CORRECOES)
    default = {r.id_pedido for r in divergence.anomaly_view(pedidos, itens, clientes, log).collect()}
    resolved = {r.id_pedido: r for r in divergence.anomaly_view(pedidos, itens, clientes, log,
                                                                show_resolved=True).collect()}
    assert default == {3, 4}  # order 2 (corrected, within tolerance now) vanishes
    assert set(resolved) == {2, 3, 4} and resolved[2].status_correcao == "CORRIGIDO"
