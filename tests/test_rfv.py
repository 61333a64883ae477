"""RFV / inactivity: boundary days, never-bought customers, reference-test properties."""

import datetime as dt

from pyspark.sql import functions as F

from orderlens.operators import inactivity, rfv
from tests.conftest import customer, make, order

REF = "2025-06-30"


def _ref_minus(days):
    return (dt.date.fromisoformat(REF) - dt.timedelta(days=days)).isoformat()


def test_fixed_thresholds_at_boundaries(spark):
    # customer i: last order exactly d days before ref, with f orders
    cases = {1: (30, 5), 2: (31, 5), 3: (60, 3), 4: (61, 3), 5: (90, 2), 6: (91, 2), 7: (30, 4), 8: (60, 2)}
    clientes = make(spark, "clientes", [customer(i) for i in cases])
    rows, oid = [], 0
    for c, (d, f) in cases.items():
        for j in range(f):
            oid += 1
            rows.append(order(oid, c, _ref_minus(d + j * 400), "100.00"))
    pedidos = make(spark, "pedidos", rows)
    out = {r.id_cliente: r.segmento for r in rfv.rfv_fixed(pedidos, clientes, REF).collect()}
    assert out == {1: "Campeão", 2: "Fiel", 3: "Fiel", 4: "Ativo", 5: "Ativo", 6: "Em Risco",
                   7: "Fiel", 8: "Ativo"}


def test_rfm_scores_properties(spark, seed):
    out = rfv.rfm_scores(seed["pedidos"], seed["clientes"], REF).collect()
    assert len(out) == 4  # customer 4 has only a cancelled order
    for r in out:
        assert 1 <= r.score_r <= 5 and 1 <= r.score_f <= 5 and 1 <= r.score_m <= 5
        assert 3 <= r.score_rfm_total <= 15


def test_test_variant_lag_null_only_first(spark, seed):
    out = rfv.rfv_test_scores(seed["pedidos"], REF).orderBy(F.col("valor_total").desc()).collect()
    assert out[0].valor_anterior is None
    assert all(r.valor_anterior is not None for r in out[1:])
    assert [r.valor_anterior for r in out[1:]] == [r.valor_total for r in out[:-1]]


def test_mean_gap_telescopes(spark):
    clientes = make(spark, "clientes", [customer(1)])
    pedidos = make(spark, "pedidos", [order(1, 1, "2025-01-01", "1"), order(2, 1, "2025-01-04", "1"),
                                      order(3, 1, "2025-01-04", "1"), order(4, 1, "2025-01-12", "1")])
    r = rfv.rfm_scores(pedidos, clientes, REF).collect()[0]
    assert r.gap_medio_dias == 4  # gaps 3, 0, 8 -> 11/3 = 3.67 -> 4


def test_never_bought_and_only_cancelled(spark):
    clientes = make(spark, "clientes", [customer(1, cadastro="2024-01-01"), customer(2, cadastro="2024-06-01"),
                                        customer(3)])
    pedidos = make(spark, "pedidos", [order(1, 2, "2025-06-01", "10", status="Cancelado"),
                                      order(2, 3, "2025-06-20", "10")])
    out = {r.id_cliente: r for r in inactivity.inactive_or_never(pedidos, clientes, REF).collect()}
    assert set(out) == {1, 2}
    assert out[1].status_inatividade == "Nunca comprou" and out[1].total_pedidos_historico == 0
    assert out[2].status_inatividade == "Nunca comprou" and out[2].ultima_compra == "2024-06-01"
    six = {r.id_cliente for r in inactivity.inactive_six_months(pedidos, clientes, REF).collect()}
    assert six == {1, 2}
    # IN1 counts cancelled orders: customer 2 is active there (29 days)
    assert inactivity.inactive_customers(pedidos, clientes, REF).count() == 0


def test_inactivity_bands(spark):
    clientes = make(spark, "clientes", [customer(i) for i in range(1, 6)])
    days = {1: 89, 2: 90, 3: 179, 4: 180, 5: 366}
    pedidos = make(spark, "pedidos", [order(i, i, _ref_minus(d), "1") for i, d in days.items()])
    inact = inactivity.inactive_customers(pedidos, clientes, REF, min_days=0)
    k = inactivity.inactivity_kpis(inact).collect()[0]
    assert (k.total, k.mais_1_ano, k.de_6_a_12_meses, k.de_3_a_6_meses) == (5, 1, 1, 2)
    assert k.perda_estimada == 75000
    assert inactivity.inactivity_kpis(inact, min_days=180).collect()[0].total == 2


def test_resolved_anchor_equals_lazy_anchor(spark, seed):
    from orderlens.functions.dates import resolve_anchor
    anchor = resolve_anchor(seed["pedidos"])
    assert anchor == dt.date(2025, 3, 1)  # latest non-cancelled order
    lazy = sorted(tuple(r) for r in rfv.rfv_fixed(seed["pedidos"], seed["clientes"]).collect())
    eager = sorted(tuple(r) for r in rfv.rfv_fixed(seed["pedidos"], seed["clientes"], anchor).collect())
    assert lazy == eager
