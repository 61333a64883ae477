"""Remaining boundary fixtures: share tolerance, NULL hash fields, key/FK violations, one-year comparison."""

import hashlib

from pyspark.sql import functions as F

from orderlens.operators import lineage, quality, sharing, trends
from tests.conftest import D, customer, make, order


def test_share_tolerance(spark):
    rows = []
    for oid, pcts in {1: ["60.00", "40.00"], 2: ["60.00", "39.99"], 3: ["60.00", "39.98"], 4: ["60.01", "40.01"],
                      5: ["100.00"]}.items():
        for i, p in enumerate(pcts):
            rows.append({"id_pedido": oid, "id_cliente": i + 1, "percentual_rateio": D(p), "valor_rateado": D("1.00")})
    out = {r.id_pedido: r.valido for r in sharing.share_check(make(spark, "pedido_clientes", rows)).collect()}
    assert out == {1: True, 2: True, 3: False, 4: False}  # single-party order 5 is not checked


def test_hash_with_null_fields(spark):
    pedidos = make(spark, "pedidos", [{"id_pedido": 7, "id_cliente": None, "data_pedido": None, "status": None,
                                       "valor_total": D("10.50")}])
    df = pedidos.withColumn("numero_pedido", F.lit(None).cast("string"))
    h = df.select(lineage.integrity_hash(df).alias("h")).collect()[0].h
    # id | number | client | value | status | date, NULL -> ''
    assert h == hashlib.sha256("7|||10.50||".encode()).hexdigest()


def test_key_and_orphan_reports(spark):
    clientes = make(spark, "clientes", [customer(1), customer(1), customer(2)])
    pedidos = make(spark, "pedidos", [order(1, 1, "2025-01-01", "1"), order(2, 9, "2025-01-01", "1")])
    keys = {r.tabela: (r.chaves_duplicadas, r.linhas_em_duplicidade)
            for r in quality.key_report({"clientes": clientes, "pedidos": pedidos}).collect()}
    assert keys == {"clientes": (1, 2), "pedidos": (0, 0)}
    orphans = {(r.tabela, r.coluna): r.orfaos
               for r in quality.orphan_report({"clientes": clientes, "pedidos": pedidos}).collect()}
    assert orphans == {("pedidos", "id_cliente"): 1}


def test_year_comparison_single_year(spark):
    pedidos = make(spark, "pedidos", [order(1, 1, "2025-02-10", "100.00"), order(2, 1, "2025-05-10", "300.00"),
                                      order(3, 1, "2025-05-20", "0.00", status="Cancelado")])
    r = trends.year_comparison(trends.year_month_matrix(pedidos, "2025-06-30")).collect()[0]
    # the year before has no orders: only 2025 is present
    assert (r.anos, r.yoy_pct, r.melhor_mes) == (1, None, "Mai")
    assert r.projecao == 2400.0  # 400 over 2 months with sales, scaled to 12
