"""Shares, owner JSON validation, hashes, snapshots, duplicates, constraints, histogram holes."""

import hashlib

import pytest
from pyspark.sql import functions as F

from orderlens.operators import dashboard, lineage, quality, sharing
from tests.conftest import D, customer, make, order


def test_generator_shares_sum_and_region(spark):
    clientes = make(spark, "clientes", [customer(1, "Sul"), customer(2, "Sul"), customer(3, "Norte"),
                                        customer(4, "Leste")])
    pedidos = make(spark, "pedidos", [order(i, 1 + i % 4, "2025-01-01", str(1000 * i)) for i in range(1, 21)])
    shares = sharing.generate_shares(pedidos, clientes)
    assert shares.select("id_pedido").distinct().count() == 3  # 15 % of 20
    check = sharing.share_check(shares).collect()
    assert all(r.valido and r.soma_pct == 100.0 for r in check)
    region = {r.id_cliente: r.regiao for r in clientes.collect()}
    owner = {r.id_pedido: r.id_cliente for r in pedidos.collect()}
    for r in shares.collect():
        pct = float(r.percentual_rateio)
        if r.id_cliente != owner[r.id_pedido]:
            assert 20 <= pct <= 40
            if region[owner[r.id_pedido]] == "Sul":
                assert region[r.id_cliente] == "Sul"


def test_shared_order_creation_validation(spark):
    pedidos = make(spark, "pedidos", [order(10, 1, "2025-01-01", "1")])
    reqs = spark.createDataFrame([
        (1, "2025-05-01", "2025-05-10", "Spot", "Sul", "Norte",
         '[{"cliente_id": 7, "percentual": 60, "tipo": "COMPRADOR"}, {"cliente_id": 8, "percentual": 40}]',
         '[{"produto_id": 1, "quantidade": 10, "preco_unitario": 5.5}]'),
        (2, "2025-05-01", "2025-05-10", "Spot", "Sul", "Norte", '[{"cliente_id": 7, "percentual": 99.99}]', None),
        (3, "2025-05-01", "2025-05-10", "Spot", "Sul", "Norte", "[]", None),
        (4, "2025-05-01", "2025-05-10", "Spot", "Sul", "Norte", "not json", None),
    ], "id_solicitacao long, data_pedido string, data_entrega string, tipo_contrato string, "
       "regiao_origem string, regiao_destino string, proprietarios string, itens string")
    orders, owners, lines, rejected = sharing.create_shared_orders(reqs, pedidos)
    o = orders.collect()
    assert len(o) == 1 and o[0].id_pedido == 11 and o[0].id_cliente == 7 and o[0].status == "Pendente"
    assert o[0].valor_total == D("55.00")
    own = {r.id_cliente: r for r in owners.collect()}
    assert own[8].tipo_participacao == "COMPRADOR" and own[7].valor_proporcional == D("33.00")
    assert lines.count() == 1
    rej = {r.id_solicitacao: r.motivo for r in rejected.collect()}
    assert rej[2].startswith("PERCENTUAL_") and rej[3] == "SEM_PROPRIETARIOS" and rej[4] == "JSON_INVALIDO"


def test_refresh_proportional_values(spark, seed):
    after = seed["pedidos"].withColumn("valor_total", F.when(F.col("id_pedido") == 2, F.lit(D("853000.00")))
                                       .otherwise(F.col("valor_total")).cast("decimal(15,2)"))
    out = {r.id_cliente: r.valor_rateado for r in
           sharing.refresh_proportional_values(seed["pedido_clientes"], seed["pedidos"], after).collect()}
    assert out == {2: D("511800.00"), 3: D("341200.00")}


def test_ownership_view(spark, seed):
    v = {r.id_pedido: r for r in sharing.ownership_view(seed["pedidos"], seed["clientes"],
                                                          seed["pedido_clientes"]).collect()}
    assert v[2].tipo_ownership == "COMPARTILHADO"
    assert v[2].todos_proprietarios == "Fazenda Boa Safra (60.00%), Trading Grãos SA (40.00%)"
    assert v[1].tipo_ownership == "INDIVIDUAL" and v[1].todos_proprietarios == "Cooperativa do Oeste"


def test_hash_matches_python_and_detects_tampering(spark, seed):
    traced = lineage.traced_orders(seed["pedidos"])
    r = traced.where("id_pedido = 1").collect()[0]
    text = f"1|{r.numero_pedido}|1|392414.72|Executado|2025-01-10"
    assert r.hash_integridade == hashlib.sha256(text.encode()).hexdigest()
    assert r.numero_pedido == "AGR-2025-020001"  # first 2025 order; the 2025 sequence starts at 20001
    tampered = traced.withColumn("valor_total", F.when(F.col("id_pedido") == 3, F.lit(D("1.00")))
                                 .otherwise(F.col("valor_total")).cast("decimal(15,2)"))
    rep = {x.id_pedido: x.status for x in lineage.integrity_report(tampered).collect()}
    assert rep[3] == "CORROMPIDO" and rep[1] == "VALIDO"
    ok, refused = lineage.stamp_updates(tampered, tampered.where("id_pedido in (1, 3)"))
    assert [x.id_pedido for x in refused.collect()] == [3]
    assert [x.versao for x in ok.collect()] == [2]


def test_audit_rows_from_snapshots(spark, seed):
    before = seed["pedidos"]
    after = (before.where("id_pedido != 4")
             .withColumn("status", F.when(F.col("id_pedido") == 1, F.lit("Pendente")).otherwise(F.col("status")))
             .withColumn("tipo_contrato", F.when(F.col("id_pedido") == 2, F.lit("Futuro")).otherwise(F.col("tipo_contrato")))
             .unionByName(make(spark, "pedidos", [order(9, 1, "2025-04-01", "5.00")])))
    ops = {r.id_registro: r.operacao for r in lineage.audit_rows(before, after).collect()}
    assert ops == {1: "UPDATE", 4: "DELETE", 9: "INSERT"}  # order 2 changed a non-audited column


def test_duplicates(spark):
    clientes = make(spark, "clientes", [customer(1)])
    pedidos = make(spark, "pedidos", [
        order(1, 1, "2025-01-01", "100.00", entrega="2025-01-02"), order(2, 1, "2025-01-01", "100.00", entrega="2025-01-03"),
        order(3, 1, "2025-01-01", "111.00", entrega="2025-01-04"), order(4, 1, "2025-01-01", "90.00", entrega="2025-01-05"),
        order(5, 1, "2025-01-01", "500.00", entrega="2025-01-02"),
        order(6, 1, "2025-02-01", "0.00"), order(7, 1, "2025-02-01", "0.00", entrega="2025-02-03")])
    pairs = {(r.id_pedido_1, r.id_pedido_2): r.similaridade
             for r in lineage.duplicate_candidates(pedidos, clientes).collect()}
    # 100 vs 111: gap 11 < 11.1 -> pair; 100 vs 90: gap 10 = 10 % of 100 -> not; 1 & 5 share delivery
    assert pairs == {(1, 2): 100.0, (1, 3): 90.09, (2, 3): 90.09, (1, 5): 20.0}


def test_constraint_report_one_violation_each(spark):
    clientes = make(spark, "clientes", [customer(1), customer(2, tipo="Outro", estado="ABC")])
    rep = {(r.tabela, r.regra): r.violacoes for r in quality.constraint_report({"clientes": clientes}).collect()}
    assert rep[("clientes", "tipo_cliente:in")] == 1 and rep[("clientes", "estado:max_len:2")] == 1
    assert rep[("clientes", "nome:not_null")] == 0


def test_value_histogram_holes(spark):
    vals = ["9999.99", "10000", "49999.00", "49999.50", "50000", "99999.99", "499999.01", "500000"]
    pedidos = make(spark, "pedidos", [order(i, 1, "2025-06-01", v) for i, v in enumerate(vals)])
    legacy = [r.contagem for r in dashboard.value_histogram(pedidos, "2025-06-30").orderBy("ordem").collect()]
    fixed = [r.contagem for r in dashboard.value_histogram(pedidos, "2025-06-30", hole_free=True)
             .orderBy("ordem").collect()]
    assert legacy == [1, 2, 1, 0, 1]  # 49,999.50, 99,999.99 and 499,999.01 fall in holes
    assert fixed == [1, 3, 2, 1, 1]


def test_groups_and_members(spark):
    import datetime as dt
    from orderlens.model import CLIENTE_GRUPO, GRUPOS_COMPRA
    clientes = make(spark, "clientes", [customer(1), customer(2), customer(3)])
    grupos = spark.createDataFrame([
        (1, "Grupo A", "COOPERATIVA", 1, dt.date(2025, 1, 1), True, None),
        (2, "Grupo B", "ASSOCIACAO", None, dt.date(2025, 1, 1), True, None),
        (3, "Grupo C", "CONSORCIO", 2, dt.date(2025, 1, 1), False, None)], GRUPOS_COMPRA)
    membros = spark.createDataFrame([
        (1, 1, D("25.00"), dt.date(2025, 1, 1), True), (2, 1, D("35.00"), dt.date(2025, 1, 1), True),
        (3, 1, D("40.00"), dt.date(2025, 1, 1), False)], CLIENTE_GRUPO)
    g = {r.id_grupo: r for r in sharing.active_groups(grupos, membros, clientes).collect()}
    assert set(g) == {1, 2}
    assert g[1].total_membros == 3 and g[1].representante == "Cliente 1"  # inactive members count too
    assert g[2].total_membros == 0 and g[2].representante is None
    m = [r.id_cliente for r in sharing.group_members(membros, clientes, 1).collect()]
    assert m == [2, 1]  # active only, largest share first


def test_duplicates_hot_group_against_brute_force(spark):
    import random
    from decimal import Decimal
    rnd = random.Random(11)
    rows = []
    for i in range(1, 401):
        hot = i <= 300  # 300 orders of one customer on one day
        v = Decimal(rnd.choice([0, rnd.randint(1, 10**7)])) / 100
        rows.append(order(i, 1 if hot else 2, "2025-01-01" if hot else "2025-01-0%d" % (1 + i % 3),
                          str(v), entrega="2025-02-%02d" % (1 + rnd.randint(0, 27))))
    pedidos = make(spark, "pedidos", rows)
    clientes = make(spark, "clientes", [customer(1), customer(2)])
    got = {(r.id_pedido_1, r.id_pedido_2): r.similaridade
           for r in lineage.duplicate_candidates(pedidos, clientes).collect()}
    want = {}
    for a in rows:
        for b in rows:
            if a["id_pedido"] >= b["id_pedido"] or a["id_cliente"] != b["id_cliente"] \
                    or a["data_pedido"] != b["data_pedido"]:
                continue
            v1, v2 = a["valor_total"], b["valor_total"]
            top = max(v1, v2)
            by_value = top > 0 and abs(v1 - v2) < top * Decimal("0.10")
            if by_value or a["data_entrega"] == b["data_entrega"]:
                if v1 == v2:
                    sim = 100.0
                else:
                    sim = float(((100 * (top - abs(v1 - v2)) / top)).quantize(Decimal("0.01"), "ROUND_HALF_UP"))
                want[(a["id_pedido"], b["id_pedido"])] = sim
    assert got == want


def test_order_documents_split_large_orders(spark, seed):
    from tests.conftest import item, product
    big = make(spark, "itens_pedido", [item(100 + i, 1, 1 + i % 5, 1 + i, "10.00") for i in range(25)])
    itens = seed["itens_pedido"].unionByName(big)
    docs = sharing.order_documents(seed["pedidos"], seed["pedido_clientes"], itens, seed["produtos"], max_items=10)
    rows = docs.collect()
    by_order = {}
    for r in rows:
        by_order.setdefault(r.id_pedido, []).append(r)
    assert len(by_order[1]) == 3 and all(r.partes == 3 for r in by_order[1])  # 27 lines in parts of <= ~10
    assert sum(len(r.itens) for r in by_order[1]) == 27
    assert len(by_order[4]) == 1 and by_order[4][0].itens == []  # no lines: one document, empty items
    assert [len(r.proprietarios) for r in by_order[2]] == [2]
    assert sorted(len(r.itens) for r in by_order[1]) == [7, 10, 10]  # parts follow the lines' order
    lines = [i.id_produto for r in sorted(by_order[1], key=lambda r: r.parte) for i in r.itens]
    assert lines == sorted(lines)
    named = sharing.order_documents(seed["pedidos"], seed["pedido_clientes"], itens, seed["produtos"], max_items=1, clientes=seed["clientes"])
    owners = [r.proprietarios for r in named.where("id_pedido = 2").orderBy("parte").collect()]
    assert [len(o) for o in owners[:2]] == [1, 1] and owners[0][0].percentual >= owners[1][0].percentual and owners[0][0].nome
    _ = product


def test_shared_order_creation_with_line_table(spark):
    pedidos = make(spark, "pedidos", [order(10, 1, "2025-01-01", "1")])
    reqs = spark.createDataFrame([
        (5, "2025-05-01", "2025-05-10", "Spot", "Sul", "Norte", '[{"cliente_id": 3, "percentual": 100}]', None)],
        "id_solicitacao long, data_pedido string, data_entrega string, tipo_contrato string, "
        "regiao_origem string, regiao_destino string, proprietarios string, itens string")
    lines = spark.createDataFrame([(5, 1, D("2.00"), D("1.25")), (5, 2, D("3.00"), D("2.00"))],
                                  "id_solicitacao long, id_produto long, quantidade decimal(12,2), preco_unitario decimal(12,2)")
    orders, owners, out_lines, rejected = sharing.create_shared_orders(reqs, pedidos, lines)
    o = orders.collect()[0]
    assert (o.id_pedido, o.id_cliente, o.valor_total) == (11, 3, D("8.50"))
    assert owners.collect()[0].valor_proporcional == D("8.50")
    assert sorted(r.subtotal for r in out_lines.collect()) == [D("2.50"), D("6.00")]
    assert rejected.count() == 0


def test_published_correction_is_all_or_nothing(spark, tmp_path, monkeypatch):
    """Tampered orders are refused, audit rows are the difference of two versions, a failure leaves the version before."""
    from orderlens.operators import publishing
    from orderlens.sources import versions
    from tests.conftest import item
    pedidos = make(spark, "pedidos", [order(1, 1, "2025-01-01", "100.00"), order(2, 1, "2025-01-02", "50.00"), order(3, 1, "2025-01-03", "7.00")])
    itens = make(spark, "itens_pedido", [item(1, 1, 1, 2, "60.00"), item(2, 2, 1, 1, "50.00"), item(3, 3, 1, 1, "9.00")])
    shares = spark.createDataFrame([(1, 1, "60.00", "60.00"), (1, 2, "40.00", "40.00")], "id_pedido long, id_cliente long, p string, v string")
    shares = shares.selectExpr("id_pedido", "id_cliente", "cast(p as decimal(5,2)) percentual_rateio", "cast(v as decimal(15,2)) valor_rateado")
    clientes, path = make(spark, "clientes", [customer(1), customer(2)]), str(tmp_path)
    assert publishing.first_version(spark, path, pedidos, itens, clientes, shares) == 1
    read = lambda name, v=None: versions.read_published(spark, path, name, v)
    # order 3 is changed outside the system: its hash no longer fits
    tables = {n: read(n) for n in ("pedidos", "itens_pedido", "clientes", "pedido_clientes", "log_correcoes", "audit_log", "recusados")}
    tables["pedidos"] = tables["pedidos"].withColumn("status", F.when(F.col("id_pedido") == 3, "X").otherwise(F.col("status")))
    assert versions.publish(spark, path, tables) == 2
    monkeypatch.setattr(publishing.lineage, "audit_rows", lambda *a, **k: tables["audit_log"].union(spark.range(1).select(
        *[F.raise_error(F.lit("lost")).cast(f.dataType).alias(f.name) for f in tables["audit_log"].schema])))
    with pytest.raises(Exception, match="lost"):
        publishing.correct_published(spark, path, quando="2025-02-01 10:00:00")
    assert versions.latest(spark, path).version == 2 and read("pedidos").where("versao > 1").count() == 0
    monkeypatch.undo()
    assert publishing.correct_published(spark, path, quando="2025-02-01 10:00:00") == 3
    assert [(r.id_pedido, float(r.valor_total), r.versao) for r in read("pedidos").orderBy("id_pedido").collect()] == [(1, 120.0, 2), (2, 50.0, 1), (3, 7.0, 1)]
    assert [r.id_pedido for r in read("recusados").collect()] == [3] and [r.id_pedido for r in read("log_correcoes").collect()] == [1]
    assert sorted(float(r.valor_rateado) for r in read("pedido_clientes").collect()) == [48.0, 72.0]
    differ = read("pedidos", 2).exceptAll(read("pedidos", 3)).select("id_pedido").collect()
    assert {r.id_registro for r in read("audit_log").collect()} == {r.id_pedido for r in differ} == {1}
    assert publishing.correct_published(spark, path, quando="2025-02-02 10:00:00") == 4  # nothing left to correct
    assert read("audit_log").count() == 1


def test_publish_reads_the_tables_written_before(spark, tmp_path):
    """A table given as a function starts from the files of the same version."""
    from orderlens.sources.versions import publish, read_published
    rows = spark.range(3).withColumnRenamed("id", "id_pedido")
    publish(spark, f"{tmp_path}/v", {"a": rows, "b": lambda written: written("a").where("id_pedido > 0")})
    assert sorted(r.id_pedido for r in read_published(spark, f"{tmp_path}/v", "b").collect()) == [1, 2]


def test_audit_images_are_printed_after_the_join(spark):
    """JSON of the rows with an operation only: none of it is shuffled."""
    before = spark.createDataFrame([(1, "1.00", "P", None), (2, "2.00", "P", None), (None, "3.00", "P", None)],
                                   "id_pedido long, valor_total string, status string, data_entrega string")
    after = before.withColumn("status", F.when(F.col("id_pedido") == 2, "E").otherwise(F.col("status")))
    audit = lineage.audit_rows(before, after)
    plan = audit._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json" in plan[:plan.index("Join FullOuter")].lower().replace("structstojson", "to_json")
    assert "to_json" not in plan[plan.index("Join FullOuter"):].lower().replace("structstojson", "to_json")
    assert sorted((r.operacao, r.id_registro) for r in audit.collect() if r.id_registro) == [("UPDATE", 2)]
