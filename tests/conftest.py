from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from orderlens import model  # noqa: E402
from orderlens.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[*]", 8)
    yield s


def D(x):
    return Decimal(str(x))


def day(s):
    return dt.date.fromisoformat(s)


def make(spark, name, rows):
    """DataFrame of a model table from partial dict rows (missing columns NULL)."""
    schema = model.SCHEMAS[name]
    full = []
    for r in rows:
        full.append(tuple(r.get(f.name) for f in schema.fields))
    return spark.createDataFrame(full, schema)


def customer(i, regiao="Sul", nome=None, tipo="Cooperativa", estado="PR", cadastro="2024-01-01"):
    return {"id_cliente": i, "nome": nome or f"Cliente {i}", "tipo_cliente": tipo, "regiao": regiao,
            "estado": estado, "data_cadastro": day(cadastro), "limite_credito": D("0.00")}


def order(i, cliente, data, valor, status="Executado", entrega=None, tipo="Spot"):
    return {"id_pedido": i, "id_cliente": cliente, "data_pedido": day(data),
            "data_entrega": day(entrega or data), "tipo_contrato": tipo, "status": status,
            "regiao_origem": "Sul", "regiao_destino": "Sul", "valor_total": D(valor)}


def item(i, pedido, produto, qtd, preco):
    q, p = D(qtd), D(preco)
    return {"id_item": i, "id_pedido": pedido, "id_produto": produto, "quantidade": q,
            "preco_unitario": p, "unidade": "un", "subtotal": (q * p).quantize(D("0.01"))}


def product(i, nome=None, categoria="Commodity", sub="Soja", preco="100.00", custo=None):
    return {"id_produto": i, "nome": nome or f"Produto {i}", "categoria": categoria, "subcategoria": sub,
            "unidade": "un", "preco_unitario": D(preco), "custo_referencia": None if custo is None else D(custo)}


@pytest.fixture(scope="session")
def seed(spark):
    """Five-customer seed scenario (FIXTURES.md section 3: 5 customers, 5 products, 5 orders, 8 lines, 2 shares)."""
    clientes = make(spark, "clientes", [
        customer(1, "Sul", "Cooperativa do Oeste", "Cooperativa", "PR", "2024-01-10"),
        customer(2, "Centro-Oeste", "Fazenda Boa Safra", "Produtor Rural", "MT", "2024-02-15"),
        customer(3, "Sudeste", "Trading Grãos SA", "Trading Company", "SP", "2024-01-05"),
        customer(4, "Sudeste", "Usina Processadora Sudeste", "Processadora", "SP", "2024-03-20"),
        customer(5, "Norte", "Distribuidora do Norte", "Atacadista", "PA", "2024-04-01"),
    ])
    produtos = make(spark, "produtos", [
        product(1, "Soja - Exportação Granel", "Commodity", "Soja", "116.00", "73.00"),
        product(2, "Milho Amarelo Tipo 2", "Commodity", "Milho", "65.00", "42.00"),
        product(3, "Café Arábica Tipo 6", "Commodity", "Café", "980.00", "620.00"),
        product(4, "Frete Rodoviário MT-SP", "Serviço", "Frete", "210.00", "180.00"),
        product(5, "Armazenagem Frigorífica 30d", "Serviço", "Armazenagem", "450.00", "310.00"),
    ])
    pedidos = make(spark, "pedidos", [
        order(1, 1, "2025-01-10", "392414.72", "Executado", "2025-01-25"),
        order(2, 2, "2025-02-05", "870000.00", "Em Andamento", "2025-03-20", "A Termo"),
        order(3, 3, "2025-01-20", "1250000.00", "Executado", "2025-02-10", "Futuro"),
        order(4, 4, "2024-09-15", "45000.00", "Cancelado", "2024-10-01"),
        order(5, 5, "2025-03-01", "99000.00", "Executado", "2025-03-15"),
    ])
    itens = make(spark, "itens_pedido", [
        item(1, 1, 1, 2500, "85.00"), item(2, 1, 4, 500, "210.00"),
        item(3, 2, 1, 5000, "116.00"), item(4, 2, 4, 1300, "210.00"),
        item(5, 3, 1, 8000, "116.00"), item(6, 3, 2, 3000, "65.00"),
        item(7, 5, 2, 1500, "65.00"), item(8, 5, 5, 1, "450.00"),
    ])
    shares = make(spark, "pedido_clientes", [
        {"id_pedido": 2, "id_cliente": 2, "percentual_rateio": D("60.00"), "valor_rateado": D("522000.00")},
        {"id_pedido": 2, "id_cliente": 3, "percentual_rateio": D("40.00"), "valor_rateado": D("348000.00")},
    ])
    return {"clientes": clientes, "produtos": produtos, "pedidos": pedidos, "itens_pedido": itens,
            "pedido_clientes": shares}
