"""Data-quality reports from the model's declared constraints.

Each table is read once for all of its rules (one aggregate of conditional
counts), and the result is unpivoted into one row per rule.  Key and
foreign-key checks are aggregates and anti-joins -- no row leaves the
executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions.numeric import dec
from orderlens.model import CATEGORIAS, STATUS_PEDIDO, TIPOS_CLIENTE, TIPOS_CONTRATO

# The declared constraints of the order model, as
# (table, column, kind, parameter).  Kinds: not_null, max_len, in (domain), gt, ge, pct.
RULES = [
    ("clientes", "nome", "not_null", None), ("clientes", "nome", "max_len", 150),
    ("clientes", "tipo_cliente", "not_null", None), ("clientes", "tipo_cliente", "in", TIPOS_CLIENTE),
    ("clientes", "regiao", "not_null", None), ("clientes", "regiao", "max_len", 50),
    ("clientes", "estado", "not_null", None), ("clientes", "estado", "max_len", 2),
    ("clientes", "data_cadastro", "not_null", None),
    ("produtos", "nome", "not_null", None), ("produtos", "nome", "max_len", 150),
    ("produtos", "categoria", "not_null", None), ("produtos", "categoria", "in", CATEGORIAS),
    ("produtos", "subcategoria", "not_null", None), ("produtos", "subcategoria", "max_len", 50),
    ("produtos", "unidade", "not_null", None), ("produtos", "unidade", "max_len", 20),
    ("produtos", "preco_unitario", "not_null", None), ("produtos", "preco_unitario", "gt", 0),
    ("pedidos", "data_pedido", "not_null", None), ("pedidos", "data_entrega", "not_null", None),
    ("pedidos", "id_cliente", "not_null", None),
    ("pedidos", "tipo_contrato", "not_null", None), ("pedidos", "tipo_contrato", "in", TIPOS_CONTRATO),
    ("pedidos", "status", "not_null", None), ("pedidos", "status", "in", STATUS_PEDIDO),
    ("pedidos", "regiao_origem", "not_null", None), ("pedidos", "regiao_destino", "not_null", None),
    ("pedidos", "valor_total", "not_null", None), ("pedidos", "valor_total", "ge", 0),
    ("itens_pedido", "id_pedido", "not_null", None), ("itens_pedido", "id_produto", "not_null", None),
    ("itens_pedido", "quantidade", "not_null", None), ("itens_pedido", "quantidade", "gt", 0),
    ("itens_pedido", "preco_unitario", "not_null", None), ("itens_pedido", "preco_unitario", "ge", 0),
    ("itens_pedido", "unidade", "not_null", None),
    ("pedido_clientes", "id_pedido", "not_null", None), ("pedido_clientes", "id_cliente", "not_null", None),
    ("pedido_clientes", "percentual_rateio", "not_null", None), ("pedido_clientes", "percentual_rateio", "pct", None),
    ("pedido_clientes", "valor_rateado", "not_null", None),
]

# Primary / unique keys and foreign keys of the model.
KEYS = [("clientes", ["id_cliente"]), ("produtos", ["id_produto"]), ("pedidos", ["id_pedido"]),
        ("itens_pedido", ["id_item"]), ("pedido_clientes", ["id_pedido", "id_cliente"])]
FOREIGN_KEYS = [("pedidos", "id_cliente", "clientes"), ("itens_pedido", "id_pedido", "pedidos"),
                ("itens_pedido", "id_produto", "produtos"), ("pedido_clientes", "id_pedido", "pedidos"),
                ("pedido_clientes", "id_cliente", "clientes")]


def violation(column: str, kind: str, param) -> F.Column:
    """True when a row breaks the rule (a CHECK holds for NULL, as in SQL)."""
    c = F.col(column)
    if kind == "not_null":
        return c.isNull()
    if kind == "max_len":
        return F.coalesce(F.length(c) > param, F.lit(False))
    if kind == "in":
        return F.coalesce(~c.isin(*param), F.lit(False))
    if kind == "gt":
        return F.coalesce(c <= param, F.lit(False))
    if kind == "ge":
        return F.coalesce(c < param, F.lit(False))
    if kind == "pct":
        return F.coalesce((c <= 0) | (c > 100), F.lit(False))
    raise ValueError(kind)


def _rule_name(column, kind, param):
    if kind in ("max_len", "gt", "ge"):
        return f"{column}:{kind}:{param}"
    return f"{column}:{kind}"


def constraint_report(tables: dict[str, DataFrame], rules=RULES) -> DataFrame:
    """Q1: violations per rule, one aggregate pass per table, as (tabela, regra, violacoes)."""
    out = None
    for name, df in tables.items():
        mine = [r for r in rules if r[0] == name]
        if not mine:
            continue
        counts = df.agg(*[F.count_if(violation(c, k, p)).alias(f"_r{i}") for i, (_, c, k, p) in enumerate(mine)])
        rows = F.array(*[F.struct(F.lit(name).alias("tabela"), F.lit(_rule_name(c, k, p)).alias("regra"),
                                  F.col(f"_r{i}").alias("violacoes")) for i, (_, c, k, p) in enumerate(mine)])
        part = counts.select(F.explode(rows).alias("_x")).select("_x.*")
        out = part if out is None else out.unionByName(part)
    return out


def violating_rows(name: str, df: DataFrame, key: str, rules=RULES) -> DataFrame:
    """Q1: the offending rows of one table, one row per (key, broken rule)."""
    mine = [r for r in rules if r[0] == name]
    tags = F.array(*[F.when(violation(c, k, p), F.lit(_rule_name(c, k, p))) for _, c, k, p in mine])
    return (df.select(key, F.explode(F.array_compact(tags)).alias("regra")))


def key_report(tables: dict[str, DataFrame], keys=KEYS) -> DataFrame:
    """Q2: per declared key, the number of key values that repeat and the rows involved."""
    out = None
    for name, cols in keys:
        if name not in tables:
            continue
        dup = (tables[name].groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
               .agg(F.count(F.lit(1)).alias("chaves_duplicadas"),
                    F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("linhas_em_duplicidade")))
        part = dup.select(F.lit(name).alias("tabela"), F.lit(",".join(cols)).alias("chave"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def orphan_report(tables: dict[str, DataFrame], fks=FOREIGN_KEYS) -> DataFrame:
    """Rows whose foreign key has no parent (left-anti join per key)."""
    out = None
    for child, col, parent in fks:
        if child not in tables or parent not in tables:
            continue
        pkey = dict(KEYS)[parent][0]
        orphans = (tables[child].select(col).where(F.col(col).isNotNull())
                   .join(tables[parent].select(F.col(pkey).alias(col)), col, "left_anti")
                   .agg(F.count(F.lit(1)).alias("orfaos")))
        part = orphans.select(F.lit(child).alias("tabela"), F.lit(col).alias("coluna"),
                              F.lit(parent).alias("referencia"), "orfaos")
        out = part if out is None else out.unionByName(part)
    return out


def header_vs_lines(pedidos: DataFrame, itens: DataFrame) -> DataFrame:
    """Q4: orders whose recorded value differs from the sum of their lines (> 0.01),
    orders without lines, and all orders."""
    sums = itens.groupBy("id_pedido").agg(F.sum("subtotal").alias("_s"))
    j = pedidos.select("id_pedido", "valor_total").join(sums, "id_pedido", "left")
    return j.agg(F.count_if(F.col("_s").isNotNull() & (F.abs(F.col("valor_total") - F.col("_s")) > dec("0.01")))
                 .alias("divergentes"),
                 F.count_if(F.col("_s").isNull()).alias("sem_itens"),
                 F.count(F.lit(1)).alias("total_pedidos"))
