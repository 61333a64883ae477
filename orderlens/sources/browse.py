"""Table browsing: projections, formatting, key order, result caps, search and
paging (S6-S10, S12, S14).  Browses return whole tables unless the caller asks for
the first ``limite`` rows; that is a top-k sort, where each task keeps its own k best.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions.predicates import in_closed_range, like_escape
from orderlens.plans.selection import Sort, after, ordering

PAGINA = 25


def _first(df: DataFrame, limite: int | None) -> DataFrame:
    return df if limite is None else df.limit(limite)


def data_page_customers(clientes: DataFrame, limite: int | None = None) -> DataFrame:
    """Customers by id."""
    return _first(clientes.select("id_cliente", "nome", "tipo_cliente", "regiao",
                            F.date_format("data_cadastro", "yyyy-MM-dd").alias("data_cadastro"),
                            F.col("limite_credito").cast("double").alias("limite_credito"))
            .orderBy("id_cliente"), limite)


def data_page_orders(pedidos: DataFrame, clientes: DataFrame, limite: int | None = None) -> DataFrame:
    """Orders, newest first by id, with customer name, value at 2 dp."""
    return _first(pedidos.join(clientes.select("id_cliente", F.col("nome").alias("cliente")), "id_cliente")
            .select("id_pedido", F.date_format("data_pedido", "dd/MM/yyyy").alias("data_pedido"), "cliente",
                    "status", "tipo_contrato", F.round("valor_total", 2).cast("double").alias("valor_total"),
                    "regiao_origem", "regiao_destino")
            .orderBy(F.col("id_pedido").desc()), limite)


def data_page_items(itens: DataFrame, produtos: DataFrame, limite: int | None = None) -> DataFrame:
    """Order lines, last first by id, with product name (needs id_item)."""
    return _first(itens.join(produtos.select("id_produto", F.col("nome").alias("produto")), "id_produto")
            .select("id_item", "id_pedido", "produto", F.col("quantidade").cast("double").alias("quantidade"),
                    F.coalesce(F.round("preco_unitario", 2), F.lit(0)).cast("double").alias("preco_unitario"),
                    F.coalesce(F.round("subtotal", 2), F.lit(0)).cast("double").alias("subtotal"))
            .orderBy(F.col("id_item").desc()), limite)


def data_page_products(produtos: DataFrame, limite: int | None = None) -> DataFrame:
    """Products by id."""
    return _first(produtos.select("id_produto", "nome", "categoria", "subcategoria", "unidade",
                                  F.col("preco_unitario").cast("double").alias("preco_unitario"))
                  .orderBy("id_produto"), limite)


def customer_browse(clientes: DataFrame) -> DataFrame:
    """All customers, credit limit defaulting to 0, date as dd/MM/yyyy, by id."""
    return (clientes.select("id_cliente", "nome", "tipo_cliente", "regiao", "estado",
                            F.date_format("data_cadastro", "dd/MM/yyyy").alias("data_cadastro"),
                            F.coalesce("limite_credito", F.lit(0)).cast("double").alias("limite_credito"))
            .orderBy("id_cliente"))


def product_browse(produtos: DataFrame) -> DataFrame:
    """All products, price defaulting to 0, by id."""
    return (produtos.select("id_produto", "nome", "categoria", "subcategoria", "unidade",
                            F.coalesce("preco_unitario", F.lit(0)).cast("double").alias("preco_unitario"))
            .orderBy("id_produto"))


def order_browse(pedidos: DataFrame, clientes: DataFrame, inicio=None, fim=None) -> DataFrame:
    """Orders with optional inclusive date bounds, newest first."""
    o = pedidos.where(in_closed_range("data_pedido", inicio, fim))
    return (o.join(clientes.select("id_cliente", F.col("nome").alias("cliente_nome")), "id_cliente")
            .select("id_pedido", F.date_format("data_pedido", "dd/MM/yyyy").alias("data_pedido"),
                    F.date_format("data_entrega", "dd/MM/yyyy").alias("data_entrega"), "cliente_nome",
                    "tipo_contrato", "status", F.coalesce("valor_total", F.lit(0)).cast("double").alias("valor_total"),
                    "regiao_origem", "regiao_destino", F.col("data_pedido").alias("_d"))
            .orderBy(F.col("_d").desc(), F.col("id_pedido").desc()).drop("_d"))


def search_page(df: DataFrame, term: str | None, columns: list[str], sort: list, page: int = 1,
                size: int = PAGINA) -> DataFrame:
    """Rows where any of ``columns`` contains ``term`` (case-insensitive), stably
    sorted by ``sort`` (end it with a unique key), page ``page`` of ``size`` rows.  For a jump to a page: each task
    keeps the rows of all pages before it (``next_page`` doesn't)."""
    return _matching(df, term, columns).orderBy(*sort).offset((page - 1) * size).limit(size)


def _matching(df: DataFrame, term: str | None, columns: list[str]) -> DataFrame:
    if not term:
        return df
    t = term.lower()
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.coalesce(F.lower(F.col(c).cast("string")).contains(t), F.lit(False))
    return df.where(cond)


def next_page(df: DataFrame, term: str | None, columns: list[str], sort: Sort, last: dict | None = None, size: int = PAGINA) -> DataFrame:
    """S12 by keyset: the ``size`` rows after the row whose sort columns are ``last`` (None: the first page).

    ``sort`` lists (column, ascending) and ends with a unique column, so pages join up without gaps or repeats under equal
    names and NULLs.  The seek predicate is a filter below the top-k, so that any page costs one
    page per task, and rows inserted before it don't shift it."""
    rows = _matching(df, term, columns)
    if last is not None:
        types = {f.name: f.dataType.simpleString() for f in df.select(*[c for c, _ in sort]).schema}
        rows = rows.where(after(sort, last, types))
    return rows.orderBy(*ordering(sort)).limit(size)


def customer_pick_list(clientes: DataFrame) -> DataFrame:
    """Id, name, type and region ordered by name (then id)."""
    return clientes.select("id_cliente", "nome", "tipo_cliente", "regiao").orderBy("nome", "id_cliente")


def like_contains(col: str, term: str) -> F.Column:
    """LOWER(col) LIKE LOWER('%term%') with the term taken literally."""
    return F.lower(F.col(col)).like("%" + like_escape(term.lower()) + "%")
