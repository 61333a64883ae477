"""Shared purchases: participants, KPIs, the share generator, shared-order
creation from JSON owner lists, proportional values, ownership view (H1-H11).

The generator (H4) needs "a random other customer of the same region".
Customers are numbered in (region, id) order with the distributed ranking, so
a region is a contiguous range of row numbers; the partner is found by an
equi-join on a hashed position inside that range.  A region holding a third
of all customers costs nothing extra: nothing is collected per region.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.functions.numeric import MONEY, PCT_TYPE, dec
from orderlens.plans.ranking import with_global_row_number
from orderlens.plans.selection import first_fraction
from orderlens.session import checkpoint_dir

# Share of orders that become shared, partner share range in basis
# points of a percent (20.00 % .. 40.00 %), and the hash constants of the seeded choice.
FRACAO_COMPARTILHADA = 0.15
CO_MIN_BP, CO_SPAN_BP = 2000, 2001
HASH_MOD = 2147483648
HASH_A, HASH_C = 1103515245, 12345
HASH2_A, HASH2_C = 1664525, 1013904223


def _hash(col, a, c):
    return (col % HASH_MOD * a + c) % HASH_MOD


def share_value(total, pct):
    """valor_rateado = round(total * pct / 100, 2), exact decimal arithmetic."""
    return F.round(total * pct * dec("0.01"), 2).cast(MONEY)


def generate_shares(pedidos: DataFrame, clientes: DataFrame, fraction: float = FRACAO_COMPARTILHADA) -> DataFrame:
    """H4: the top ``fraction`` of orders by value (at least one) become shared between
    the ordering customer and one partner of the same region (any other customer when
    the region has no one else).  The partner takes 20-40 % (2 dp), the owner the rest;
    values are total * pct / 100 at 2 dp.  Choices are a seeded hash of the order id."""
    checkpoint_dir(pedidos.sparkSession)
    orders = pedidos.select("id_pedido", "id_cliente", "valor_total").checkpoint(eager=True)
    top = first_fraction(orders, [("valor_total", False), ("id_pedido", True)], fraction)
    ranked = with_global_row_number(clientes.select("id_cliente", "regiao"),
                                    [F.col("regiao").asc_nulls_first(), F.col("id_cliente").asc()],
                                    "_rn", total_name="_N")
    regions = ranked.groupBy("regiao").agg(F.min("_rn").alias("_start"), F.count(F.lit(1)).alias("_rcnt"))
    pos = ranked.join(regions, ranked.regiao.eqNullSafe(regions.regiao)).select(
        ranked.id_cliente, "_rn", "_N", "_start", "_rcnt")
    owners = top.join(pos, "id_cliente")
    h1 = _hash(F.col("id_pedido"), HASH_A, HASH_C)
    h2 = _hash(F.col("id_pedido"), HASH2_A, HASH2_C)
    rpos = F.col("_rn") - F.col("_start")
    partner_rn = (F.when(F.col("_rcnt") > 1,
                         F.col("_start") + (rpos + 1 + h1 % (F.col("_rcnt") - 1)) % F.col("_rcnt"))
                  .when(F.col("_N") > 1, (F.col("_rn") + h1 % (F.col("_N") - 1)) % F.col("_N") + 1))
    picks = owners.select("id_pedido", "id_cliente", "valor_total", partner_rn.alias("_prn"),
                          (F.lit(CO_MIN_BP) + h2 % CO_SPAN_BP).alias("_co_bp")).where(F.col("_prn").isNotNull())
    partners = picks.join(ranked.select(F.col("_rn").alias("_prn"), F.col("id_cliente").alias("_partner")), "_prn")
    co_pct = (F.col("_co_bp") * dec("0.01")).cast(PCT_TYPE)
    owner_pct = ((F.lit(10000) - F.col("_co_bp")) * dec("0.01")).cast(PCT_TYPE)
    owner_rows = partners.select("id_pedido", "id_cliente", owner_pct.alias("percentual_rateio"),
                                 share_value(F.col("valor_total"), owner_pct).alias("valor_rateado"))
    partner_rows = partners.select("id_pedido", F.col("_partner").alias("id_cliente"), co_pct.alias("percentual_rateio"),
                                   share_value(F.col("valor_total"), co_pct).alias("valor_rateado"))
    return owner_rows.unionByName(partner_rows)


def shared_participants(shares: DataFrame, pedidos: DataFrame, clientes: DataFrame) -> DataFrame:
    """Participants of each shared order with share, value and the number of
    participants of the order (an aggregate joined back, not a per-order window)."""
    n = shares.groupBy("id_pedido").agg(F.count(F.lit(1)).alias("total_participantes"))
    return (shares.join(pedidos.select("id_pedido", "data_pedido", "valor_total", "tipo_contrato", "status", "regiao_origem", "regiao_destino"), "id_pedido")
            .join(clientes.select("id_cliente", F.col("nome").alias("cliente_nome"), "tipo_cliente"), "id_cliente")
            .join(n, "id_pedido")
            .select("id_pedido", F.date_format("data_pedido", "yyyy-MM-dd").alias("data_pedido"),
                    F.col("valor_total").cast("double").alias("valor_total"), "id_cliente", "cliente_nome",
                    "tipo_cliente", F.col("percentual_rateio").cast("double").alias("percentual_rateio"),
                    F.col("valor_rateado").cast("double").alias("valor_rateado"), "total_participantes",
                    "tipo_contrato", "status", "regiao_origem", "regiao_destino"))


def sharing_kpis(shares: DataFrame, pedidos: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """Distinct shared orders and customers, and shared value.

    ``valor_total`` sums each shared order once; ``valor_total_legado`` reproduces
    the reference's sum over the order-participant join divided by 2 (right only
    for exactly two participants)."""
    j = shares.select("id_pedido", "id_cliente").join(pedidos.select("id_pedido", "valor_total"), "id_pedido")
    per_order = shares.select("id_pedido").distinct().join(pedidos.select("id_pedido", "valor_total"), "id_pedido")
    distinct = F.approx_count_distinct if approx_distinct else F.count_distinct
    once = per_order.agg(F.sum("valor_total").cast("double")).scalar()
    return j.agg(distinct("id_pedido").alias("total_pedidos"),
                 distinct("id_cliente").alias("total_clientes"),
                 (F.sum("valor_total") * dec("0.5")).cast("double").alias("valor_total_legado"),
                 F.first(once).alias("valor_total"))


def sharing_by_region(shares: DataFrame, clientes: DataFrame) -> DataFrame:
    """H3: per participant region, distinct shared orders and shared value."""
    return (shares.join(clientes.select("id_cliente", "regiao"), "id_cliente")
            .groupBy("regiao")
            .agg(F.count_distinct("id_pedido").alias("pedidos"),
                 F.sum("valor_rateado").cast("double").alias("valor")))


def share_check(shares: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """H7 / A5: orders with more than one participant and whether shares sum to 100 +- tolerance."""
    return (shares.groupBy("id_pedido")
            .agg(F.count(F.lit(1)).alias("_n"), F.round(F.sum("percentual_rateio"), 2).alias("_s"))
            .where(F.col("_n") > 1)
            .select("id_pedido", F.col("_s").cast("double").alias("soma_pct"),
                    (F.abs(F.col("_s") - 100) <= dec(tolerance)).alias("valido")))


def ownership_view(pedidos: DataFrame, clientes: DataFrame, coowners: DataFrame,
                   pct_col: str = "percentual_rateio") -> DataFrame:
    """Every order with COMPARTILHADO / INDIVIDUAL and the owner list text
    'name (pct%)' joined by ', ' (ordered by share descending, then customer id); the
    ordering customer's name when the order has no co-owners."""
    named = coowners.join(clientes.select("id_cliente", F.col("nome").alias("_n")), "id_cliente")
    owners = (named.groupBy("id_pedido")
              .agg(F.sort_array(F.collect_list(F.struct(
                  (-F.col(pct_col)).alias("_k"), F.col("id_cliente").alias("_id"),
                  F.concat(F.col("_n"), F.lit(" ("), F.col(pct_col).cast("string"), F.lit("%)")).alias("_t"))))
                   .alias("_l"))
              .select("id_pedido", F.array_join(F.col("_l._t"), ", ").alias("_owners")))
    return (pedidos.join(clientes.select("id_cliente", F.col("nome").alias("cliente_principal"), "tipo_cliente"),
                         "id_cliente")
            .join(owners, "id_pedido", "left")
            .select("id_pedido", F.date_format("data_pedido", "yyyy-MM-dd").alias("data_pedido"),
                    F.date_format("data_entrega", "yyyy-MM-dd").alias("data_entrega"),
                    F.col("valor_total").cast("double").alias("valor_total"), "status", "tipo_contrato",
                    "regiao_origem", "regiao_destino", "id_cliente", "cliente_principal", "tipo_cliente",
                    F.when(F.col("_owners").isNotNull(), "COMPARTILHADO").otherwise("INDIVIDUAL").alias("tipo_ownership"),
                    F.coalesce("_owners", "cliente_principal").alias("todos_proprietarios")))


def refresh_proportional_values(shares: DataFrame, before: DataFrame, after: DataFrame,
                                pct_col: str = "percentual_rateio", value_col: str = "valor_rateado") -> DataFrame:
    """H6 / ST3: recompute value = total * pct / 100 for the shares of orders whose
    total changed (IS DISTINCT FROM) between ``before`` and ``after``; others keep theirs."""
    changed = (after.select("id_pedido", F.col("valor_total").alias("_new"))
               .join(before.select("id_pedido", F.col("valor_total").alias("_old")), "id_pedido")
               .where(~F.col("_new").eqNullSafe(F.col("_old")))
               .select("id_pedido", "_new"))
    j = shares.join(changed, "id_pedido", "left")
    return j.withColumn(value_col, F.when(F.col("_new").isNotNull(), share_value(F.col("_new"), F.col(pct_col)))
                        .otherwise(F.col(value_col))).drop("_new").select(*shares.columns)


OWNER_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("cliente_id", T.LongType()), T.StructField("percentual", T.DecimalType(5, 2)),
    T.StructField("tipo", T.StringType())]))
ITEM_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("produto_id", T.LongType()), T.StructField("quantidade", T.DecimalType(12, 2)),
    T.StructField("preco_unitario", T.DecimalType(12, 2))]))


def create_shared_orders(requests: DataFrame, pedidos: DataFrame, request_lines: DataFrame | None = None):
    """H5: create shared orders from a batch of requests.

    ``requests``: (id_solicitacao, data_pedido, data_entrega, tipo_contrato,
    regiao_origem, regiao_destino, proprietarios JSON array of {cliente_id,
    percentual, tipo}, itens JSON array of {produto_id, quantidade, preco_unitario}).
    A request is rejected unless its owner shares sum to exactly 100 (malformed
    JSON, an empty list or a missing client id also reject it).  Accepted requests
    get new order ids after the orders' high-water mark (N1); the first owner is
    the holder; the order starts 'Pendente' and its value is the sum of its lines.
    Lines may instead come as a table ``request_lines`` (id_solicitacao, id_produto,
    quantidade, preco_unitario): then order values are a per-request aggregate and
    no request's lines are ever collected into one row.
    Returns (orders, co-owner rows, line rows, rejected requests with a reason).
    """
    parsed = (requests.withColumn("_own", F.from_json("proprietarios", OWNER_SCHEMA))
              .withColumn("_its", F.coalesce(F.from_json("itens", ITEM_SCHEMA), F.array().cast(ITEM_SCHEMA))))
    total_pct = F.aggregate(F.col("_own"), F.lit(0).cast("decimal(12,2)"),
                            lambda acc, o: (acc + F.coalesce(o["percentual"], F.lit(0).cast("decimal(5,2)")))
                            .cast("decimal(12,2)"))
    motive = (F.when(F.col("_own").isNull(), "JSON_INVALIDO")
              .when(F.size("_own") == 0, "SEM_PROPRIETARIOS")
              .when(F.exists("_own", lambda o: o["cliente_id"].isNull()), "CLIENTE_AUSENTE")
              .when(total_pct != 100, F.concat(F.lit("PERCENTUAL_"), total_pct.cast("string"))))
    checked = parsed.withColumn("_motivo", motive)
    rejected = checked.where(F.col("_motivo").isNotNull()).select("id_solicitacao", F.col("_motivo").alias("motivo"))
    ok = checked.where(F.col("_motivo").isNull())
    hw = pedidos.agg(F.coalesce(F.max("id_pedido"), F.lit(0)).cast("long")).scalar()
    numbered = (with_global_row_number(ok, [F.col("id_solicitacao").asc()], "_rn")
                .withColumn("id_pedido", hw + F.col("_rn")))
    line_value = lambda i: (i["quantidade"] * i["preco_unitario"]).cast(MONEY)
    if request_lines is not None:
        rl = request_lines.join(numbered.select("id_solicitacao", "id_pedido"), "id_solicitacao")
        sub = (F.col("quantidade").cast("decimal(12,2)") * F.col("preco_unitario").cast("decimal(12,2)")).cast(MONEY)
        lines = rl.select("id_pedido", "id_produto", F.col("quantidade").cast("decimal(12,2)").alias("quantidade"),
                          F.col("preco_unitario").cast("decimal(12,2)").alias("preco_unitario"), sub.alias("subtotal"))
        totals = lines.groupBy("id_pedido").agg(F.sum("subtotal").alias("_tot"))
        numbered = (numbered.join(totals, "id_pedido", "left")
                    .withColumn("_v", F.coalesce(F.col("_tot"), F.lit(0)).cast(MONEY)))
        valor = F.col("_v")
    else:
        valor = F.aggregate(F.col("_its"), F.lit(0).cast(MONEY), lambda acc, i: (acc + line_value(i)).cast(MONEY))
    orders = numbered.select(
        "id_pedido", F.col("data_pedido").cast("date"), F.col("data_entrega").cast("date"),
        F.col("_own")[0]["cliente_id"].alias("id_cliente"), "tipo_contrato",
        F.lit("Pendente").alias("status"), "regiao_origem", "regiao_destino", valor.alias("valor_total"))
    owners = (numbered.select("id_pedido", valor.alias("_v"), F.explode("_own").alias("_o"))
              .select("id_pedido", F.col("_o.cliente_id").alias("id_cliente"),
                      F.col("_o.percentual").alias("percentual_propriedade"),
                      share_value(F.col("_v"), F.col("_o.percentual")).alias("valor_proporcional"),
                      F.coalesce(F.col("_o.tipo"), F.lit("COMPRADOR")).alias("tipo_participacao")))
    if request_lines is None:
        lines = (numbered.select("id_pedido", F.posexplode("_its").alias("_pos", "_i"))
                 .select("id_pedido", F.col("_i.produto_id").alias("id_produto"),
                         F.col("_i.quantidade").alias("quantidade"), F.col("_i.preco_unitario").alias("preco_unitario"),
                         line_value(F.col("_i")).alias("subtotal")))
    return orders, owners, lines, rejected


def requests_from_shares(shares: DataFrame, pedidos: DataFrame, itens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Build creation requests (H5 input) from existing shared orders: one request per
    shared order with its owners as a JSON array (a few entries per order), and the
    request lines as a table (id_solicitacao = the source order)."""
    ordered = F.sort_array(F.collect_list(F.struct(
        (-F.col("percentual_rateio")).alias("_k"), F.col("id_cliente").alias("cliente_id"),
        F.col("percentual_rateio").alias("percentual"), F.lit("COMPRADOR").alias("tipo"))))
    own = shares.groupBy("id_pedido").agg(
        F.to_json(F.transform(ordered, lambda o: o.dropFields("_k"))).alias("proprietarios"))
    requests = (own.join(pedidos.select("id_pedido", "data_pedido", "data_entrega", "tipo_contrato",
                                        "regiao_origem", "regiao_destino"), "id_pedido")
                .withColumn("itens", F.lit(None).cast("string"))
                .withColumnRenamed("id_pedido", "id_solicitacao"))
    lines = (itens.join(shares.select("id_pedido").distinct(), "id_pedido", "left_semi")
             .select(F.col("id_pedido").alias("id_solicitacao"), "id_produto", "quantidade", "preco_unitario"))
    return requests, lines


def _in_parts(df: DataFrame, order: list[str], size: int, entry: F.Column, name: str) -> DataFrame:
    """(id_pedido, parte, partes, ``name``): each order's rows of ``df`` in ``order``, in lists of at most ``size``.

    Rows are numbered over all orders (X1), so that an order with a third of all rows is spread; a list is
    one part of an order, never an order."""
    numbered = with_global_row_number(df, [F.col("id_pedido").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]], "_rn")
    first = numbered.groupBy("id_pedido").agg(F.min("_rn").alias("_f"), F.count(F.lit(1)).alias("_n"))
    parts = F.call_function("div", F.col("_n") + (size - 1), F.lit(size))
    return (numbered.join(first, "id_pedido").withColumn("parte", F.call_function("div", F.col("_rn") - F.col("_f"), F.lit(size)))
            .groupBy("id_pedido", "parte", parts.alias("partes"))
            .agg(F.transform(F.sort_array(F.collect_list(F.struct("_rn", entry.alias("_e")))), lambda x: x["_e"]).alias(name)))


def order_documents(pedidos: DataFrame, coowners: DataFrame, itens: DataFrame, produtos: DataFrame,
                    max_items: int | None = None, clientes: DataFrame | None = None) -> DataFrame:
    """Nested documents for all orders at once: order fields, owners[] and items[].

    Owners come by share descending, then id, with their percent and value (and, given ``clientes``, name and type);
    lines by product id, price and quantity.  An order with more than ``max_items`` (10,000) owners or lines gets
    several parts (``parte`` 0..``partes``-1), each with the next of them in order, so no list
    holds more even when one order carries a third of all lines.
    """
    size = 10_000 if max_items is None else max_items
    owned = coowners.withColumn("_menos", -F.col("percentual_rateio"))
    fields = [F.col("id_cliente"), F.col("percentual_rateio").alias("percentual")]
    if "valor_rateado" in coowners.columns:
        fields.append(F.col("valor_rateado").alias("valor"))
    if clientes is not None:
        owned = owned.join(clientes.select("id_cliente", F.col("nome").alias("_nome"), F.col("tipo_cliente").alias("_tipo")), "id_cliente", "left")
        fields += [F.col("_nome").alias("nome"), F.col("_tipo").alias("tipo_cliente")]
    own = _in_parts(owned, ["_menos", "id_cliente"], size, F.struct(*fields), "proprietarios")
    named = itens.join(produtos.select("id_produto", F.col("nome").alias("produto_nome")), "id_produto")
    line = ["id_produto", "preco_unitario", "quantidade", "subtotal", *[c for c in ("id_item",) if c in itens.columns]]
    its = _in_parts(named, line, size, F.struct("id_produto", "produto_nome", "quantidade", "preco_unitario", "subtotal"), "itens")
    parts = own.withColumnRenamed("partes", "_po").join(its.withColumnRenamed("partes", "_pi"), ["id_pedido", "parte"], "full_outer")
    docs = pedidos.join(parts, "id_pedido", "left")
    return docs.select(
        "id_pedido", F.coalesce("parte", F.lit(0).cast("long")).alias("parte"),
        F.greatest(F.coalesce("_po", F.lit(1)), F.coalesce("_pi", F.lit(1))).cast("long").alias("partes"),
        "data_pedido", "id_cliente", "status", "valor_total",
        F.coalesce("proprietarios", F.array().cast(own.schema["proprietarios"].dataType)).alias("proprietarios"),
        F.coalesce("itens", F.array().cast(its.schema["itens"].dataType)).alias("itens"))


def active_groups(grupos: DataFrame, membros: DataFrame, clientes: DataFrame) -> DataFrame:
    """Active purchase groups with representative name and member count
    (inactive memberships counted too, as in the reference; COUNT -> 0 when none)."""
    counts = membros.groupBy("id_grupo").agg(F.count(F.lit(1)).alias("total_membros"))
    return (grupos.where(F.col("ativo") == F.lit(True))
            .join(clientes.select(F.col("id_cliente").alias("representante_id"), F.col("nome").alias("representante")),
                  "representante_id", "left")
            .join(counts, "id_grupo", "left")
            .withColumn("total_membros", F.coalesce("total_membros", F.lit(0))))


def group_members(membros: DataFrame, clientes: DataFrame, id_grupo: int) -> DataFrame:
    """Active members of one group, largest share first."""
    return (membros.where((F.col("id_grupo") == id_grupo) & (F.col("ativo") == F.lit(True)))
            .join(clientes.select("id_cliente", "nome", "tipo_cliente", "regiao"), "id_cliente")
            .select("id_cliente", "nome", "tipo_cliente", "regiao", "percentual_participacao", "data_entrada")
            .orderBy(F.col("percentual_participacao").desc(), F.col("id_cliente").asc()))
