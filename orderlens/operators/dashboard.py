"""Dashboard, summary and exploration.

The filtered dashboard (B1, B1b, B1c) builds one filtered order set and the
three outputs read it; the product filter is a left-semi join (EXISTS) of
the orders to the lines of matching products, never a per-order lookup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions.dates import days_before, ref_column
from orderlens.functions.numeric import avg_money, cents, money_millions_text, pct_of, rhe_div, rhu_div
from orderlens.functions.predicates import not_cancelled, region_filter
from orderlens.operators.rfv import SEGMENTOS, segment_fixed
from orderlens.plans.ranking import with_position
from orderlens.plans.stats import correlation_matrix, grouped_box, strongest_off_diagonal

# Value histogram bins (lower, upper inclusive), as labelled on the page.
FAIXAS = [("0-10k", None, 9999.99), ("10-50k", 10000, 49999), ("50-100k", 50000, 99999),
          ("100-500k", 100000, 499999), ("500k+", 500000, None)]
# Correlation strength labels.
FORTE, MODERADA = 0.8, 0.5


def headline_metrics(pedidos: DataFrame, clientes: DataFrame) -> DataFrame:
    """Revenue, mean ticket, orders (non-cancelled) and customers, plus money text."""
    n_clientes = clientes.agg(F.count(F.lit(1))).scalar()
    o = pedidos.where(not_cancelled()).agg(F.count(F.lit(1)).alias("contratos"),
                                           F.coalesce(F.sum("valor_total"), F.lit(0)).alias("_v"))
    return o.select(
        F.col("_v").cast("double").alias("faturamento"),
        avg_money(F.col("_v"), F.col("contratos")).alias("ticket_medio"),
        "contratos", n_clientes.alias("clientes"),
        money_millions_text(F.col("_v")).alias("faturamento_texto"),
        F.concat(F.lit("R$ "), F.translate(F.format_number(
            F.coalesce(rhe_div(cents(F.col("_v")), F.col("contratos") * 100), F.lit(0)), 0), ",", "."))
        .alias("ticket_texto"))


def filtered_orders(pedidos: DataFrame, clientes: DataFrame, itens: DataFrame, produtos: DataFrame,
                    ref_date=None, periodo: int = 365, regiao: str | None = None,
                    produto: str | None = None, region_column: str = "regiao") -> DataFrame:
    """P2 + P3 + P6 + P7: non-cancelled orders of the last ``periodo`` days (anchored on
    the data), optionally of one customer region (compared with ``region_column`` of the
    customer, e.g. ``estado`` for state codes), optionally having a line whose product
    subcategory contains ``produto`` (case-insensitive)."""
    ref = ref_column(pedidos, ref_date)
    o = pedidos.where(not_cancelled() & (F.col("data_pedido") >= days_before(ref, periodo)))
    o = o.join(clientes.select("id_cliente", F.col(region_column).alias("_regiao_filtro")), "id_cliente")
    o = region_filter(o, regiao, "_regiao_filtro").drop("_regiao_filtro")
    if produto and produto.lower() != "todos":
        prods = produtos.where(F.lower("subcategoria").contains(produto.lower())).select("id_produto")
        matching = itens.join(prods, "id_produto", "left_semi").select("id_pedido")
        o = o.join(matching, "id_pedido", "left_semi")
    return o


def dashboard_kpis(orders: DataFrame, clientes: DataFrame) -> DataFrame:
    """B1: KPIs of the filtered orders; the customer count stays unfiltered."""
    n_clientes = clientes.agg(F.count(F.lit(1))).scalar()
    a = orders.agg(F.count(F.lit(1)).alias("contratos"), F.sum("valor_total").alias("_v"))
    return a.select(
        "contratos",
        F.coalesce(F.col("_v"), F.lit(0)).cast("double").alias("faturamento"),
        F.coalesce(avg_money(F.col("_v"), F.col("contratos")), F.lit(0.0)).alias("ticket_medio"),
        n_clientes.alias("clientes"))


def dashboard_top_products(orders: DataFrame, itens: DataFrame, produtos: DataFrame, k: int = 4) -> DataFrame:
    """Top-k products of the filtered orders (all their lines) with percent of the maximum."""
    agg = (itens.join(orders.select("id_pedido"), "id_pedido")
           .groupBy("id_produto").agg(F.sum(F.col("quantidade") * F.col("preco_unitario")).alias("_v")))
    top = agg.orderBy(F.col("_v").desc(), F.col("id_produto").asc()).limit(k)
    top = top.withColumn("_m", F.max("_v").over(Window.partitionBy()))  # over k rows
    return (top
            .join(produtos.select("id_produto", "nome"), "id_produto")
            .select("id_produto", "nome", F.col("_v").cast("double").alias("total_vendas"),
                    pct_of(F.col("_v"), F.col("_m"), 1).alias("percentual"))
            .orderBy(F.col("total_vendas").desc(), "id_produto"))


def dashboard_monthly(orders: DataFrame, legacy: bool = True) -> DataFrame:
    """Monthly evolution of the filtered orders.

    ``legacy=True`` groups by month number, so years merge, and computes growth
    on sales already rounded to 0.01 million (first month 0).  Otherwise the
    months are chronological (year-month).
    """
    key = F.month("data_pedido") if legacy else F.trunc("data_pedido", "month")
    m = (orders.groupBy(key.alias("_k"))
         .agg(F.sum("valor_total").alias("_v"), F.count(F.lit(1)).alias("contratos_mes"),
              F.min("data_pedido").alias("_d")))
    w = Window.orderBy("_k")  # at most 12 (legacy) or one row per month
    m = m.withColumn("_mi", rhe_div(cents(F.col("_v")), F.lit(10 ** 6)))  # hundredths of a million, half-even
    m = m.withColumn("_prev", F.lag("_mi").over(w))
    mi, prev = F.col("_mi"), F.col("_prev")
    growth = F.when(prev.isNull() | (prev == 0), F.lit(0.0)).otherwise(rhe_div((mi - prev) * 1000, prev) / 10.0)
    return m.select(F.date_format("_d", "MMM").alias("mes_abr"),
                    (F.col("_k") if legacy else F.date_format("_k", "yyyy-MM")).alias("mes"),
                    F.col("_v").cast("double").alias("vendas"), "contratos_mes",
                    (mi / 100.0).alias("vendas_milhoes"), growth.alias("crescimento"))


def value_histogram(pedidos: DataFrame, ref_date=None, periodo: int = 365, hole_free: bool = False) -> DataFrame:
    """B2: order values in fixed bins.  The reference's inclusive integer bounds leave
    cent-wide holes (49,999.50 falls in no bin); ``hole_free`` uses half-open bins."""
    ref = ref_column(pedidos, ref_date)
    v = F.col("valor_total")
    o = pedidos.where(not_cancelled() & (F.col("data_pedido") >= days_before(ref, periodo)))
    conds = []
    for i, (label, lo, hi) in enumerate(FAIXAS):
        if hole_free:
            c = F.lit(True)
            if lo is not None:
                c = c & (v >= lo)
            if i + 1 < len(FAIXAS):
                c = c & (v < FAIXAS[i + 1][1])
        else:
            c = F.lit(True)
            if lo is not None:
                c = c & ((v >= lo) if hi is None else v.between(lo, hi))
            if lo is None:
                c = v < 10000
        conds.append(F.count_if(c).alias(f"c{i}"))
    counts = o.agg(*conds)
    stack = F.array(*[F.struct(F.lit(i).alias("ordem"), F.lit(label).alias("faixa"),
                               F.col(f"c{i}").alias("contagem")) for i, (label, _, _) in enumerate(FAIXAS)])
    return counts.select(F.explode(stack).alias("_f")).select("_f.*")


def period_customer_metrics(pedidos: DataFrame, ref_date=None, periodo: int = 365) -> DataFrame:
    """Per customer inside the period: value, orders, mean ticket (cents), recency."""
    ref = ref_column(pedidos, ref_date)
    o = pedidos.where(not_cancelled() & (F.col("data_pedido") >= days_before(ref, periodo)))
    return (o.groupBy("id_cliente")
            .agg(F.sum("valor_total").alias("valor_total"), F.count(F.lit(1)).alias("qtd_pedidos"),
                 F.max("data_pedido").alias("_u"))
            .withColumn("ticket_cents", rhu_div(cents(F.col("valor_total")), F.col("qtd_pedidos")))
            .withColumn("dias_inativo", F.datediff(ref, F.col("_u"))))


def ticket_box_by_segment(pedidos: DataFrame, ref_date=None, periodo: int = 365) -> DataFrame:
    """Box summary of the mean ticket per fixed-threshold segment, where
    frequency and recency are also counted inside the period; domain order (T6)."""
    m = period_customer_metrics(pedidos, ref_date, periodo)
    m = m.select("id_cliente", (F.col("ticket_cents") / 100.0).alias("ticket_medio"),
                 segment_fixed(F.col("dias_inativo"), F.col("qtd_pedidos")).alias("segmento"))
    box = grouped_box(m, ["segmento"], "ticket_medio", "id_cliente")
    order = F.array_position(F.array(*[F.lit(s) for s in SEGMENTOS]), F.col("segmento")).cast("int")
    return box.withColumn("ordem", order)


def items_value_sample(pedidos: DataFrame, itens: DataFrame, ref_date=None, periodo: int = 365,
                       n: int = 300, seed: int = 12345) -> DataFrame:
    """Order value vs line count for ``n`` orders in a seeded pseudo-random order
    (a hash of the order id), so the sample is repeatable."""
    ref = ref_column(pedidos, ref_date)
    o = pedidos.where(not_cancelled() & (F.col("data_pedido") >= days_before(ref, periodo)))
    per = (o.select("id_pedido", "valor_total")
           .join(itens.groupBy("id_pedido").agg(F.count(F.lit(1)).alias("qtd_itens")), "id_pedido"))
    h = (F.col("id_pedido") % 2147483648 * 1103515245 + seed) % 2147483648
    return (per.orderBy(h, F.col("id_pedido")).limit(n)
            .select("id_pedido", F.col("valor_total").cast("double").alias("valor_total"), "qtd_itens"))


CORR_COLS = ["valor_total", "qtd_pedidos", "ticket_cents", "dias_inativo"]


def customer_correlations(pedidos: DataFrame, ref_date=None, periodo: int = 365) -> DataFrame:
    """Correlation matrix of value, orders, ticket and idle days per customer."""
    m = period_customer_metrics(pedidos, ref_date, periodo)
    return correlation_matrix(m, CORR_COLS, scale={"valor_total": 2})


def exploration_kpis(pedidos: DataFrame, ref_date=None, periodo: int = 365) -> DataFrame:
    """Order count and ticket (all non-cancelled orders, not period-limited),
    outliers above mean + 2 sample standard deviations (J9 scalar threshold), and the
    strongest correlation of B5 with its strength label."""
    o = pedidos.where(not_cancelled())
    base = o.agg(F.count(F.lit(1)).alias("total_pedidos"), F.sum("valor_total").alias("_v"),
                 F.avg(F.col("valor_total").cast("double")).alias("_mu"),
                 F.stddev_samp(F.col("valor_total").cast("double")).alias("_sd"))
    threshold = base.select(F.col("_mu") + F.col("_sd") * 2).scalar()  # J9: scalar subquery
    outliers = o.agg(F.count_if(F.col("valor_total").cast("double") > threshold)).scalar()
    strongest = strongest_off_diagonal(customer_correlations(pedidos, ref_date, periodo)).scalar()
    r = F.abs(F.col("correlacao_principal"))
    return (base.select("total_pedidos", "_v", outliers.alias("total_outliers"),
                        strongest.alias("correlacao_principal"))
            .select("total_pedidos", avg_money(F.col("_v"), F.col("total_pedidos")).alias("ticket_medio"),
                    "total_outliers", "correlacao_principal",
                    F.when(r >= FORTE, "Forte").when(r >= MODERADA, "Moderada").otherwise("Fraca").alias("forca")))


def summary_totals(pedidos: DataFrame, clientes: DataFrame, produtos: DataFrame) -> DataFrame:
    """Totals of customers, products, orders (all) and non-cancelled revenue."""
    n_clientes = clientes.agg(F.count(F.lit(1))).scalar()
    n_produtos = produtos.agg(F.count(F.lit(1))).scalar()
    return pedidos.agg(F.first(n_clientes).alias("total_clientes"), F.first(n_produtos).alias("total_produtos"),
                       F.count(F.lit(1)).alias("total_pedidos"),
                       F.coalesce(F.sum(F.when(not_cancelled(), F.col("valor_total"))), F.lit(0))
                       .cast("double").alias("faturamento_total"))


def orders_by_status(pedidos: DataFrame) -> DataFrame:
    """Orders per status."""
    return pedidos.groupBy("status").agg(F.count(F.lit(1)).alias("total"))


def top_customers_by_value(pedidos: DataFrame, clientes: DataFrame, k: int = 10) -> DataFrame:
    """Top-k customers by non-cancelled value."""
    agg = pedidos.where(not_cancelled()).groupBy("id_cliente").agg(F.sum("valor_total").alias("_v"))
    top = agg.orderBy(F.col("_v").desc(), F.col("id_cliente").asc()).limit(k)
    out = top.join(clientes.select("id_cliente", "nome"), "id_cliente").select(
        "id_cliente", "nome", F.col("_v").cast("double").alias("total"))
    return with_position(out, [F.col("total").desc(), F.col("id_cliente").asc()]).orderBy("posicao")


def context_snapshot(pedidos: DataFrame, clientes: DataFrame, itens: DataFrame, produtos: DataFrame,
                     ref_date=None) -> DataFrame:
    """Metrics, top products and segment counts as one long table (secao, item, valor)."""
    from orderlens.operators.products import top_revenue_all_time
    from orderlens.operators.rfv import segment_counts
    m = headline_metrics(pedidos, clientes)
    metrics = m.select(F.explode(F.array(
        F.struct(F.lit("faturamento").alias("item"), F.col("faturamento").alias("valor")),
        F.struct(F.lit("ticket_medio").alias("item"), F.col("ticket_medio").alias("valor")),
        F.struct(F.lit("contratos").alias("item"), F.col("contratos").cast("double").alias("valor")),
        F.struct(F.lit("clientes").alias("item"), F.col("clientes").cast("double").alias("valor")))).alias("_m")
    ).select(F.lit("metricas").alias("secao"), "_m.item", "_m.valor")
    prods = top_revenue_all_time(itens, pedidos, produtos, 3).select(
        F.lit("produtos").alias("secao"), F.col("nome").alias("item"), F.col("receita").cast("double").alias("valor"))
    segs = segment_counts(pedidos, ref_date).select(
        F.lit("segmentos").alias("secao"), F.col("segmento").alias("item"), F.col("clientes").cast("double").alias("valor"))
    return metrics.unionByName(prods).unionByName(segs)
