"""Product revenue, margin rankings and seasonality (PR1-PR8).

Plan shape: filter orders first (status, period), semi-join the order lines
to them on ``id_pedido``, aggregate per product (partial aggregation before
the shuffle), and only then join the product attributes -- the product
dimension meets one row per product, not one per line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions.dates import months_before, ref_column
from orderlens.functions.numeric import TOTAL, WIDE, cents, pct_of, ratio_pct, rhu_div
from orderlens.functions.predicates import not_cancelled

# Share of the mean sale price used as a cost estimate, and the
# seasonality bands (peak above 1.2x, valley below 0.8x the monthly mean).
CUSTO_ESTIMADO_FRACAO = 65  # percent
PICO, VALE = 12, 8  # tenths


def _orders(pedidos: DataFrame, since=None) -> DataFrame:
    o = pedidos.where(not_cancelled())
    if since is not None:
        o = o.where(F.col("data_pedido") >= since)
    return o.select("id_pedido")


def _line_value():
    return F.col("quantidade") * F.col("preco_unitario")


def distinct_orders(approx: bool = False):
    """A3: distinct orders -- exact by default; ``approx`` uses a HyperLogLog++ sketch
    (``approx_count_distinct``, about 5 % relative error), which merges partial
    sketches instead of shuffling every (group, order) pair."""
    return F.approx_count_distinct("id_pedido") if approx else F.count_distinct("id_pedido")


def _per_product(itens: DataFrame, orders: DataFrame, approx: bool = False) -> DataFrame:
    return (itens.join(orders, "id_pedido")
            .groupBy("id_produto")
            .agg(F.sum(_line_value()).alias("_tv"),
                 F.sum("quantidade").alias("_vol"),
                 distinct_orders(approx).alias("total_contratos")))


def product_revenue(itens: DataFrame, pedidos: DataFrame, produtos: DataFrame, ref_date=None,
                    months: int = 12) -> DataFrame:
    """PR1: revenue per product over the last ``months`` months (non-cancelled)."""
    ref = ref_column(pedidos, ref_date)
    per = (itens.join(_orders(pedidos, months_before(ref, months)), "id_pedido")
           .groupBy("id_produto").agg(F.sum(_line_value()).alias("_tv")))
    return (per.join(produtos.select("id_produto", "nome"), "id_produto")
            .select("id_produto", "nome", F.round("_tv", 2).cast("double").alias("total_vendas")))


def top_products_pct(revenue: DataFrame, k: int = 5, digits: int = 0) -> DataFrame:
    """PR2: top-k of PR1 with percent of the maximum (Python half-even rounding)."""
    top = revenue.orderBy(F.col("total_vendas").desc(), F.col("id_produto").asc()).limit(k)
    top = top.withColumn("_max", F.max("total_vendas").over(Window.partitionBy()))  # over k rows
    return top.select(
        "id_produto", "nome", "total_vendas",
        pct_of(F.col("total_vendas").cast(TOTAL), F.col("_max").cast(TOTAL), digits)
        .alias("percentual")).orderBy(F.col("total_vendas").desc(), "id_produto")


def margin_ranking(itens: DataFrame, pedidos: DataFrame, produtos: DataFrame, ref_date=None,
                   k: int = 10, months: int = 12, approx_distinct: bool = False) -> DataFrame:
    """PR3: top-k products by revenue with margin.

    Cost per unit = reference cost, else 65 % of the product's mean sale price
    over all its lines (any status, any date), else 0.  The estimate is a
    rational S/N, so the cost total is carried as numerator / denominator and
    every rounding is an exact integer quotient.
    """
    ref = ref_column(pedidos, ref_date)
    per = _per_product(itens, _orders(pedidos, months_before(ref, months)), approx_distinct)
    mean_price = itens.groupBy("id_produto").agg(F.sum("preco_unitario").alias("_s"),
                                                 F.count(F.lit(1)).alias("_n"))
    p = produtos.select("id_produto", "nome", "categoria", "subcategoria", "custo_referencia")
    j = per.join(mean_price, "id_produto").join(p, "id_produto")
    vol_c, tv_c = cents(F.col("_vol")), cents(F.col("_tv"))
    cr = F.col("custo_referencia")
    tc_num = (F.when(cr.isNotNull(), vol_c * cents(cr))
              .when(F.col("_n") > 0, vol_c * cents(F.col("_s")) * CUSTO_ESTIMADO_FRACAO)
              .otherwise(F.lit(0)).cast(WIDE))
    den = (F.when(cr.isNotNull(), F.lit(100))
           .when(F.col("_n") > 0, F.col("_n") * 10000)
           .otherwise(F.lit(1)).cast(WIDE))
    margin_num = tv_c * den - tc_num
    out = j.select(
        "id_produto", "nome",
        F.coalesce("categoria", F.lit("Outros")).alias("categoria"),
        F.coalesce("subcategoria", "categoria", F.lit("Outros")).alias("subcategoria"),
        F.col("_tv").cast(TOTAL).alias("_tv2"),
        (rhu_div(tc_num, den) / 100.0).alias("total_custo"),
        (rhu_div(margin_num, den) / 100.0).alias("margem_bruta"),
        F.when(F.col("_tv") > 0, rhu_div(margin_num * 1000, den * tv_c) / 10.0)
         .otherwise(F.lit(0.0)).alias("margem_pct"),
        rhu_div(vol_c, F.lit(100)).cast("int").alias("volume_total"),
        "total_contratos")
    top = out.orderBy(F.col("_tv2").desc(), F.col("id_produto").asc()).limit(k)
    top = top.withColumn("_max", F.max("_tv2").over(Window.partitionBy()))  # over k rows
    return top.select(
        "id_produto", "nome", "categoria", "subcategoria",
        F.col("_tv2").cast("double").alias("total_vendas"), "total_custo", "margem_bruta", "margem_pct",
        "volume_total", "total_contratos",
        pct_of(F.col("_tv2"), F.col("_max"), 1).alias("percentual")).orderBy(F.col("total_vendas").desc(), "id_produto")


def margin_top(itens: DataFrame, pedidos: DataFrame, produtos: DataFrame, ref_date=None,
               k: int = 5, months: int = 12) -> DataFrame:
    """PR4: top-k by revenue; missing reference cost counts as 0; margin at 2 dp.

    Lines are summed per product and order first, so that a product's orders are its rows; the cost of a unit is constant per
    product and meets the sums, not the lines."""
    ref = ref_column(pedidos, ref_date)
    orders = _orders(pedidos, months_before(ref, months))
    p = produtos.select("id_produto", "nome", "categoria", "subcategoria",
                        F.coalesce("custo_referencia", F.lit(0).cast("decimal(12,2)")).alias("_c"))
    baskets = (itens.join(orders, "id_pedido").groupBy("id_produto", "id_pedido")
               .agg(F.sum(_line_value()).alias("_tv"), F.sum("quantidade").alias("_vol")))
    agg = (baskets.groupBy("id_produto").agg(F.sum("_tv").alias("_tv"), F.sum("_vol").alias("_vol"), F.count(F.lit(1)).alias("total_contratos"))
           .join(p, "id_produto").withColumn("_tc", F.col("_vol") * F.col("_c")))
    top = agg.orderBy(F.col("_tv").desc(), F.col("id_produto").asc()).limit(k)
    return top.select(
        "id_produto", "nome", "categoria", "subcategoria",
        F.round("_tv", 2).cast("double").alias("total_vendas"),
        F.round("_tc", 2).cast("double").alias("total_custo"),
        F.round(F.col("_tv") - F.col("_tc"), 2).cast("double").alias("margem_bruta"),
        F.when(F.col("_tv") > 0, ratio_pct(F.col("_tv") - F.col("_tc"), F.col("_tv"), 2))
         .otherwise(F.lit(0.0)).alias("margem_pct"),
        F.round("_vol", 2).cast("double").alias("volume_total"),
        "total_contratos").orderBy(F.col("total_vendas").desc(), "id_produto")


def top_share_of_total(itens: DataFrame, pedidos: DataFrame, produtos: DataFrame, ref_date=None,
                       k: int = 5, months: int = 12, approx_distinct: bool = False) -> DataFrame:
    """PR5: top-k products with their share of *all* products' revenue (total taken before the limit)."""
    ref = ref_column(pedidos, ref_date)
    agg = _per_product(itens, _orders(pedidos, months_before(ref, months)), approx_distinct)
    total = agg.agg(F.sum("_tv")).scalar()  # share of all products, taken before the limit
    top = agg.orderBy(F.col("_tv").desc(), F.col("id_produto").asc()).limit(k).withColumn("_all", total)
    return (top
            .join(produtos.select("id_produto", "nome", "categoria"), "id_produto")
            .select("id_produto", "nome", "categoria",
                    F.col("_tv").cast("double").alias("total_vendas"),
                    F.col("_vol").cast("double").alias("volume_total"),
                    "total_contratos",
                    ratio_pct(F.col("_tv"), F.col("_all"), 2).alias("percentual"))
            .orderBy(F.col("total_vendas").desc(), "id_produto"))


def product_kpis(ranking: DataFrame) -> DataFrame:
    """PR6: KPIs over the margin ranking: revenue, unweighted mean margin %, volume,
    orders (a sum of per-product distinct counts, so shared orders repeat)."""
    return ranking.agg(
        F.sum(F.col("total_vendas").cast(TOTAL)).cast("double").alias("receita_total"),
        (rhu_div(F.sum(F.round(F.col("margem_pct") * 10).cast("long")), F.count(F.lit(1))) / 10.0).alias("margem_media"),
        F.sum("volume_total").cast("long").alias("volume_total"),
        F.sum("total_contratos").alias("contratos"))


def top_revenue_all_time(itens: DataFrame, pedidos: DataFrame, produtos: DataFrame, k: int = 3) -> DataFrame:
    """PR7: top-k products by all-time revenue (non-cancelled), revenue rounded to units."""
    agg = (itens.join(_orders(pedidos), "id_pedido")
           .groupBy("id_produto").agg(F.sum(_line_value()).alias("_tv")))
    top = agg.orderBy(F.col("_tv").desc(), F.col("id_produto").asc()).limit(k)
    return top.join(produtos.select("id_produto", "nome"), "id_produto").select(
        "id_produto", "nome", F.round("_tv", 0).cast("long").alias("receita")).orderBy(F.col("receita").desc(), "id_produto")


def seasonality(itens: DataFrame, pedidos: DataFrame, produtos: DataFrame,
                categoria: str = "Commodity") -> DataFrame:
    """PR8: revenue per subcategory and calendar month against the subcategory's
    monthly mean: deviation % and PICO (> 1.2x) / VALE (< 0.8x) / Normal."""
    orders = pedidos.where(not_cancelled()).select("id_pedido", F.month("data_pedido").alias("mes"),
                                                   F.date_format("data_pedido", "MMM").alias("mes_nome"))
    prods = produtos.where(F.col("categoria") == categoria).select("id_produto", "subcategoria")
    monthly = (itens.join(orders, "id_pedido").join(prods, "id_produto")
               .groupBy("subcategoria", "mes", "mes_nome")
               .agg(F.sum(_line_value()).alias("_r")))
    per_sub = Window.partitionBy("subcategoria")  # at most 12 rows per subcategory
    m = (monthly.withColumn("_s", F.sum("_r").over(per_sub))
         .withColumn("_k", F.count(F.lit(1)).over(per_sub)))
    r_k = F.col("_r") * F.col("_k")
    return m.select(
        "subcategoria", "mes", "mes_nome",
        F.round("_r", 2).cast("double").alias("receita_mes"),
        (rhu_div(cents(F.col("_s")), F.col("_k")) / 100.0).alias("media_mensal"),
        ratio_pct(r_k - F.col("_s"), F.col("_s"), 1).alias("desvio_pct"),
        F.when(r_k * 10 > F.col("_s") * PICO, "PICO")
         .when(r_k * 10 < F.col("_s") * VALE, "VALE")
         .otherwise("Normal").alias("sazonalidade"))
