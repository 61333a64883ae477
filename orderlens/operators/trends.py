"""Monthly sales trends (TR1-TR9, W2, W4-W6, A12).

The heavy step is one aggregate of the orders by calendar month (partial
aggregation, then a shuffle of at most one row per month per task).  The
windows after it (LAG, running sums) run over the monthly table, whose size is
bounded by the calendar, not by the data -- a single ordered partition there
is a few hundred rows at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions.dates import MONTHS_PT, month_label_pt, ref_column, start_of_previous_year
from orderlens.functions.numeric import TOTAL, avg_money, cents, ratio_pct, rhu_div
from orderlens.functions.predicates import not_cancelled

# Trend direction thresholds (percent) and markers.
ALTA, QUEDA = 5, -5
SETA_ALTA, SETA_QUEDA, SETA_ESTAVEL = "↗️", "↘️", "➡️"


def monthly_sales(pedidos: DataFrame) -> DataFrame:
    """Non-cancelled orders per calendar month: total value and order count."""
    return (pedidos.where(not_cancelled())
            .groupBy(F.trunc("data_pedido", "month").alias("mes"))
            .agg(F.sum("valor_total").alias("_total"),
                 F.count(F.lit(1)).alias("contratos")))


def _by_month():
    # monthly table: bounded by the calendar
    return Window.orderBy("mes")


def _growth(total="_total"):
    prev = F.lag(total).over(_by_month())
    return ratio_pct(F.col(total) - prev, prev, 2)


def monthly_trend(pedidos: DataFrame, ano: int | None = None, trimestre: int | None = None,
                  exact: bool = False) -> DataFrame:
    """TR1 (and TR9 with ``ano`` / ``trimestre``): monthly sales, orders, growth vs the
    previous existing month, labels.  Newest first when ordered by ``mes_ano`` desc.
    ``exact`` keeps the sales a decimal, for the tables derived from them."""
    m = monthly_sales(pedidos)
    m = m.withColumn("crescimento", _growth())
    if ano is not None:
        m = m.where(F.year("mes") == ano)
    if trimestre is not None:
        m = m.where(F.quarter("mes") == trimestre)
    return m.select(F.date_format("mes", "yyyy-MM").alias("mes_ano"),
                    F.date_format("mes", "MMM/yyyy").alias("mes_label"),
                    F.col("_total").cast(TOTAL if exact else "double").alias("vendas"),
                    "contratos", "crescimento")


def monthly_trend_ytd(pedidos: DataFrame) -> DataFrame:
    """TR2: TR1 plus mean ticket and the running total within each year."""
    m = monthly_sales(pedidos)
    ytd = Window.partitionBy(F.year("mes")).orderBy("mes").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return m.select(F.date_format("mes", "yyyy-MM").alias("mes_ano"),
                    F.col("_total").cast("double").alias("total_vendas"),
                    F.col("contratos").alias("total_contratos"),
                    avg_money(F.col("_total"), F.col("contratos")).alias("ticket_medio_mes"),
                    _growth().alias("crescimento_percentual"),
                    F.sum("_total").over(ytd).cast("double").alias("acumulado_ano"))


def monthly_trend_test(pedidos: DataFrame) -> DataFrame:
    """TR3: test variant with the previous month's revenue."""
    m = monthly_sales(pedidos)
    prev = F.lag("_total").over(_by_month())
    return m.select(F.date_format("mes", "yyyy-MM-dd").alias("mes"),
                    F.col("_total").cast("double").alias("receita_mes"),
                    F.col("contratos").alias("total_pedidos"),
                    prev.cast("double").alias("receita_anterior"),
                    _growth().alias("crescimento_percentual"))


def trend_kpis(trend: DataFrame) -> DataFrame:
    """TR4: period total, orders, ticket = total / orders (whole units) and the
    growth of the newest month that has one."""
    total = F.sum(F.col("vendas").cast(TOTAL))
    return trend.agg(
        total.cast("double").alias("total_vendas"),
        F.sum("contratos").alias("total_contratos"),
        rhu_div(cents(total), F.sum("contratos") * 100).alias("ticket_medio"),
        F.max_by(F.col("crescimento"), F.when(F.col("crescimento").isNotNull(), F.col("mes_ano")))
         .alias("ultimo_crescimento"))


def trend_table(trend: DataFrame) -> DataFrame:
    """TR5: running totals -- chronological (W5) and newest-first as in the detail
    table (W6) -- and the direction marker (> 5 % up, < -5 % down, else flat)."""
    v = F.col("vendas").cast(TOTAL)
    asc = Window.orderBy("mes_ano").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    desc = Window.orderBy(F.col("mes_ano").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = F.col("crescimento")
    return trend.select("mes_ano", F.col("vendas").cast("double").alias("vendas"), "contratos", "crescimento",
                        F.sum(v).over(asc).cast("double").alias("acumulado"),
                        F.sum(v).over(desc).cast("double").alias("acumulado_tabela"),
                        F.when(c > ALTA, SETA_ALTA).when(c < QUEDA, SETA_QUEDA).otherwise(SETA_ESTAVEL)
                        .alias("tendencia"))


def year_month_matrix(pedidos: DataFrame, ref_date=None, exact: bool = False) -> DataFrame:
    """TR6 / A12: sales and orders per (year, month) since 1 January of the year
    before ``ref``; every month 1-12 of every year present is filled (0 when empty).
    ``exact`` keeps the sales a decimal, for the tables derived from them."""
    ref = ref_column(pedidos, ref_date)
    o = pedidos.where(not_cancelled() & (F.col("data_pedido") >= start_of_previous_year(ref)))
    agg = (o.groupBy(F.year("data_pedido").alias("ano"), F.month("data_pedido").alias("mes"))
           .agg(F.sum("valor_total").alias("_v"), F.count(F.lit(1)).alias("_c")))
    # calendar spine: each year present, months 1-12
    spine = agg.select("ano").distinct().select("ano", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("mes"))
    names = F.array(*[F.lit(m) for m in MONTHS_PT])
    return (spine.join(agg, ["ano", "mes"], "left")
            .select("ano", "mes", F.element_at(names, F.col("mes")).alias("mes_nome"),
                    F.coalesce(F.col("_v"), F.lit(0).cast(TOTAL)).cast(TOTAL if exact else "double").alias("vendas"),
                    F.coalesce(F.col("_c"), F.lit(0)).cast("long").alias("contratos")))


def year_columns(matrix: DataFrame, ref_date) -> DataFrame:
    """A12, wide form: a row per month and, for the year of ``ref_date`` and the one before, a
    column of sales and one of orders (``vendas_<year>``, ``contratos_<year>``); 0 where empty."""
    out = [F.first("mes_nome").alias("mes_nome")]
    for ano in (ref_date.year - 1, ref_date.year):
        for c in ("vendas", "contratos"):
            out.append(F.coalesce(F.max(F.when(F.col("ano") == ano, F.col(c))), F.lit(0)).cast(matrix.schema[c].dataType).alias(f"{c}_{ano}"))
    return matrix.groupBy("mes").agg(*out)


def year_comparison(matrix: DataFrame) -> DataFrame:
    """TR7: YoY % (last vs first year), best month of the last year (first maximum),
    projection = last-year total * 12 / months with sales."""
    v = F.col("vendas").cast(TOTAL)
    per_year = matrix.groupBy("ano").agg(
        F.sum(v).alias("_tot"),
        F.count_if(v > 0).alias("_meses"),
        F.max_by(F.col("mes_nome"), F.struct(v, -F.col("mes"))).alias("melhor_mes"))
    bounds = per_year.agg(F.min("ano").alias("_a0"), F.max("ano").alias("_a1"), F.count(F.lit(1)).alias("anos"))
    first = per_year.select(F.col("ano").alias("_a0"), F.col("_tot").alias("_t0"))
    last = per_year.select(F.col("ano").alias("_a1"), F.col("_tot").alias("_t1"), "_meses", "melhor_mes")
    j = bounds.join(first, "_a0").join(last, "_a1")
    months = F.greatest(F.col("_meses"), F.lit(1))
    return j.select(
        "anos",
        F.when((F.col("anos") >= 2) & (F.col("_t0") > 0),
               ratio_pct(F.col("_t1") - F.col("_t0"), F.col("_t0"), 1)).alias("yoy_pct"),
        "melhor_mes",
        (rhu_div(cents(F.col("_t1")) * 12, months) / 100.0).alias("projecao"))


def chart_feed(trend: DataFrame) -> DataFrame:
    """TR8: chronological feed: sales in millions (2 dp), growth NULL -> 0 (1 dp)."""
    v = F.col("vendas").cast(TOTAL)
    g = F.col("crescimento").cast("decimal(12,2)")
    return trend.select("mes_ano",
                        (rhu_div(cents(v), F.lit(1_000_000)) / 100.0).alias("vendas_milhoes"),
                        F.coalesce(rhu_div(cents(g), F.lit(10)) / 10.0, F.lit(0.0)).alias("crescimento"))


def month_label(df: DataFrame, col: str = "data_pedido") -> DataFrame:
    """Portuguese month label of a date column."""
    return df.withColumn("mes_nome", month_label_pt(F.col(col)))
