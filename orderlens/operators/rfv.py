"""Recency / frequency / value segmentation and scoring.

All per-customer metrics are one hash aggregate over the non-cancelled orders
(partial aggregation before the shuffle).  Global NTILE compares rows with selected
boundary keys (``plans.selection``) and LAG takes values over inside range partitions
(``plans.ordered``) instead of a single-partition window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions.dates import ref_column
from orderlens.functions.numeric import TOTAL, avg_money, rhu_div
from orderlens.functions.predicates import not_cancelled
from orderlens.plans.ranking import with_position, with_previous
from orderlens.plans.selection import tile_column
from orderlens.plans.stats import equal_width_histogram, grouped_box
from orderlens.session import checkpoint_dir

# Segment labels of the fixed-threshold rules, in display order.
SEGMENTOS = ["Campeão", "Fiel", "Ativo", "Em Risco"]
# Thresholds (days, orders) of those rules.
CAMPEAO_DIAS, CAMPEAO_PEDIDOS = 30, 5
FIEL_DIAS, FIEL_PEDIDOS = 60, 3
ATIVO_DIAS = 90


def segment_fixed(days: Column, orders: Column, accented: bool = True) -> Column:
    """R1 rules: <=30 d and >=5 orders Campeão; <=60 and >=3 Fiel; <=90 Ativo; else Em Risco."""
    champion = "Campeão" if accented else "Campeao"
    return (F.when((days <= CAMPEAO_DIAS) & (orders >= CAMPEAO_PEDIDOS), champion)
            .when((days <= FIEL_DIAS) & (orders >= FIEL_PEDIDOS), "Fiel")
            .when(days <= ATIVO_DIAS, "Ativo")
            .otherwise("Em Risco"))


def customer_metrics(pedidos: DataFrame, ref: Column) -> DataFrame:
    """Per customer over non-cancelled orders: last date, recency, count, total, first date."""
    return (pedidos.where(not_cancelled())
            .groupBy("id_cliente")
            .agg(F.max("data_pedido").alias("ultima"),
                 F.min("data_pedido").alias("primeira"),
                 F.count(F.lit(1)).alias("total_pedidos"),
                 F.sum("valor_total").alias("soma"))
            .withColumn("dias", F.datediff(ref, F.col("ultima"))))


def purchase_gaps(pedidos: DataFrame) -> DataFrame:
    """Per non-cancelled order, the customer's previous order date and the gap in
    days (LAG over (date, id) within the customer), as a distributed LAG."""
    o = pedidos.where(not_cancelled()).select("id_cliente", "id_pedido", "data_pedido")
    lagged = with_previous(o, ["id_cliente"], [F.col("data_pedido").asc(), F.col("id_pedido").asc()],
                           ["data_pedido"], prefix="_anterior_")
    return lagged.select("id_cliente", "id_pedido",
                         F.date_format("data_pedido", "yyyy-MM-dd").alias("data_pedido"),
                         F.date_format("_anterior_data_pedido", "yyyy-MM-dd").alias("data_anterior"),
                         F.datediff("data_pedido", "_anterior_data_pedido").alias("gap_dias"))


def rfv_fixed(pedidos: DataFrame, clientes: DataFrame, ref_date=None) -> DataFrame:
    """Fixed-threshold RFV per customer with at least one non-cancelled order."""
    ref = ref_column(pedidos, ref_date)
    m = customer_metrics(pedidos, ref)
    return (clientes.join(m, "id_cliente")
            .select("id_cliente", "nome", "tipo_cliente", "regiao",
                    F.col("dias").cast("int").alias("dias_desde_ultimo"),
                    F.date_format("ultima", "dd/MM/yyyy").alias("ultima_data"),
                    F.col("total_pedidos"),
                    avg_money(F.col("soma"), F.col("total_pedidos")).alias("ticket_medio"),
                    F.col("soma").cast("double").alias("valor_total"),
                    segment_fixed(F.col("dias"), F.col("total_pedidos")).alias("segmento")))


def _quintiles(m: DataFrame, scores: dict[str, tuple[str, bool]]) -> DataFrame:
    """NTILE(5) per score over (measure, id): rows compare themselves with the last key of each fifth (``selection``),
    so the table is sorted for none.  The customers' metrics are written once, as every score reads them."""
    checkpoint_dir(m.sparkSession)
    m = m.checkpoint(eager=True)
    total = m.count()
    return m.select("*", *[tile_column(m, [(measure, up), ("id_cliente", True)], 5, total).alias(score) for score, (measure, up) in scores.items()])


def rfm_scores(pedidos: DataFrame, clientes: DataFrame, ref_date=None) -> DataFrame:
    """R2: RFM quintile scores and five segments.

    r = NTILE(5) by recency descending, f by order count ascending, m by value
    ascending; ties broken by customer id.  The mean purchase gap is the mean
    of consecutive-date differences (W1), which telescopes to
    (last - first) / (orders - 1), so no per-customer window is needed.
    """
    ref = ref_column(pedidos, ref_date)
    m = customer_metrics(pedidos, ref)
    m = m.withColumn("gap_medio_dias",
                     F.when(F.col("total_pedidos") > 1,
                            rhu_div(F.datediff("ultima", "primeira"), F.col("total_pedidos") - 1)))
    m = _quintiles(m, {"score_r": ("dias", False), "score_f": ("total_pedidos", True), "score_m": ("soma", True)})
    r, f, v = F.col("score_r"), F.col("score_f"), F.col("score_m")
    segmento = (F.when((r >= 4) & (f >= 4) & (v >= 4), "Campeão")
                .when((r >= 3) & (f >= 3), "Fiel")
                .when(r >= 3, "Ativo")
                .when((r <= 2) & (v >= 3), "Em Risco (Alto Valor)")
                .otherwise("Inativo"))
    return (clientes.join(m, "id_cliente")
            .select("id_cliente", "nome", "tipo_cliente", "regiao", "estado",
                    F.col("dias").cast("int").alias("dias_desde_ultimo_pedido"),
                    F.date_format("ultima", "yyyy-MM-dd").alias("ultima_data"),
                    "total_pedidos",
                    avg_money(F.col("soma"), F.col("total_pedidos")).alias("ticket_medio"),
                    F.col("soma").cast("double").alias("valor_total"),
                    "gap_medio_dias", "score_r", "score_f", "score_m",
                    (r + f + v).alias("score_rfm_total"),
                    segmento.alias("segmento")))


def rfv_test_scores(pedidos: DataFrame, ref_date=None) -> DataFrame:
    """Test variant -- NTILE recency ascending, frequency and value descending
    (1 = best), and the previous customer's value in value-descending order (W3)."""
    ref = ref_column(pedidos, ref_date)
    m = customer_metrics(pedidos, ref)
    m = _quintiles(m, {"score_r": ("dias", True), "score_f": ("total_pedidos", False), "score_v": ("soma", False)})
    out = with_previous(m, [], [F.col("soma").desc(), F.col("id_cliente").asc()], ["soma"], prefix="_prev_")
    return out.select("id_cliente",
                      F.date_format("ultima", "yyyy-MM-dd").alias("ultima_compra"),
                      F.col("total_pedidos").alias("frequencia"),
                      F.col("soma").cast("double").alias("valor_total"),
                      F.col("dias").cast("int").alias("recencia_dias"),
                      "score_r", "score_f", "score_v",
                      (F.col("score_r") + F.col("score_f") + F.col("score_v")).alias("score_rfv"),
                      F.col("_prev_soma").cast("double").alias("valor_anterior"))


def segment_counts(pedidos: DataFrame, ref_date=None, accented: bool = True) -> DataFrame:
    """R4 (accented labels) / R5 (``accented=False``): customers per fixed-threshold segment.

    Also carries the total number of customers with orders and the at-risk count.
    """
    ref = ref_column(pedidos, ref_date)
    m = customer_metrics(pedidos, ref)
    seg = m.select(segment_fixed(F.col("dias"), F.col("total_pedidos"), accented).alias("segmento"))
    counts = seg.groupBy("segmento").agg(F.count(F.lit(1)).alias("clientes"))
    everything = Window.partitionBy()  # over the (at most four) segment rows
    return counts.select(
        "segmento", "clientes",
        F.sum("clientes").over(everything).alias("total_clientes"),
        F.coalesce(F.sum(F.when(F.col("segmento") == "Em Risco", F.col("clientes"))).over(everything),
                   F.lit(0).cast("long")).alias("em_risco"))


def _filtered(rfv: DataFrame, segmento: str | None, regiao: str | None) -> DataFrame:
    """Optional segment and region filters applied before the KPIs."""
    if segmento:
        rfv = rfv.where(F.col("segmento") == segmento)
    if regiao:
        rfv = rfv.where(F.col("regiao") == regiao)
    return rfv


def segment_kpis(rfv: DataFrame, segmento: str | None = None, regiao: str | None = None) -> DataFrame:
    """Customers per segment over the four fixed labels (zero rows kept) and the total."""
    rfv = _filtered(rfv, segmento, regiao)
    spine = rfv.sparkSession.createDataFrame([(s, i) for i, s in enumerate(SEGMENTOS)], "segmento string, ordem int")
    counts = rfv.groupBy("segmento").agg(F.count(F.lit(1)).alias("clientes"))
    total = rfv.agg(F.count(F.lit(1))).scalar()
    return (F.broadcast(spine).join(counts, "segmento", "left")
            .select("segmento", "ordem", F.coalesce("clientes", F.lit(0)).alias("clientes"),
                    total.alias("total_clientes")))


def segment_summary(rfv: DataFrame) -> DataFrame:
    """Per segment, customers and total value."""
    return (rfv.groupBy("segmento")
            .agg(F.count(F.lit(1)).alias("clientes"),
                 F.sum(F.col("valor_total").cast(TOTAL)).cast("double").alias("valor")))


def region_summary(rfv: DataFrame) -> DataFrame:
    """Per region, customers, champions, value and value per customer."""
    v = F.col("valor_total").cast(TOTAL)
    return (rfv.groupBy("regiao")
            .agg(F.count(F.lit(1)).alias("clientes"),
                 F.count_if(F.col("segmento") == "Campeão").alias("campeoes"),
                 F.sum(v).alias("_valor"))
            .select("regiao", "clientes", "campeoes",
                    F.col("_valor").cast("double").alias("valor"),
                    avg_money(F.col("_valor"), F.col("clientes")).alias("valor_por_cliente")))


def recency_histogram(rfv: DataFrame, bins: int = 20) -> DataFrame:
    """Equal-width histogram (A14) of days since the last order."""
    return equal_width_histogram(rfv, "dias_desde_ultimo", bins)


def value_box(rfv: DataFrame) -> DataFrame:
    """Box summary (A15) of customer value."""
    return grouped_box(rfv, [], "valor_total", "id_cliente")


def rfv_points(rfv: DataFrame) -> DataFrame:
    """Point sets frequency-value and recency-value (one row per customer)."""
    return rfv.select("id_cliente", "nome", "total_pedidos", "dias_desde_ultimo", "valor_total")


def top_customers(rfv: DataFrame, k: int = 5) -> DataFrame:
    """The k customers with the highest RFV value (ties by id), with position."""
    order = [F.col("valor_total").desc(), F.col("id_cliente").asc()]
    return with_position(rfv.orderBy(*order).limit(k), order).orderBy("posicao")
