"""Customer inactivity (IN1-IN6, J4, J5, A5, P12).

One aggregate per customer over the orders, then a join to the customer
table; "never bought" comes from a left join (J4) with the status filter
applied to the orders before the join (J5), never inside a per-row loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions.dates import months_before, ref_column
from orderlens.functions.predicates import not_cancelled

# Inactivity bands in days and the estimated loss per inactive customer.
DIAS_CRITICO, DIAS_INATIVO, DIAS_ALERTA = 365, 180, 90
PERDA_POR_CLIENTE = 15000


def inactive_customers(pedidos: DataFrame, clientes: DataFrame, ref_date=None,
                       min_days: int = DIAS_INATIVO) -> DataFrame:
    """IN1: customers whose last order of *any* status is more than ``min_days`` old
    (cancelled orders count, inner join: customers without orders are absent)."""
    ref = ref_column(pedidos, ref_date)
    last = (pedidos.groupBy("id_cliente").agg(F.max("data_pedido").alias("_u"))
            .withColumn("dias_inativo", F.datediff(ref, F.col("_u"))))
    return (clientes.join(last, "id_cliente")
            .where(F.col("dias_inativo") > min_days)
            .select("id_cliente", "nome", "tipo_cliente", "regiao", "dias_inativo",
                    F.date_format("_u", "dd/MM/yyyy").alias("ultima_compra")))


def inactive_or_never(pedidos: DataFrame, clientes: DataFrame, ref_date=None) -> DataFrame:
    """IN2: inactive (> 180 days) or never bought; cancelled orders excluded; the
    registration date stands in for customers without orders."""
    ref = ref_column(pedidos, ref_date)
    ua = (pedidos.where(not_cancelled()).groupBy("id_cliente")
          .agg(F.max("data_pedido").alias("_u"), F.count(F.lit(1)).alias("_n"))
          .withColumn("_d", F.datediff(ref, F.col("_u"))))
    j = clientes.join(ua, "id_cliente", "left")
    never = F.col("_u").isNull()
    status = (F.when(never, "Nunca comprou")
              .when(F.col("_d") > DIAS_CRITICO, "Crítico (>1 ano)")
              .when(F.col("_d") > DIAS_INATIVO, "Inativo (6-12 meses)")
              .otherwise("Alerta (3-6 meses)"))
    return (j.where(never | (F.col("_d") > DIAS_INATIVO))
            .select("id_cliente", "nome", "tipo_cliente", "regiao", "estado",
                    F.date_format(F.coalesce("_u", "data_cadastro"), "yyyy-MM-dd").alias("ultima_compra"),
                    F.coalesce(F.col("_d"), F.datediff(ref, F.col("data_cadastro"))).alias("dias_inativo"),
                    F.coalesce(F.col("_n"), F.lit(0)).alias("total_pedidos_historico"),
                    status.alias("status_inatividade")))


def inactive_six_months(pedidos: DataFrame, clientes: DataFrame, ref_date=None, months: int = 6) -> DataFrame:
    """IN3: test variant -- last non-cancelled order before ref - 6 calendar months,
    or none at all (HAVING on the aggregate after a left join)."""
    ref = ref_column(pedidos, ref_date)
    valid = pedidos.where(not_cancelled()).select("id_cliente", "data_pedido")
    agg = (clientes.select("id_cliente", "nome", "tipo_cliente", "regiao")
           .join(valid, "id_cliente", "left")
           .groupBy("id_cliente", "nome", "tipo_cliente", "regiao")
           .agg(F.max("data_pedido").alias("_u")))
    return (agg.where((F.col("_u") < months_before(ref, months)) | F.col("_u").isNull())
            .select("id_cliente", "nome", "tipo_cliente", "regiao",
                    F.date_format("_u", "yyyy-MM-dd").alias("ultimo_pedido"),
                    F.datediff(ref, F.col("_u")).alias("dias_inativo")))


def _bands(d):
    return [F.count_if(d > DIAS_CRITICO).alias("mais_1_ano"),
            F.count_if((d >= DIAS_INATIVO) & (d <= DIAS_CRITICO)).alias("de_6_a_12_meses"),
            F.count_if((d >= DIAS_ALERTA) & (d < DIAS_INATIVO)).alias("de_3_a_6_meses")]


def inactivity_kpis(inactive: DataFrame, min_days: int | None = None) -> DataFrame:
    """IN4 (+ P12 ``min_days`` filter, >=): total, bands and estimated loss."""
    if min_days is not None:
        inactive = inactive.where(F.col("dias_inativo") >= min_days)
    d = F.coalesce(F.col("dias_inativo"), F.lit(0))
    return inactive.agg(F.count(F.lit(1)).alias("total"), *_bands(d),
                        (F.count(F.lit(1)) * PERDA_POR_CLIENTE).cast("long").alias("perda_estimada"))


def inactivity_by_region(inactive: DataFrame) -> DataFrame:
    """IN5: per region, total inactive customers and the three bands."""
    d = F.coalesce(F.col("dias_inativo"), F.lit(0))
    return inactive.groupBy("regiao").agg(F.count(F.lit(1)).alias("total"), *_bands(d))


def inactivity_labels(inactive: DataFrame) -> DataFrame:
    """IN6: row label Crítico (> 365) / Alerta (> 180) / Atenção."""
    d = F.col("dias_inativo")
    return inactive.withColumn("rotulo", F.when(d > DIAS_CRITICO, "Crítico")
                               .when(d > DIAS_INATIVO, "Alerta").otherwise("Atenção"))
