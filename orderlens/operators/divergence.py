"""Recorded order value vs the sum of its lines; set-based correction.

Lines are aggregated per order *before* meeting the orders (partial
aggregation, one row per order leaves each task), so the join moves one row
per order.  Correction never loops over orders: one join decides every
order, and the outputs (corrected orders, log rows, summary) are new
DataFrames derived from the same input snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions.dates import days_before, ref_column
from orderlens.functions.numeric import MONEY, dec, ratio_pct
from orderlens.functions.predicates import abs_divergence
from orderlens.plans.ranking import with_global_row_number
from orderlens.session import checkpoint_dir

# Absolute tolerance (currency units) and relative tolerance (fraction).
TOLERANCIA = "0.01"
TOLERANCIA_RELATIVA = "0.05"


def item_sums(itens: DataFrame, rounded_lines: bool = True) -> DataFrame:
    """Per order: sum of line values and line count.  ``rounded_lines`` sums the stored
    2-dp subtotal; otherwise the unrounded quantity x price."""
    v = F.col("subtotal") if rounded_lines else F.col("quantidade") * F.col("preco_unitario")
    return itens.groupBy("id_pedido").agg(F.sum(v).alias("valor_calculado"),
                                          F.count(F.lit(1)).alias("qtd_itens"))


def divergences_period(pedidos: DataFrame, itens: DataFrame, clientes: DataFrame, ref_date=None,
                       periodo_dias: int = 365, limite: int | None = None) -> DataFrame:
    """Divergent orders (|recorded - lines| > 0.01) of the last ``periodo_dias``
    days, largest difference first; all of them, or the first ``limite``.  Orders are
    filtered by date before their lines are summed."""
    ref = ref_column(pedidos, ref_date)
    p = pedidos.where(F.col("data_pedido") >= days_before(ref, periodo_dias))
    lines = itens.join(p.select("id_pedido"), "id_pedido", "left_semi")
    j = (p.join(item_sums(lines), "id_pedido")
         .where(abs_divergence(F.col("valor_total"), F.col("valor_calculado"), TOLERANCIA))
         .join(clientes.select("id_cliente", F.col("nome").alias("cliente")), "id_cliente"))
    diff = F.abs(F.col("valor_total") - F.col("valor_calculado"))
    out = j.select(
        "id_pedido",
        F.date_format("data_pedido", "dd/MM/yyyy").alias("data_pedido"),
        "cliente",
        F.col("valor_total").cast("double").alias("valor_total"),
        F.col("valor_total").cast("double").alias("valor_registrado"),
        F.col("valor_calculado").cast("double").alias("valor_calculado"),
        F.round(diff, 2).cast("double").alias("diferenca"),
        ratio_pct(diff, F.col("valor_calculado"), 2).alias("diferenca_pct"),
        F.when(F.col("valor_total") > F.col("valor_calculado"), "SOBREFATURAMENTO")
         .otherwise("SUBFATURAMENTO").alias("tipo_anomalia"),
        F.lit("PENDENTE").alias("status_correcao"))
    out = out.orderBy(F.col("diferenca").desc(), F.col("id_pedido").asc())
    return out if limite is None else out.limit(limite)


def divergences_all(pedidos: DataFrame, itens: DataFrame, clientes: DataFrame) -> DataFrame:
    """Every divergent order (any status, any date) with its line count."""
    j = (pedidos.join(item_sums(itens), "id_pedido")
         .where(abs_divergence(F.col("valor_total"), F.col("valor_calculado"), TOLERANCIA))
         .join(clientes.select("id_cliente", F.col("nome").alias("cliente")), "id_cliente"))
    diff = F.abs(F.col("valor_total") - F.col("valor_calculado"))
    return j.select(
        "id_pedido", F.date_format("data_pedido", "yyyy-MM-dd").alias("data_pedido"), "cliente",
        "tipo_contrato", "status",
        F.col("valor_total").cast("double").alias("valor_total_registrado"),
        F.round("valor_calculado", 2).cast("double").alias("valor_calculado"),
        F.round(diff, 2).cast("double").alias("diferenca"),
        ratio_pct(diff, F.col("valor_calculado"), 2).alias("diferenca_pct"),
        "qtd_itens",
        F.when(F.col("valor_total") > F.col("valor_calculado"), "Superfaturado")
         .otherwise("Subfaturado").alias("tipo_anomalia"))


def divergences_relative(pedidos: DataFrame, itens: DataFrame, fraction: str = TOLERANCIA_RELATIVA) -> DataFrame:
    """Test variant -- difference above 5 % of the (unrounded) line sum."""
    s = item_sums(itens, rounded_lines=False)
    j = pedidos.select("id_pedido", "valor_total").join(s, "id_pedido")
    diff = F.abs(F.col("valor_total") - F.col("valor_calculado"))
    return (j.where(diff > F.col("valor_calculado") * dec(fraction))
            .select("id_pedido",
                    F.col("valor_total").cast("double").alias("valor_cabecalho"),
                    F.col("valor_calculado").cast("double").alias("valor_calculado"),
                    diff.cast("double").alias("diferenca"),
                    ratio_pct(diff, F.col("valor_calculado"), 2).alias("diferenca_pct"),
                    F.when(F.col("valor_total") > F.col("valor_calculado"), "Superfaturado")
                     .otherwise("Subfaturado").alias("tipo_anomalia")))


def latest_corrections(log: DataFrame, campo: str = "valor_total") -> DataFrame:
    """A10: latest correction of ``campo`` per order (an aggregate, not a per-order sort)."""
    latest = F.max_by(F.struct("data_correcao", "tipo_correcao", "valor_novo"),
                      F.struct("data_correcao", "id_correcao"))
    return (log.where(F.col("campo_corrigido") == campo)
            .groupBy("id_pedido").agg(latest.alias("_c"))
            .select("id_pedido", F.col("_c.data_correcao").alias("data_correcao"),
                    F.col("_c.tipo_correcao").alias("tipo_correcao")))


def anomaly_view(pedidos: DataFrame, itens: DataFrame, clientes: DataFrame, log: DataFrame,
                 show_resolved: bool = False) -> DataFrame:
    """C4: divergent orders with correction status -- CORRIGIDO when a value
    correction was logged for the order, else PENDENTE.  As in the model's view, an
    order that no longer diverges drops out; ``show_resolved`` keeps corrected
    orders whose difference is now within the tolerance."""
    diverges = abs_divergence(F.col("valor_total"), F.col("valor_calculado"), TOLERANCIA)
    j = (pedidos.join(item_sums(itens).drop("qtd_itens"), "id_pedido")
         .join(latest_corrections(log), "id_pedido", "left"))
    j = j.where(diverges | F.col("data_correcao").isNotNull()) if show_resolved else j.where(diverges)
    j = j.join(clientes.select("id_cliente", F.col("nome").alias("cliente"), "tipo_cliente", "regiao"), "id_cliente")
    vt, vc = F.col("valor_total"), F.col("valor_calculado")
    return j.select(
        "id_pedido", F.date_format("data_pedido", "yyyy-MM-dd").alias("data_pedido"), "id_cliente", "cliente",
        "tipo_cliente", "regiao",
        vt.cast("double").alias("valor_registrado"), vc.cast("double").alias("valor_calculado"),
        F.round(F.abs(vt - vc), 2).cast("double").alias("diferenca"),
        F.when(F.col("data_correcao").isNotNull(), "CORRIGIDO").otherwise("PENDENTE").alias("status_correcao"),
        F.date_format("data_correcao", "yyyy-MM-dd HH:mm:ss").alias("data_correcao"),
        "tipo_correcao",
        F.when(vt > vc, "SOBREFATURAMENTO").when(vt < vc, "SUBFATURAMENTO").otherwise("OK").alias("tipo_anomalia"))


def _next_ids(df: DataFrame, log: DataFrame, order: list[str], name: str) -> DataFrame:
    """Contiguous keys after the log's high-water mark, in ``order``."""
    hw = log.agg(F.coalesce(F.max("id_correcao"), F.lit(0)).cast("long")).scalar()
    numbered = with_global_row_number(df, [F.col(c).asc() for c in order], "_rn")
    return numbered.withColumn(name, hw + F.col("_rn")).drop("_rn")


def _log_rows(fixes: DataFrame, log: DataFrame, usuario: str, motivo: str, when_ts) -> DataFrame:
    """Log rows of the orders whose valor_total becomes _novo."""
    checkpoint_dir(fixes.sparkSession)
    fixes = fixes.select("id_pedido", "valor_total", "_novo").checkpoint(eager=True)  # written once: numbering samples and sorts them
    return _next_ids(fixes, log, ["id_pedido"], "id_correcao").select(
        "id_correcao", "id_pedido", F.lit("valor_total").alias("campo_corrigido"),
        F.col("valor_total").alias("valor_anterior"), F.col("_novo").alias("valor_novo"),
        F.lit("AUTOMATICA").alias("tipo_correcao"), F.lit(usuario).alias("usuario_correcao"),
        F.lit(motivo).alias("motivo_correcao"), when_ts.alias("data_correcao"))


def correct_orders(pedidos: DataFrame, itens: DataFrame, keys: DataFrame, log: DataFrame,
                   usuario: str = "SISTEMA", motivo: str = "Correção automática de divergência",
                   quando=None, with_log: bool = True) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """C5 (and the core of C6): correct the orders listed in ``keys`` (column id_pedido).

    For each listed order: calculated = sum of its line subtotals (0 without
    lines).  |recorded - calculated| <= 0.01 -> SEM_DIVERGENCIA; otherwise a
    log row is written and the order takes the calculated value -> CORRIGIDO.
    Returns (result per order, new log rows, orders with corrected values); the log
    rows (numbered after the log's high-water mark) are skipped with ``with_log=False``.
    """
    when_ts = F.current_timestamp() if quando is None else F.lit(str(quando)).cast("timestamp")
    sums = item_sums(itens).select("id_pedido", "valor_calculado")
    target = (pedidos.select("id_pedido", "valor_total")
              .join(keys.select("id_pedido").distinct(), "id_pedido", "left_semi")
              .join(sums, "id_pedido", "left")
              .withColumn("valor_calculado", F.coalesce("valor_calculado", F.lit(0)).cast(MONEY)))
    diverges = abs_divergence(F.col("valor_total"), F.col("valor_calculado"), TOLERANCIA)
    result = target.select(
        "id_pedido",
        F.when(diverges, "CORRIGIDO").otherwise("SEM_DIVERGENCIA").alias("status"),
        F.col("valor_total").cast("double").alias("valor_anterior"),
        F.col("valor_calculado").cast("double").alias("valor_novo"))
    fixes = target.where(diverges)
    new_log = None if not with_log else _log_rows(fixes.withColumn("_novo", F.col("valor_calculado")), log, usuario, motivo, when_ts)
    corrected = (pedidos.join(fixes.select("id_pedido", F.col("valor_calculado").alias("_novo")), "id_pedido", "left")
                 .withColumn("valor_total", F.coalesce("_novo", "valor_total").cast(MONEY)).drop("_novo")
                 .select(*pedidos.columns))
    return result, new_log, corrected


def correct_all_pending(pedidos: DataFrame, itens: DataFrame, clientes: DataFrame, log: DataFrame,
                        usuario: str = "SISTEMA", quando=None,
                        with_log: bool = True) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Correct every PENDENTE order of the anomaly view in one pass.

    One join of the orders with their line sums (and the log's latest corrections) decides
    each order; corrected orders, log rows and summary are projections of it.  Returns
    (orders with corrected values, new log rows, one-row summary).
    """
    when_ts = F.current_timestamp() if quando is None else F.lit(str(quando)).cast("timestamp")
    j = (pedidos.join(item_sums(itens).select("id_pedido", "valor_calculado"), "id_pedido", "left")
         .join(latest_corrections(log).select("id_pedido", "data_correcao"), "id_pedido", "left")
         .join(clientes.select("id_cliente", F.lit(True).alias("_cliente")), "id_cliente", "left"))
    pending = (F.col("_cliente") & F.col("data_correcao").isNull()
               & abs_divergence(F.col("valor_total"), F.col("valor_calculado"), TOLERANCIA))
    j = j.withColumn("_pendente", F.coalesce(pending, F.lit(False))).withColumn("_novo", F.col("valor_calculado").cast(MONEY))
    new_log = None if not with_log else _log_rows(j.where("_pendente"), log, usuario, "Correção em lote", when_ts)
    corrected = (j.withColumn("valor_total", F.when(F.col("_pendente"), F.col("_novo")).otherwise(F.col("valor_total")).cast(MONEY))
                 .select(*pedidos.columns))
    summary = j.agg(F.count_if("_pendente").alias("total_corrigidas"), F.lit(0).cast("long").alias("total_sem_divergencia"))
    return corrected, new_log, summary


def correction_history(log: DataFrame, id_pedido: int | None = None) -> DataFrame:
    """Correction history (one order, or all), newest first, date as dd/MM/yyyy HH:mm."""
    if id_pedido is not None:
        log = log.where(F.col("id_pedido") == id_pedido)
    return (log.select("id_correcao", "id_pedido", "campo_corrigido",
                       F.col("valor_anterior").cast("double").alias("valor_anterior"),
                       F.col("valor_novo").cast("double").alias("valor_novo"),
                       "tipo_correcao", "usuario_correcao", "motivo_correcao",
                       F.date_format("data_correcao", "dd/MM/yyyy HH:mm").alias("data_formatada"),
                       "data_correcao")
            .orderBy(F.col("data_correcao").desc(), F.col("id_correcao").desc())
            .drop("data_correcao"))


def alert_counts(divergences: DataFrame, inactive: DataFrame) -> DataFrame:
    """Dashboard alerts -- pending divergences and inactive customers."""
    inativos = inactive.agg(F.count(F.lit(1))).scalar()
    return divergences.agg(F.count_if(F.col("status_correcao") == "PENDENTE").alias("anomalias_pendentes"),
                           F.first(inativos).alias("clientes_inativos"))


def empty_log(spark) -> DataFrame:
    from orderlens.model import LOG_CORRECOES
    return spark.createDataFrame([], LOG_CORRECOES)
