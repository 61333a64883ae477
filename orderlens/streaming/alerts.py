"""ST2: value-divergence alerts on arriving orders and order lines.

Headers and lines arrive as one event stream (kind, order id, event time, amount) and meet on the order id.  The stream
(``start_alert_stream``) keeps one session per open order in keyed state: an order closes once
nothing has come for it for ``gap`` of event time and the watermark, ``lateness`` behind the newest event, has
passed that.  Closing gives the order's alert, once, and frees its state, so the state holds open
orders only and the history is not read again.  Event times ahead of a stated bound never move the watermark:
they go to a reject table.

``start_alerts`` and ``divergence_alerts`` are the variant without state: partial sums by epoch, summed over the
whole history when read, for streams whose disorder no watermark can bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.numeric import MONEY, dec
from orderlens.streaming.sink import write_epochs


def order_events(pedidos: DataFrame, itens: DataFrame) -> DataFrame:
    """Header and line events of the orders (event time = order date)."""
    headers = pedidos.select(F.lit("pedido").alias("tipo"), "id_pedido",
                             F.col("data_pedido").cast("timestamp").alias("ts"),
                             F.col("valor_total").cast(MONEY).alias("valor"))
    lines = (itens.join(pedidos.select("id_pedido", "data_pedido"), "id_pedido")
             .select(F.lit("item").alias("tipo"), "id_pedido", F.col("data_pedido").cast("timestamp").alias("ts"),
                     F.col("subtotal").cast(MONEY).alias("valor")))
    return headers.unionByName(lines)


def partial_sums(events: DataFrame) -> DataFrame:
    """Per order: its header (value and time of the newest one), the sum and count of its lines, its last event."""
    header = F.when(F.col("tipo") == "pedido", F.struct("ts", "valor"))
    return events.groupBy("id_pedido").agg(
        F.max(header).alias("cabecalho"), F.sum(F.when(F.col("tipo") == "item", F.col("valor"))).alias("soma"),
        F.count_if(F.col("tipo") == "item").alias("itens"), F.max("ts").alias("ultimo"))


def start_alerts(events_stream: DataFrame, out_path: str, checkpoint: str, available_now: bool = True):
    """Run ST2: the partial sums of each micro-batch go to ``out_path``."""
    return write_epochs(events_stream, out_path, checkpoint, partial_sums, available_now)


def divergence_alerts(partials: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Alerts of the orders that are complete: header and line sum differ by more than 0.01."""
    newest = partials.agg(F.max("ultimo")).scalar()
    merged = partials.groupBy("id_pedido").agg(F.max("cabecalho").alias("_h"), F.sum("soma").alias("_s"),
                                               F.sum("itens").alias("_n"), F.max("ultimo").alias("_t"))
    value, total = F.col("_h.valor"), F.col("_s")
    return (merged.where((F.col("_t") <= newest - F.expr(f"INTERVAL {lateness}")) & (F.col("_n") > 0)
                         & (F.abs(value - total) > dec("0.01")))
            .select("id_pedido", F.to_date("_h.ts").alias("dia"), value.cast("double").alias("valor_registrado"),
                    total.cast("double").alias("valor_calculado"),
                    F.when(value > total, "SOBREFATURAMENTO").otherwise("SUBFATURAMENTO").alias("tipo_anomalia")))


def with_bound(events: DataFrame, newest: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(events whose time is at most ``newest``, the others and those without a time)."""
    newest = F.current_timestamp() + F.expr("INTERVAL 1 DAY") if newest is None else newest
    good = F.coalesce(F.col("ts") <= newest, F.lit(False))
    return events.where(good), events.where(~good)


def closed_orders(events: DataFrame, lateness: str = "2 days", gap: str = "2 days") -> DataFrame:
    """Per closed order: its header (value and time of the newest one), the sum and count of its lines."""
    header = F.when(F.col("tipo") == "pedido", F.struct("ts", "valor"))
    return (events.where(F.col("id_pedido").isNotNull() | (F.col("tipo") == "fim")).withWatermark("ts", lateness)
            .groupBy("id_pedido", F.session_window("ts", gap).alias("aberto"))
            .agg(F.max(header).alias("cabecalho"), F.sum(F.when(F.col("tipo") == "item", F.col("valor"))).alias("soma"),
                 F.count_if(F.col("tipo") == "item").alias("itens")))


def alert_rows(closed: DataFrame) -> DataFrame:
    """Alerts of closed orders: header and line sum differ by more than 0.01."""
    value, total = F.col("cabecalho.valor"), F.col("soma")
    return (closed.where((F.col("itens") > 0) & (F.abs(value - total) > dec("0.01")))
            .select("id_pedido", F.to_date("cabecalho.ts").alias("dia"), value.cast("double").alias("valor_registrado"),
                    total.cast("double").alias("valor_calculado"),
                    F.when(value > total, "SOBREFATURAMENTO").otherwise("SUBFATURAMENTO").alias("tipo_anomalia")))


def start_alert_stream(events_stream: DataFrame, out_path: str, checkpoint: str, lateness: str = "2 days", gap: str = "2 days",
                       newest: Column | None = None, available_now: bool = True):
    """Run ST2 with keyed state; (alert query, reject query), writing ``out_path``/alertas and /rejeitados.

    Events that come more than ``lateness`` behind the newest one before them are dropped by the
    watermark (Spark counts them in ``numRowsDroppedByWatermark``); an order whose events lie
    more than ``gap`` apart is judged by each stretch that has its header.  ``newest`` is the bound on event times
    (one day ahead of the batch's clock).
    """
    good, bad = with_bound(events_stream, newest)
    started = []
    for rows, name in ((alert_rows(closed_orders(good, lateness, gap)), "alertas"), (bad, "rejeitados")):
        w = (rows.writeStream.format("parquet").outputMode("append").option("path", f"{out_path}/{name}")
             .option("checkpointLocation", f"{checkpoint}/{name}"))
        started.append((w.trigger(availableNow=True) if available_now else w).start())
    return tuple(started)
