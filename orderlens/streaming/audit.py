"""ST1: order change feed -> audit rows.

``start_audit_stream`` keeps, per order, the highest version seen and its image in keyed state that
expires after a time to live, and writes each event's audit row once, as it comes: the history is never read
again and the state holds at most one entry per order, by buckets of orders.  Events below the stored version go to the late
part of the table.

``start_audit`` and ``audit_rows`` are the variant without state.  That stream appends distinct change
events by epoch, and the audit rows are derived from the events in event-time order, so they are the same however the
micro-batches were cut and in whatever order the files came: a version above all
earlier ones of its order is an INSERT (the first image), an UPDATE (value, status or
delivery date changed) or SEM_ALTERACAO; a lower one is late and IGNORADO; the same
version with another image is a CONFLITO.  Late events are kept, not dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from orderlens.session import ship_package
from orderlens.streaming.sink import write_epochs

AUDITED = ["valor_total", "status", "data_entrega"]
KEY = ["id_pedido", "versao", "imagem"]


def prepare_events(changes: DataFrame) -> DataFrame:
    """Order images as (id, version, JSON image, audited fields as one text, first time); exact
    repeats of (id, version, image) merge before the shuffle."""
    fields = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in AUDITED])
    image_cols = [c for c in changes.columns if c not in ("ts", "versao")]
    return (changes.select(F.col("id_pedido").cast("long").alias("id_pedido"), F.col("versao").cast("int").alias("versao"),
                           F.to_json(F.struct(*image_cols)).alias("imagem"), fields.alias("campos"), "ts")
            .groupBy(*KEY).agg(F.first("campos").alias("campos"), F.min("ts").alias("ts")))


def start_audit(changes_stream: DataFrame, out_path: str, checkpoint: str, available_now: bool = True):
    """Run ST1: the distinct events of each micro-batch go to ``out_path``."""
    return write_epochs(changes_stream, out_path, checkpoint, prepare_events, available_now)


def audit_rows(events: DataFrame) -> DataFrame:
    """The audit rows of the stored events (or of ``prepare_events`` of a batch).

    Only an order's own events meet, in one window over its versions; repeats that came in
    different epochs merge first."""
    once = events.groupBy(*KEY).agg(F.first("campos").alias("campos"), F.min("ts").alias("ts"))
    earlier = Window.partitionBy("id_pedido").orderBy("ts", "versao", "imagem").rowsBetween(Window.unboundedPreceding, -1)
    # of the events before: the highest version, and the image that came with it first
    top = F.max(F.struct("versao", (-F.unix_micros("ts")).alias("t"), "imagem", "campos")).over(earlier)
    e = once.withColumn("_p", top)
    result = (F.when(F.col("_p").isNull(), "AUDITADO")
              .when(F.col("versao") < F.col("_p.versao"), "IGNORADO_VERSAO_ANTIGA")
              .when(F.col("versao") == F.col("_p.versao"), "CONFLITO_VERSAO")
              .when(F.col("campos") != F.col("_p.campos"), "AUDITADO").otherwise("SEM_ALTERACAO"))
    return e.select(F.col("id_pedido").alias("id_registro"), "versao",
                    F.when(F.col("_p").isNull(), "INSERT").otherwise("UPDATE").alias("operacao"), result.alias("resultado"),
                    F.col("_p.imagem").alias("dados_anteriores"), F.col("imagem").alias("dados_novos"), "ts")


# Buckets of orders that share one row of state; fixed, as a checkpoint's state is by bucket.  Python calls the state store once per
# bucket and batch, not per order, and a bucket that a batch touches is read and written whole.
BUCKETS = 1 << 17

STATE = "pedidos string"  # JSON rows (id, version, image, audited fields, time of the last new version in ms)
AUDIT = ("id_registro long, versao int, operacao string, resultado string, dados_anteriores string, dados_novos string, ts timestamp, "
         "tardio boolean")
AUDIT_ROW = Row("id_registro", "versao", "operacao", "resultado", "dados_anteriores", "dados_novos", "ts", "tardio")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class AuditTrail(StatefulProcessor):
    """The audit rows of a bucket's events, each order's against its highest version so far."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tops = handle.getValueState("tops", STATE, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        now = timer_values.getCurrentProcessingTimeInMs()
        stored = self.tops.get()
        # an order's highest version, and when it came; orders quiet for the time to live start anew
        tops = {t[0]: tuple(t[1:]) for t in (json.loads(stored[0]) if stored else ()) if t[4] + self.ttl_ms > now}
        first = {}
        for r in rows:  # exact repeats count once, at their first time
            own = first.setdefault(r.id_pedido, {})
            k = (r.versao, r.imagem)
            if k not in own or r.ts < own[k].ts:
                own[k] = r
        changed = False
        for id_pedido, own in first.items():
            top = before = tops.get(id_pedido)
            for r in sorted(own.values(), key=lambda r: (r.ts, r.versao, r.imagem)):
                event = (r.versao, r.imagem, r.campos, now)
                if top is not None and event[:2] == top[:2]:
                    continue
                late = top is not None and r.versao < top[0]
                result = ("AUDITADO" if top is None else "IGNORADO_VERSAO_ANTIGA" if late else "CONFLITO_VERSAO" if r.versao == top[0]
                          else "AUDITADO" if r.campos != top[2] else "SEM_ALTERACAO")
                yield AUDIT_ROW(id_pedido, r.versao, "INSERT" if top is None else "UPDATE", result, None if top is None else top[1], r.imagem, r.ts, late)
                if top is None or r.versao > top[0]:
                    top = event
            if top is not before:
                tops[id_pedido] = top
                changed = True
        if changed:
            self.tops.update((json.dumps([(i, *top) for i, top in tops.items()], ensure_ascii=False, separators=(",", ":")),))

    def close(self) -> None:
        pass


def keyed_audit(changes: DataFrame, ttl: int) -> DataFrame:
    """Audit rows of a change stream, by keyed state in which an order lives ``ttl`` seconds after its last new version."""
    ship_package(changes.sparkSession)
    fields = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in AUDITED])
    image_cols = [c for c in changes.columns if c not in ("ts", "versao")]
    events = changes.select(F.col("id_pedido").cast("long").alias("id_pedido"), F.col("versao").cast("int").alias("versao"),
                            F.to_json(F.struct(*image_cols)).alias("imagem"), fields.alias("campos"), "ts")
    bucket = F.pmod(F.xxhash64("id_pedido"), F.lit(BUCKETS)).cast("int")
    return events.withColumn("balde", bucket).groupBy("balde").transformWithState(AuditTrail(ttl * 1000), AUDIT, "Append", "ProcessingTime")


def start_audit_stream(changes_stream: DataFrame, out_path: str, checkpoint: str, ttl: int = 90 * 86_400, available_now: bool = True):
    """Run ST1 with keyed state; audit rows go to ``out_path``/tardio=false, events below their order's version to /tardio=true.

    A version that comes after a higher one is late however the batches are cut, so rows
    equal the batch rule (``audit_rows``) where an order's events come in time order.  An order quiet for ``ttl``
    seconds (90 days) starts anew.  State is kept in RocksDB, so that it may outgrow the executors' memory.
    """
    spark = changes_stream.sparkSession
    # read when the query starts; a batch without data would follow another for ever, as expiry by the clock is never done
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        w = (keyed_audit(changes_stream, ttl).writeStream.format("parquet").outputMode("append").partitionBy("tardio")
             .option("path", out_path).option("checkpointLocation", checkpoint))
        return (w.trigger(availableNow=True) if available_now else w).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stored_audit(spark: SparkSession, out_path: str) -> DataFrame:
    """The audit rows that ``start_audit_stream`` has written; ``tardio`` tells the late part."""
    return spark.read.parquet(out_path).withColumn("tardio", F.col("tardio").cast("boolean"))
