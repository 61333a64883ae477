"""ST1-ST3: repeats, late versions, conflicts and partial sums give the same rows however the micro-batches are cut."""

import datetime as dt
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from orderlens.streaming import alerts, audit, shares, sink

T0 = dt.datetime(2025, 1, 1, 10)
HOUR = dt.timedelta(hours=1)


def stream_of(spark, tmp_path, rows, schema, files):
    """A file stream that hands out one of ``files`` per trigger."""
    for k in range(files):
        spark.createDataFrame(rows[k::files], schema).coalesce(1).write.parquet(f"{tmp_path}/in/b={k}")
    return spark.readStream.schema(schema + ", b int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").drop("b")


@pytest.mark.parametrize("files", [1, 2, 5])
def test_audit_versions(spark, tmp_path, files):
    rows = [
        (1, 1, "100.00", "Pendente", "2025-01-05", T0),
        (1, 2, "120.00", "Pendente", "2025-01-05", T0 + HOUR),
        (1, 1, "100.00", "Pendente", "2025-01-05", T0 + HOUR),  # exact repeat
        (1, 3, "120.00", "Pendente", "2025-01-05", T0 + 2 * HOUR),  # nothing audited changed
        (2, 1, "10.00", "Executado", "2025-01-06", T0),
        (1, 2, "999.00", "Pendente", "2025-01-05", T0 + 3 * HOUR),  # late, lower version
        (2, 1, "11.00", "Executado", "2025-01-06", T0 + 3 * HOUR),  # same version, other data
        (3, 7, "5.00", None, None, T0 + 9000 * HOUR),  # a year on: nothing before it is dropped
    ]
    schema = "id_pedido long, versao int, valor_total string, status string, data_entrega string, ts timestamp"
    audit.start_audit(stream_of(spark, tmp_path, rows, schema, files), f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination()
    got = audit.audit_rows(spark.read.parquet(f"{tmp_path}/out")).collect()
    assert sorted((r.id_registro, r.versao, r.operacao, r.resultado) for r in got) == [
        (1, 1, "INSERT", "AUDITADO"), (1, 2, "UPDATE", "AUDITADO"), (1, 2, "UPDATE", "IGNORADO_VERSAO_ANTIGA"),
        (1, 3, "UPDATE", "SEM_ALTERACAO"), (2, 1, "INSERT", "AUDITADO"), (2, 1, "UPDATE", "CONFLITO_VERSAO"),
        (3, 7, "INSERT", "AUDITADO")]
    assert [r.dados_anteriores for r in got if r.operacao == "INSERT"] == [None] * 3


@pytest.mark.parametrize("files", [1, 3, 5])
def test_alerts_join_header_and_lines_of_different_days(spark, tmp_path, files):
    day = 24 * HOUR
    rows = [("pedido", 1, T0, "30.00"), ("item", 1, T0 + day, "10.00"), ("item", 1, T0 + 3 * day, "20.00"),  # adds up
            ("pedido", 2, T0, "30.00"), ("item", 2, T0 + 400 * day, "10.00"),  # diverges, lines a year later
            ("pedido", 3, T0, "5.00"),  # no lines
            ("item", 4, T0, "5.00"),  # no header
            ("pedido", 5, T0 + 800 * day, "9.00"), ("item", 5, T0 + 800 * day, "1.00"),  # may still get lines
            ("fim", None, T0 + 801 * day, None)]
    schema = "tipo string, id_pedido long, ts timestamp, valor string"
    stream = stream_of(spark, tmp_path, rows, schema, files)
    stream = stream.withColumn("valor", stream.valor.cast("decimal(15,2)"))
    alerts.start_alerts(stream, f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination()
    got = alerts.divergence_alerts(spark.read.parquet(f"{tmp_path}/out")).collect()
    assert [(r.id_pedido, r.valor_registrado, r.valor_calculado, r.tipo_anomalia) for r in got] == [(2, 30.0, 10.0, "SOBREFATURAMENTO")]


@pytest.mark.parametrize("files", [1, 2])
def test_newest_share_wins(spark, tmp_path, files):
    rows = [(1, "200.00", 3, T0 + HOUR), (1, "100.00", 2, T0), (2, "50.00", 1, T0)]
    stream = stream_of(spark, tmp_path, rows, "id_pedido long, valor_total string, versao int, ts timestamp", files)
    stream = stream.withColumn("valor_total", stream.valor_total.cast("decimal(15,2)"))
    table = spark.createDataFrame([(1, 10, "60.00"), (1, 11, "40.00"), (2, 10, "100.00")], "id_pedido long, id_cliente long, p string")
    table = table.select("id_pedido", "id_cliente", table.p.cast("decimal(5,2)").alias("percentual_rateio"))
    shares.start_share_refresh(stream, table, f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination()
    got = shares.current_shares(spark.read.parquet(f"{tmp_path}/out"))
    assert sorted((r.id_pedido, r.id_cliente, float(r.valor_rateado)) for r in got.collect()) == [(1, 10, 120.0), (1, 11, 80.0), (2, 10, 50.0)]


EVENT = "tipo string, id_pedido long, ts timestamp, valor string"
DAY = 24 * HOUR


def _alerts(spark, tmp_path, rows, files, lateness="60 days", gap="20 days"):
    """Rows in ``files`` triggers, then an end event, one run each; alerts and rejects."""
    for k in range(files):
        spark.createDataFrame(rows[k::files], EVENT).coalesce(1).write.parquet(f"{tmp_path}/in/b={k}")
    bound = (T0 + 365 * DAY).isoformat(sep=" ")

    def run():
        s = spark.readStream.schema(EVENT + ", b int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").drop("b")
        s = s.withColumn("valor", s.valor.cast("decimal(15,2)"))
        queries = alerts.start_alert_stream(s, f"{tmp_path}/out", f"{tmp_path}/ckpt", lateness, gap, F.lit(bound).cast("timestamp"))
        for q in queries:
            q.awaitTermination()
        return queries[0]
    run()
    open_rows = spark.read.parquet(f"{tmp_path}/out/alertas").count()
    spark.createDataFrame([("fim", None, T0 + 360 * DAY, None)], EVENT).coalesce(1).write.parquet(f"{tmp_path}/in/b=99")
    last = run()
    got = spark.read.parquet(f"{tmp_path}/out/alertas").collect()
    return sorted((r.id_pedido, r.valor_registrado, r.valor_calculado, r.tipo_anomalia) for r in got), spark.read.parquet(f"{tmp_path}/out/rejeitados").collect(), open_rows, last


@pytest.mark.parametrize("files,seed", [(1, 0), (3, 1), (5, 2), (5, 3)])
def test_alert_stream_in_any_file_order(spark, tmp_path, files, seed):
    rows = [("pedido", 1, T0, "30.00"), ("item", 1, T0 + DAY, "10.00"), ("item", 1, T0 + 3 * DAY, "20.00"),  # adds up
            ("pedido", 2, T0, "30.00"), ("item", 2, T0 + 19 * DAY, "10.00"),  # lines weeks later
            ("pedido", 3, T0, "5.00"),  # no lines
            ("item", 4, T0, "5.00"),  # no header
            ("pedido", 5, T0 + 40 * DAY, "9.00"), ("item", 5, T0 + 41 * DAY, "11.00"),
            ("item", 6, T0, "1.00"), ("pedido", 6, T0 + DAY, "2.00"), ("item", 6, T0 + 900_000 * HOUR, "1.00")]  # its second line is a century ahead
    random.Random(seed).shuffle(rows)
    got, rejected, early, last = _alerts(spark, tmp_path, rows, files)
    assert got == [(2, 30.0, 10.0, "SOBREFATURAMENTO"), (5, 9.0, 11.0, "SUBFATURAMENTO"), (6, 2.0, 1.0, "SOBREFATURAMENTO")]
    assert early == 0  # nothing closes before the watermark has passed it
    assert [(r.id_pedido, r.tipo) for r in rejected] == [(6, "item")]
    assert sum(p["stateOperators"][0]["numRowsTotal"] for p in last.recentProgress[-1:]) <= 1  # closed orders hold no state


def test_future_event_raises_no_alert(spark, tmp_path):
    """An event of 2999 completes no order: one with a line still to come stays open."""
    rows = [("pedido", 1, T0 + 350 * DAY, "30.00"), ("item", 1, T0 + 350 * DAY, "10.00"), ("item", 9, dt.datetime(2999, 1, 1), "1.00")]
    got, rejected, _, _ = _alerts(spark, tmp_path, rows, 1)
    assert got == [] and len(rejected) == 1


AUDIT_EVENTS = "id_pedido long, versao int, valor_total string, status string, data_entrega string, ts timestamp"


def _keyed(spark, tmp_path, rows, files):
    for k, part in enumerate(files):
        spark.createDataFrame([rows[i] for i in part], AUDIT_EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/b={k}")
        s = spark.readStream.schema(AUDIT_EVENTS + ", b int").parquet(f"{tmp_path}/in").drop("b")
        q = audit.start_audit_stream(s, f"{tmp_path}/out", f"{tmp_path}/ckpt")
        q.awaitTermination()
    out = audit.stored_audit(spark, f"{tmp_path}/out").collect()
    return sorted((r.id_registro, r.versao, r.operacao, r.resultado, r.dados_anteriores is None, r.tardio) for r in out), q


@pytest.mark.parametrize("cuts", [[range(8)], [range(3), range(3, 6), range(6, 8)]])
def test_keyed_audit_equals_the_batch_rule(spark, tmp_path, cuts):
    rows = [(1, 1, "100.00", "Pendente", "2025-01-05", T0), (2, 1, "10.00", "Executado", "2025-01-06", T0),
            (1, 2, "120.00", "Pendente", "2025-01-05", T0 + HOUR), (1, 2, "120.00", "Pendente", "2025-01-05", T0 + HOUR),  # exact repeat
            (1, 3, "120.00", "Pendente", "2025-01-05", T0 + 2 * HOUR), (1, 2, "999.00", "Pendente", "2025-01-05", T0 + 3 * HOUR),
            (2, 1, "11.00", "Executado", "2025-01-06", T0 + 3 * HOUR), (3, 7, "5.00", None, None, T0 + 9000 * HOUR)]
    got, q = _keyed(spark, tmp_path, rows, cuts)
    batch = audit.audit_rows(audit.prepare_events(spark.createDataFrame(rows, AUDIT_EVENTS))).collect()
    assert got == sorted((r.id_registro, r.versao, r.operacao, r.resultado, r.dados_anteriores is None, r.resultado == "IGNORADO_VERSAO_ANTIGA") for r in batch)
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2 * 3  # an order's top, and its place in the expiry index
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != audit.ROCKSDB


def test_keyed_audit_reads_no_history(spark, tmp_path):
    """The second run reads the new file only and finds version 1 in state; a version below comes to the late part."""
    rows = [(1, 3, "1.00", "P", None, T0 + HOUR), (1, 2, "2.00", "P", None, T0)]
    got, q = _keyed(spark, tmp_path, rows, [[0], [1]])
    assert got == [(1, 2, "UPDATE", "IGNORADO_VERSAO_ANTIGA", False, True), (1, 3, "INSERT", "AUDITADO", True, False)]
    assert q.lastProgress["numInputRows"] == 1
    assert audit.stored_audit(spark, f"{tmp_path}/out").where("tardio").count() == 1


def test_compaction_of_epochs(spark, tmp_path):
    """Reads take the compacted table and the epochs after it; a replayed epoch changes nothing."""
    out, cols = f"{tmp_path}/out", "id_pedido long, id_cliente long, valor_rateado double, ts timestamp, versao int"
    write = lambda k, rows: spark.createDataFrame(rows, cols).write.mode("overwrite").parquet(f"{out}/epoch={k}")
    read = lambda: sorted(tuple(r) for r in sink.read_compacted(spark, out, shares.newest_shares).select("id_pedido", "valor_rateado").collect())
    write(0, [(1, 1, 10.0, T0, 1), (2, 1, 5.0, T0, 1)])
    write(1, [(1, 1, 11.0, T0 + HOUR, 2)])
    assert read() == [(1, 11.0), (2, 5.0)]
    sink.compact_epochs(spark, out, shares.newest_shares, 1)
    write(2, [(2, 1, 6.0, T0 + 2 * HOUR, 2)])
    assert read() == [(1, 11.0), (2, 6.0)]
    write(0, [(1, 1, 99.0, T0 + 99 * HOUR, 99)])  # replay of a compacted epoch
    plan = sink.read_compacted(spark, out, shares.newest_shares)._jdf.queryExecution().executedPlan().toString()
    assert read() == [(1, 11.0), (2, 6.0)] and "(epoch#" in plan.split("PartitionFilters: ")[-1] and "> 1)" in plan
    sink.compact_epochs(spark, out, shares.newest_shares, 2)
    sink.compact_epochs(spark, out, shares.newest_shares, 1)  # no way back
    assert read() == [(1, 11.0), (2, 6.0)]


def test_refresh_sees_the_current_share_table(spark, tmp_path):
    """A share changed between two batches counts in the second."""
    change, share = "id_pedido long, valor_total string, versao int, ts timestamp", "id_pedido long, id_cliente long, p string"
    for k, (pct, value) in enumerate([("60.00", "100.00"), ("50.00", "200.00")]):
        spark.createDataFrame([(1, 10, pct)], share).selectExpr("id_pedido", "id_cliente", "cast(p as decimal(5,2)) percentual_rateio") \
            .write.mode("overwrite").parquet(f"{tmp_path}/shares")
        spark.createDataFrame([(1, value, k + 1, T0 + k * HOUR)], change).coalesce(1).write.parquet(f"{tmp_path}/in/b={k}")
        s = spark.readStream.schema(change + ", b int").parquet(f"{tmp_path}/in").drop("b")
        s = s.withColumn("valor_total", s.valor_total.cast("decimal(15,2)"))
        shares.start_share_refresh(s, lambda: spark.read.parquet(f"{tmp_path}/shares"), f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination()
    assert [float(r.valor_rateado) for r in shares.current_shares(spark.read.parquet(f"{tmp_path}/out")).collect()] == [100.0]


def test_keyed_audit_calls_the_state_once_per_bucket(spark, tmp_path, monkeypatch):
    """Many orders share a bucket's state: rows equal the batch rule, and the state has a row per bucket, not per order."""
    monkeypatch.setattr(audit, "BUCKETS", 4)
    rows = [(i, v, f"{i * (v > 1)}.00", "Pendente", None, T0 + v * HOUR) for i in range(60) for v in (1, 2, 3)]
    got, q = _keyed(spark, tmp_path, rows, [range(0, 100), range(100, 180)])
    batch = audit.audit_rows(audit.prepare_events(spark.createDataFrame(rows, AUDIT_EVENTS))).collect()
    want = [(r.id_registro, r.versao, r.operacao, r.resultado, r.dados_anteriores is None, r.resultado == "IGNORADO_VERSAO_ANTIGA") for r in batch]
    assert got == sorted(want) and len(got) == 180
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2 * 4


def test_order_expires_in_a_bucket_that_lives():
    """An order quiet for the time to live starts anew though its bucket's state is still read and written."""
    class State:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    trail = audit.AuditTrail(1000)
    trail.tops = State()
    event = lambda i, v, value: Row(id_pedido=i, versao=v, imagem=f"é{value}", campos=value, ts=T0)

    def batch(ms, *events):
        out = trail.handleInputRows((0,), iter(events), SimpleNamespace(getCurrentProcessingTimeInMs=lambda: ms))
        return [(r.id_registro, r.operacao, r.resultado, r.dados_anteriores) for r in out]
    assert batch(0, event(1, 1, "a"), event(2, 1, "a")) == [(1, "INSERT", "AUDITADO", None), (2, "INSERT", "AUDITADO", None)]
    assert batch(600, event(2, 2, "b")) == [(2, "UPDATE", "AUDITADO", "éa")]
    assert batch(1200, event(1, 1, "a"), event(2, 2, "b"), event(2, 3, "b")) == [(1, "INSERT", "AUDITADO", None), (2, "UPDATE", "SEM_ALTERACAO", "éb")]
