"""Order numbering, integrity hashes, audit trail, duplicates.

Triggers and sequences of a row store become set operations over table
versions: numbering is a distributed ranking, the audit trail is a full outer
join of a before and an after snapshot, and stale hashes are found by
recomputing them in one projection.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.functions.numeric import cents, dec, rhu_div
from orderlens.plans.ordered import with_runs
from orderlens.plans.ranking import with_global_row_number
from orderlens.session import checkpoint_dir

# Order number prefix, width of its sequence part and the first value
# of the per-year sequences that are declared (other years start at 1).
PREFIXO = "AGR"
LARGURA_SEQ = 6
INICIO_SEQ = {2024: 10001, 2025: 20001}
# Audited columns and the duplicate rule (value gap below 10 %).
CAMPOS_AUDITADOS = ["valor_total", "status", "data_entrega"]
LIMIAR_DUPLICIDADE = "0.10"


def order_numbers(pedidos: DataFrame, starts: dict[int, int] | None = None) -> DataFrame:
    """L1 + L2: per-year order number AGR-<year>-<6-digit sequence> in (date, id) order,
    and the natural key <client>-<yyyymmdd>-<number>."""
    starts = INICIO_SEQ if starts is None else starts
    base = pedidos.withColumn("_ano", F.year("data_pedido"))
    ranked = with_global_row_number(base, [F.col("_ano").asc_nulls_first(), F.col("data_pedido").asc(),
                                           F.col("id_pedido").asc()], "_rn")
    first = ranked.groupBy("_ano").agg(F.min("_rn").alias("_first"))
    start = F.lit(1)
    for year, s in sorted(starts.items()):
        start = F.when(F.col("_ano") == year, F.lit(s)).otherwise(start)
    seq = start + F.col("_rn") - F.col("_first")
    numero = F.concat(F.lit(PREFIXO + "-"), F.col("_ano").cast("string"), F.lit("-"),
                      _padded(seq))
    first = F.broadcast(first.withColumnRenamed("_ano", "_de"))  # one row per year; orders without a date have no number
    out = ranked.join(first, F.col("_ano").eqNullSafe(F.col("_de"))).drop("_de").withColumn("numero_pedido", numero)
    out = out.withColumn("chave_unica", natural_key(F.col("id_cliente"), F.col("data_pedido"), F.col("numero_pedido")))
    return out.drop("_ano", "_rn", "_first")


def _padded(seq) -> F.Column:
    """The sequence with zeros up to LARGURA_SEQ digits; longer ones keep all their digits."""
    s = seq.cast("string")
    return F.when(F.length(s) < LARGURA_SEQ, F.lpad(s, LARGURA_SEQ, "0")).otherwise(s)


def natural_key(id_cliente, data_pedido, numero):
    """L2: <client>-<yyyymmdd>-<number>; NULL when a part is."""
    return F.concat(id_cliente.cast("string"), F.lit("-"), F.date_format(data_pedido, "yyyyMMdd"), F.lit("-"), numero)


def integrity_hash(df: DataFrame) -> F.Column:
    """L3: SHA-256 hex of id|number|client|value|status|date; NULL fields become ''.
    The value prints with its 2 decimals, the date as yyyy-MM-dd."""
    parts = [F.col("id_pedido").cast("string"), F.col("numero_pedido"), F.col("id_cliente").cast("string"),
             F.col("valor_total").cast("decimal(15,2)").cast("string"), F.col("status"),
             F.date_format("data_pedido", "yyyy-MM-dd")]
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def traced_orders(pedidos: DataFrame, starts: dict[int, int] | None = None) -> DataFrame:
    """Orders with number, natural key, integrity hash and version 1."""
    o = order_numbers(pedidos, starts)
    return o.withColumn("hash_integridade", integrity_hash(o)).withColumn("versao", F.lit(1))


def integrity_report(current: DataFrame) -> DataFrame:
    """VALIDO / CORROMPIDO per hashed order (stored hash vs the hash of the current row)."""
    h = integrity_hash(current)
    return (current.where(F.col("hash_integridade").isNotNull())
            .select("id_pedido", "numero_pedido",
                    F.when(F.col("hash_integridade") == h, "VALIDO").otherwise("CORROMPIDO").alias("status"),
                    F.col("hash_integridade").alias("hash_armazenado"), h.alias("hash_calculado")))


def _image(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(F.col("id_pedido").alias(f"{prefix}id"), F.struct(*df.columns).alias(f"{prefix}row"),
                     *[F.col(c).alias(f"{prefix}{c}") for c in CAMPOS_AUDITADOS])


def audit_rows(before: DataFrame, after: DataFrame, usuario: str | None = None, quando=None,
               tabela: str = "pedidos") -> DataFrame:
    """L4: audit rows from two snapshots -- INSERT (only after), DELETE (only before),
    UPDATE when value, status or delivery date changed (IS DISTINCT FROM); before and
    after images as JSON, printed for these rows only."""
    when_ts = F.current_timestamp() if quando is None else F.lit(str(quando)).cast("timestamp")
    b, a = _image(before, "b_"), _image(after, "a_")
    j = b.join(a, F.col("b_id") == F.col("a_id"), "full_outer")
    changed = F.lit(False)
    for c in CAMPOS_AUDITADOS:
        changed = changed | ~F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}"))
    op = (F.when(F.col("b_id").isNull(), "INSERT").when(F.col("a_id").isNull(), "DELETE")
          .when(changed, "UPDATE"))
    return (j.withColumn("operacao", op).where(F.col("operacao").isNotNull())
            .select(F.lit(tabela).alias("tabela_afetada"), "operacao",
                    F.coalesce("a_id", "b_id").alias("id_registro"),
                    F.when(F.col("operacao") != "INSERT", F.to_json("b_row")).alias("dados_anteriores"),
                    F.when(F.col("operacao") != "DELETE", F.to_json("a_row")).alias("dados_novos"),
                    F.lit(usuario).cast("string").alias("usuario_aplicacao"),
                    when_ts.alias("data_hora")))


def stamp_updates(current: DataFrame, updates: DataFrame, usuario: str | None = None, quando=None):
    """Apply ``updates`` (new images keyed by id_pedido) to ``current`` traced orders.

    Rows whose stored hash no longer matches their stored data are refused
    (INTEGRIDADE_COMPROMETIDA); accepted rows get version + 1, update stamp and a
    new hash of the after-image.  Returns (accepted new images, refused ids).
    """
    when_ts = F.current_timestamp() if quando is None else F.lit(str(quando)).cast("timestamp")
    check = current.select("id_pedido", "numero_pedido", "versao", "hash_integridade",
                           integrity_hash(current).alias("_h"))
    stale = F.col("hash_integridade").isNotNull() & (F.col("hash_integridade") != F.col("_h"))
    u = updates.drop("numero_pedido", "versao", "hash_integridade", "chave_unica").join(check, "id_pedido")
    refused = u.where(stale).select("id_pedido", F.lit("INTEGRIDADE_COMPROMETIDA").alias("motivo"))
    ok = u.where(~stale).withColumn("versao", F.col("versao") + 1)
    ok = (ok.withColumn("hash_integridade", integrity_hash(ok))
          .withColumn("updated_at", when_ts).withColumn("updated_by", F.lit(usuario).cast("string"))
          .drop("_h"))
    return ok, refused


def traced_view(pedidos: DataFrame, clientes: DataFrame, audit: DataFrame) -> DataFrame:
    """Orders, all their columns, with customer name, last change time, change count (0 when
    none) and integrity status -- audit pre-aggregated per order, then a left join."""
    per = (audit.where(F.col("tabela_afetada") == "pedidos").groupBy("id_registro")
           .agg(F.max("data_hora").alias("ultima_alteracao"), F.count(F.lit(1)).alias("_n"))
           .withColumnRenamed("id_registro", "id_pedido"))
    h = integrity_hash(pedidos)
    return (pedidos.join(clientes.select("id_cliente", F.col("nome").alias("cliente_nome")), "id_cliente")
            .join(per, "id_pedido", "left")
            .select(*[F.date_format(c, "yyyy-MM-dd").alias(c) if c in ("data_pedido", "data_entrega")
                      else F.col(c).cast("double").alias(c) if c == "valor_total" else F.col(c) for c in pedidos.columns], "cliente_nome",
                    F.date_format("ultima_alteracao", "yyyy-MM-dd HH:mm:ss").alias("ultima_alteracao"),
                    F.coalesce("_n", F.lit(0)).alias("total_alteracoes"),
                    F.when(F.col("hash_integridade") == h, "VALIDO").otherwise("CORROMPIDO").alias("status_integridade")))


_BAND = math.log(1 / 0.9)  # one bucket = a value ratio of 0.9


def duplicate_candidates(pedidos: DataFrame, clientes: DataFrame) -> DataFrame:
    """Pairs (id1 < id2) of the same customer and day whose values differ by less
    than 10 % of the larger (``por_valor``), or with the same delivery date; similarity in percent.

    All pairs, as the model's function lists them: n like orders give n * (n - 1) / 2 rows, so this is for groups of
    a known size (``duplicate_links`` gives the same groups in linear space).  Value pairs come from a
    band join on log-scale value buckets (a qualifying pair is at most one bucket
    apart; neighbours are tried and the exact decimal test decides), delivery pairs
    from an equi-join on the delivery date.  Zero values never qualify by value
    (the ratio is undefined), only by delivery date.
    """
    o = pedidos.select("id_pedido", "id_cliente", "data_pedido", "data_entrega", "valor_total")
    v = F.col("valor_total")
    bucket = F.when(v > 0, F.floor(F.log(v.cast("double")) / _BAND)).cast("long")
    left = o.withColumn("_b", bucket).where(F.col("_b").isNotNull())
    right = (left.withColumn("_b", F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1))))
    l1 = left.select(*[F.col(c).alias(c + "_1") for c in o.columns], "_b")
    r2 = right.select(*[F.col(c).alias(c + "_2") for c in o.columns], "_b")
    keys1 = (l1.id_cliente_1 == r2.id_cliente_2) & (l1.data_pedido_1 == r2.data_pedido_2)
    gap = F.abs(F.col("valor_total_1") - F.col("valor_total_2"))
    top = F.greatest("valor_total_1", "valor_total_2")
    by_value = (l1.join(r2, keys1 & (l1._b == r2._b) & (l1.id_pedido_1 < r2.id_pedido_2))
                .where(gap < top * dec(LIMIAR_DUPLICIDADE))
                .select("id_pedido_1", "id_pedido_2", F.lit(True).alias("por_valor")))
    a1 = o.select(*[F.col(c).alias(c + "_1") for c in o.columns])
    a2 = o.select(*[F.col(c).alias(c + "_2") for c in o.columns])
    by_delivery = (a1.join(a2, (a1.id_cliente_1 == a2.id_cliente_2) & (a1.data_pedido_1 == a2.data_pedido_2)
                           & (a1.data_entrega_1 == a2.data_entrega_2) & (a1.id_pedido_1 < a2.id_pedido_2))
                   .select("id_pedido_1", "id_pedido_2", F.lit(False).alias("por_valor")))
    pairs = by_value.unionByName(by_delivery).groupBy("id_pedido_1", "id_pedido_2").agg(F.max("por_valor").alias("por_valor"))
    p1 = o.select(*[F.col(c).alias(c + "_1") for c in o.columns])
    p2 = o.select(F.col("id_pedido").alias("id_pedido_2"), F.col("valor_total").alias("valor_total_2"))
    j = pairs.join(p1, "id_pedido_1").join(p2, "id_pedido_2")
    gap = F.abs(F.col("valor_total_1") - F.col("valor_total_2"))
    top = F.greatest("valor_total_1", "valor_total_2")
    # 100 - 100 * gap / max, rounded to 2 dp as an exact integer quotient
    sim = F.when(F.col("valor_total_1") == F.col("valor_total_2"), F.lit(100.0)).otherwise(
        rhu_div((cents(top) - cents(gap)) * 10000, cents(top)) / 100.0)
    return (j.join(clientes.select(F.col("id_cliente").alias("id_cliente_1"), F.col("nome").alias("cliente")),
                   "id_cliente_1")
            .select("id_pedido_1", "id_pedido_2", "cliente",
                    F.date_format("data_pedido_1", "yyyy-MM-dd").alias("data_pedido"),
                    F.col("valor_total_1").cast("double").alias("valor_1"),
                    F.col("valor_total_2").cast("double").alias("valor_2"),
                    sim.cast("double").alias("similaridade"), "por_valor"))


def _similarity(a, b):
    """100 - 100 * gap / larger value, rounded to 2 dp as an exact integer quotient; 100 for equal values."""
    top, gap = F.greatest(a, b), F.abs(a - b)
    return F.when(a == b, F.lit(100.0)).otherwise(rhu_div((cents(top) - cents(gap)) * 10000, cents(top)) / 100.0).cast("double")


def duplicate_links(pedidos: DataFrame, clientes: DataFrame) -> DataFrame:
    """L8 without pairs: each order beside its neighbour in a group of like orders, one row per order and criterion at most.

    Orders of one customer and day are like by value (``por_valor``) when they differ by less than 10 % of the larger, or
    by delivery date.  Sorted by (value, id), two like orders have only like neighbours between them,
    so the groups that all pairs would connect are the runs in which each order is like the one before it.
    ``grupo`` is the id of a run's first order; every other order of it gives one row with the order before
    it (``id_pedido_1``), the nearest below in value.  ``n`` like orders give n - 1 rows.  Zero values are like by delivery only;
    NULL customers, days, values and delivery dates are like nothing.
    """
    o = (pedidos.select("id_pedido", "id_cliente", "data_pedido", "data_entrega", "valor_total")
         .where(F.col("id_cliente").isNotNull() & F.col("data_pedido").isNotNull() & F.col("valor_total").isNotNull()))
    checkpoint_dir(pedidos.sparkSession)
    o = o.checkpoint(eager=True)  # five columns, written once: both criteria sample and sort them
    order = [F.col("valor_total").asc(), F.col("id_pedido").asc()]
    v, before = F.col("valor_total"), F.col("antes_valor_total")
    by_value = with_runs(o.where(v > 0), ["id_cliente", "data_pedido"], order, ["valor_total"],
                         v - before < v * dec(LIMIAR_DUPLICIDADE), "id_pedido", "grupo", "antes_")
    by_delivery = with_runs(o.where(F.col("data_entrega").isNotNull()), ["id_cliente", "data_pedido", "data_entrega"], order, ["valor_total"],
                            F.col("antes_id_pedido").isNotNull(), "id_pedido", "grupo", "antes_")
    links = by_value.withColumn("por_valor", F.lit(True)).unionByName(by_delivery.withColumn("por_valor", F.lit(False)))
    return (links.where(F.col("grupo") != F.col("id_pedido"))
            .join(clientes.select("id_cliente", F.col("nome").alias("cliente")), "id_cliente")
            .select("grupo", F.col("antes_id_pedido").alias("id_pedido_1"), F.col("id_pedido").alias("id_pedido_2"), "cliente",
                    F.date_format("data_pedido", "yyyy-MM-dd").alias("data_pedido"), before.cast("double").alias("valor_1"),
                    v.cast("double").alias("valor_2"), _similarity(before, v).alias("similaridade"), "por_valor"))


def duplicate_groups(links: DataFrame) -> DataFrame:
    """One row per group of like orders: its size, value range and nearest pair's similarity."""
    return (links.groupBy("por_valor", "grupo", "cliente", "data_pedido")
            .agg((F.count(F.lit(1)) + 1).alias("tamanho"), F.min("valor_1").alias("menor_valor"), F.max("valor_2").alias("maior_valor"),
                 F.max("similaridade").alias("maior_similaridade")))


def duplicate_alerts(candidates: DataFrame, quando=None) -> DataFrame:
    """Alert rows -- ids as a JSON array, similarity, reason, open (no resolution)."""
    when_ts = F.current_timestamp() if quando is None else F.lit(str(quando)).cast("timestamp")
    return candidates.select(
        F.lit("pedidos").alias("tabela"),
        F.to_json(F.array("id_pedido_1", "id_pedido_2")).alias("registros"),
        F.col("similaridade"),
        F.when(F.col("por_valor"), "Mesmo cliente e data, valores a menos de 10%")
         .otherwise("Mesmo cliente, data e entrega").alias("motivo"),
        when_ts.alias("data_detecao"),
        F.lit(None).cast("timestamp").alias("data_resolucao"),
        F.lit(None).cast("string").alias("resolvido_por"),
        F.lit(None).cast("string").alias("acao_tomada"))


def retain_audit(audit: DataFrame, ref_date, years: int = 2) -> tuple[DataFrame, DataFrame]:
    """Audit retention -- rows older than ``years`` before ``ref_date`` are dropped, rows without a time stay.
    Returns (kept rows, one-row count of removed rows); the caller writes the kept rows
    as the audit table's next version (``retain_audit_table`` rewrites a stored table in place)."""
    old = F.coalesce(F.col("data_hora") < _limit(ref_date, years), F.lit(False))
    return audit.where(~old), audit.agg(F.count_if(old).alias("removidos"))


def _limit(ref_date, years: int):
    return F.add_months(F.lit(str(ref_date)).cast("timestamp"), -12 * years) if len(str(ref_date)) <= 10 \
        else F.lit(str(ref_date)).cast("timestamp") - F.make_ym_interval(F.lit(years), F.lit(0))


def write_audit_table(audit: DataFrame, path: str) -> None:
    """Append audit rows to the stored audit table, one partition per month (``mes``) of ``data_hora``."""
    audit.withColumn("mes", F.date_format("data_hora", "yyyy-MM")).hint("rebalance", "mes").write.mode("append").partitionBy("mes").parquet(path)


def retain_audit_table(spark: SparkSession, path: str, ref_date, years: int = 2) -> int:
    """L10 on the stored audit table: partitions of months before the limit's go as whole folders, unread; the limit's own month
    is rewritten alone (dynamic partition overwrite) and later months are not touched.  Rows without a
    time stay in their own partition.  Returns the number of partitions that went."""
    limit = _limit(ref_date, years).cast("timestamp")
    row = spark.range(1).select(limit.alias("t"), F.date_format(limit, "yyyy-MM").alias("mes")).first()
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return 0
    months = {f.getPath().getName()[4:]: f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith("mes=")}
    gone = [mes for mes in months if mes[:1].isdigit() and mes < row.mes]
    if row.mes in months:
        kept = spark.read.parquet(path).where((F.col("mes") == row.mes) & (F.col("data_hora") >= F.lit(row.t)))
        if kept.limit(1).count():
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("mes").parquet(path)
        else:
            gone.append(row.mes)
    for mes in gone:
        fs.delete(months[mes], True)
    return len(gone)
