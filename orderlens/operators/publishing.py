"""The batch correction as one published version: C6 -> H6 -> L5 -> L4 over one snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.operators import divergence, lineage, sharing
from orderlens.session import checkpoint_dir
from orderlens.sources.versions import publish, read_published

STAMPED = ["valor_total", "versao", "hash_integridade", "updated_at", "updated_by"]


def first_version(spark: SparkSession, path: str, pedidos: DataFrame, itens: DataFrame, clientes: DataFrame, shares: DataFrame) -> int:
    """Publish traced orders (L1-L3), lines, customers, shares, an empty correction log and an empty audit trail."""
    traced = (lineage.traced_orders(pedidos).withColumn("updated_at", F.lit(None).cast("timestamp"))
              .withColumn("updated_by", F.lit(None).cast("string")))
    audit = lineage.audit_rows(traced.limit(0), traced.limit(0))
    return publish(spark, path, {"pedidos": traced, "itens_pedido": itens, "clientes": clientes, "pedido_clientes": shares,
                                 "log_correcoes": divergence.empty_log(spark), "audit_log": audit,
                                 "recusados": spark.createDataFrame([], "id_pedido long, motivo string")})


def correct_published(spark: SparkSession, path: str, usuario: str = "SISTEMA", quando=None) -> int:
    """Correct all pending orders of the newest version and publish the result as the next one; returns its number.

    All result tables come from one stored snapshot: corrected values (C6), stamped with version and hash unless the stored row was
    tampered with (L5; those orders stay as they are, unlogged, and are listed in ``recusados``), shares in
    proportion (H6), log and audit rows (L4) of exactly the orders that differ between the two versions.
    Corrected orders are no longer pending, so a second run publishes no change.  Changed, accepted and refused orders are
    stored once, and shares and audit rows start from the written orders, so that no table derives them again."""
    checkpoint_dir(spark)
    names = ("pedidos", "itens_pedido", "clientes", "pedido_clientes", "log_correcoes", "audit_log")
    t = {name: read_published(spark, path, name) for name in names}
    orders = t["pedidos"]
    corrected, new_log, _ = divergence.correct_all_pending(orders, t["itens_pedido"], t["clientes"], t["log_correcoes"], usuario, quando)
    old = orders.select("id_pedido", F.col("valor_total").alias("_old"))
    changed = corrected.join(old, "id_pedido").where(~F.col("valor_total").eqNullSafe(F.col("_old"))).drop("_old", "updated_at", "updated_by").checkpoint(eager=True)
    accepted, refused = lineage.stamp_updates(orders, changed, usuario, quando)
    accepted, refused = accepted.checkpoint(eager=True), refused.checkpoint(eager=True)
    new = accepted.select("id_pedido", F.struct(*STAMPED).alias("_new"))
    after = (orders.join(new, "id_pedido", "left")
             .select(*[F.when(F.col("_new").isNotNull(), F.col("_new").getField(c)).otherwise(F.col(c)).alias(c) if c in STAMPED else F.col(c)
                       for c in orders.columns]))
    return publish(spark, path, {
        "pedidos": after, "itens_pedido": t["itens_pedido"], "clientes": t["clientes"],
        "pedido_clientes": lambda written: sharing.refresh_proportional_values(t["pedido_clientes"], orders, written("pedidos")),
        "log_correcoes": t["log_correcoes"].unionByName(new_log.join(refused.select("id_pedido"), "id_pedido", "left_anti").select(*t["log_correcoes"].columns)),
        "audit_log": lambda written: t["audit_log"].unionByName(lineage.audit_rows(orders, written("pedidos"), usuario, quando)), "recusados": refused})
