"""Named operators over the test tables: name -> (spark, sf_dir) -> DataFrame.

Each entry loads the stand-in order tables for ``sf_dir`` and runs one
operator over them, whole.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orderlens.operators import rfv
from orderlens.session import checkpoint_dir
from orderlens.sources.adapter import Tables, load_test_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(load_test_tables(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


# ---------------------------------------------------------------- RFV
@register("R1_rfv_fixed")
def _r1(t):
    return rfv.rfv_fixed(t.pedidos, t.clientes)


@register("R2_rfm_scores")
def _r2(t):
    return rfv.rfm_scores(t.pedidos, t.clientes)


@register("R3_rfv_test_scores")
def _r3(t):
    return rfv.rfv_test_scores(t.pedidos)


@register("R4_segment_counts")
def _r4(t):
    return rfv.segment_counts(t.pedidos)


@register("R5_segment_counts_anchor")
def _r5(t):
    return rfv.segment_counts(t.pedidos, accented=False)


@register("R6_segment_kpis")
def _r6(t):
    return rfv.segment_kpis(rfv.rfv_fixed(t.pedidos, t.clientes))


@register("R7_segment_summary")
def _r7(t):
    return rfv.segment_summary(rfv.rfv_fixed(t.pedidos, t.clientes))


@register("R8_region_summary")
def _r8(t):
    return rfv.region_summary(rfv.rfv_fixed(t.pedidos, t.clientes))


@register("R9_recency_histogram")
def _r9(t):
    return rfv.recency_histogram(rfv.rfv_fixed(t.pedidos, t.clientes))


@register("R9b_value_box")
def _r9b(t):
    return rfv.value_box(rfv.rfv_fixed(t.pedidos, t.clientes))


@register("R10_top_customers")
def _r10(t):
    return rfv.top_customers(rfv.rfv_fixed(t.pedidos, t.clientes))


# ---------------------------------------------------------------- products
from orderlens.operators import products  # noqa: E402

# parameter: a category that occurs in the test tables (the model's own is 'Commodity')
PR8_CATEGORY = "STANDARD"


@register("PR1_product_revenue")
def _pr1(t):
    return products.product_revenue(t.itens_pedido, t.pedidos, t.produtos)


@register("PR2_top_products_pct")
def _pr2(t):
    return products.top_products_pct(products.product_revenue(t.itens_pedido, t.pedidos, t.produtos))


@register("PR3_margin_ranking")
def _pr3(t):
    return products.margin_ranking(t.itens_pedido, t.pedidos, t.produtos)


@register("PR4_margin_top")
def _pr4(t):
    return products.margin_top(t.itens_pedido, t.pedidos, t.produtos)


@register("PR5_top_share_of_total")
def _pr5(t):
    return products.top_share_of_total(t.itens_pedido, t.pedidos, t.produtos)


@register("PR6_product_kpis")
def _pr6(t):
    return products.product_kpis(products.margin_ranking(t.itens_pedido, t.pedidos, t.produtos))


@register("PR7_top_revenue_all_time")
def _pr7(t):
    return products.top_revenue_all_time(t.itens_pedido, t.pedidos, t.produtos)


@register("PR8_seasonality")
def _pr8(t):
    return products.seasonality(t.itens_pedido, t.pedidos, t.produtos, categoria=PR8_CATEGORY)


# ---------------------------------------------------------------- trends
from orderlens.operators import trends  # noqa: E402

# parameters: a year and quarter present in the test tables
TR9_YEAR, TR9_QUARTER = 2000, 2


@register("TR1_monthly_trend")
def _tr1(t):
    return trends.monthly_trend(t.pedidos)


@register("TR2_monthly_trend_ytd")
def _tr2(t):
    return trends.monthly_trend_ytd(t.pedidos)


@register("TR3_monthly_trend_test")
def _tr3(t):
    return trends.monthly_trend_test(t.pedidos)


@register("TR4_trend_kpis")
def _tr4(t):
    return trends.trend_kpis(trends.monthly_trend(t.pedidos, exact=True))


@register("TR5_trend_table")
def _tr5(t):
    return trends.trend_table(trends.monthly_trend(t.pedidos, exact=True))


@register("TR6_year_month_matrix")
def _tr6(t):
    return trends.year_month_matrix(t.pedidos)


@register("TR7_year_comparison")
def _tr7(t):
    return trends.year_comparison(trends.year_month_matrix(t.pedidos, exact=True))


@register("TR8_chart_feed")
def _tr8(t):
    return trends.chart_feed(trends.monthly_trend(t.pedidos, exact=True))


@register("TR9_trend_year_quarter")
def _tr9(t):
    return trends.monthly_trend(t.pedidos, ano=TR9_YEAR, trimestre=TR9_QUARTER)


# ---------------------------------------------------------------- inactivity
from orderlens.operators import inactivity  # noqa: E402


@register("IN1_inactive_customers")
def _in1(t):
    return inactivity.inactive_customers(t.pedidos, t.clientes)


@register("IN2_inactive_or_never")
def _in2(t):
    return inactivity.inactive_or_never(t.pedidos, t.clientes)


@register("IN3_inactive_six_months")
def _in3(t):
    return inactivity.inactive_six_months(t.pedidos, t.clientes)


@register("IN4_inactivity_kpis")
def _in4(t):
    return inactivity.inactivity_kpis(inactivity.inactive_customers(t.pedidos, t.clientes, min_days=90))


@register("IN5_inactivity_by_region")
def _in5(t):
    return inactivity.inactivity_by_region(inactivity.inactive_customers(t.pedidos, t.clientes, min_days=90))


@register("IN6_inactivity_labels")
def _in6(t):
    return inactivity.inactivity_labels(inactivity.inactive_customers(t.pedidos, t.clientes))


# ---------------------------------------------------------------- divergence and correction
from pyspark.sql import functions as F  # noqa: E402

from orderlens.operators import dashboard, divergence  # noqa: E402

# parameter: the run timestamp written on correction rows (fixed for repeatable output)
CORRECTION_TIME = "2001-08-02 10:00:00"
AUDIT_REF = "2002-06-15 10:00:00"


def _log_view(log):
    return log.select("id_correcao", "id_pedido", "campo_corrigido",
                      F.col("valor_anterior").cast("double").alias("valor_anterior"),
                      F.col("valor_novo").cast("double").alias("valor_novo"),
                      "tipo_correcao", "usuario_correcao", "motivo_correcao",
                      F.date_format("data_correcao", "yyyy-MM-dd HH:mm:ss").alias("data_correcao"))


def _batch_log(t, with_log=True):
    log0 = divergence.empty_log(t.spark)
    return divergence.correct_all_pending(t.pedidos, t.itens_pedido, t.clientes, log0,
                                          quando=CORRECTION_TIME, with_log=with_log)


@register("C1_divergences_period")
def _c1(t):
    return divergence.divergences_period(t.pedidos, t.itens_pedido, t.clientes)


@register("C2_divergences_all")
def _c2(t):
    return divergence.divergences_all(t.pedidos, t.itens_pedido, t.clientes)


@register("C3_divergences_relative")
def _c3(t):
    return divergence.divergences_relative(t.pedidos, t.itens_pedido)


C4_ATE = "1995-06-30"


@register("C4_anomaly_view")
def _c4(t):
    """The log holds the corrections of the orders up to C4_ATE; the others are pending."""
    keys = t.pedidos.where(F.col("data_pedido") <= F.lit(C4_ATE).cast("date"))
    _, log, _ = divergence.correct_orders(t.pedidos, t.itens_pedido, keys, divergence.empty_log(t.spark), quando=CORRECTION_TIME)
    return divergence.anomaly_view(t.pedidos, t.itens_pedido, t.clientes, log)


@register("C5_correct_orders")
def _c5(t):
    result, _, _ = divergence.correct_orders(t.pedidos, t.itens_pedido, t.pedidos.select("id_pedido"),
                                             divergence.empty_log(t.spark), quando=CORRECTION_TIME, with_log=False)
    return result


@register("C6_correct_all_pending_log")
def _c6(t):
    _, log, _ = _batch_log(t)
    return _log_view(log)


@register("C6b_correct_all_summary")
def _c6b(t):
    _, _, summary = _batch_log(t, with_log=False)
    return summary


@register("C7_correction_history")
def _c7(t):
    _, log, _ = _batch_log(t)
    return divergence.correction_history(log)


@register("C8_alert_counts")
def _c8(t):
    from orderlens.operators.inactivity import inactive_customers
    return divergence.alert_counts(divergence.divergences_period(t.pedidos, t.itens_pedido, t.clientes),
                                   inactive_customers(t.pedidos, t.clientes))


# ---------------------------------------------------------------- dashboard and exploration
# parameters: a region and a product term present in the test tables
B1_REGION, B1_PRODUCT = "AMERICA", "Brand#1"


def _filtered(t):
    return dashboard.filtered_orders(t.pedidos, t.clientes, t.itens_pedido, t.produtos,
                                     regiao=B1_REGION, produto=B1_PRODUCT)


@register("B0_headline_metrics")
def _b0(t):
    return dashboard.headline_metrics(t.pedidos, t.clientes)


@register("B1_dashboard_kpis")
def _b1(t):
    return dashboard.dashboard_kpis(_filtered(t), t.clientes)


@register("B1b_dashboard_top_products")
def _b1b(t):
    return dashboard.dashboard_top_products(_filtered(t), t.itens_pedido, t.produtos)


@register("B1c_dashboard_monthly")
def _b1c(t):
    return dashboard.dashboard_monthly(_filtered(t), legacy=True)


@register("B2_value_histogram")
def _b2(t):
    return dashboard.value_histogram(t.pedidos)


@register("B3_ticket_box_by_segment")
def _b3(t):
    return dashboard.ticket_box_by_segment(t.pedidos)


@register("B4_items_value_sample")
def _b4(t):
    return dashboard.items_value_sample(t.pedidos, t.itens_pedido)


@register("B5_customer_correlations")
def _b5(t):
    return dashboard.customer_correlations(t.pedidos)


@register("B6_exploration_kpis")
def _b6(t):
    return dashboard.exploration_kpis(t.pedidos)


@register("B7_summary_totals")
def _b7(t):
    return dashboard.summary_totals(t.pedidos, t.clientes, t.produtos)


@register("B7b_orders_by_status")
def _b7b(t):
    return dashboard.orders_by_status(t.pedidos)


@register("B8_top_customers_by_value")
def _b8(t):
    return dashboard.top_customers_by_value(t.pedidos, t.clientes)


@register("B9_context_snapshot")
def _b9(t):
    return dashboard.context_snapshot(t.pedidos, t.clientes, t.itens_pedido, t.produtos)


# ---------------------------------------------------------------- shared purchases
from orderlens.operators import sharing  # noqa: E402


def _shares_view(shares):
    return shares.select("id_pedido", "id_cliente",
                         F.col("percentual_rateio").cast("double").alias("percentual_rateio"),
                         F.col("valor_rateado").cast("double").alias("valor_rateado"))


@register("H1_shared_participants")
def _h1(t):
    return sharing.shared_participants(t.pedido_clientes, t.pedidos, t.clientes)


@register("H2_sharing_kpis")
def _h2(t):
    return sharing.sharing_kpis(t.pedido_clientes, t.pedidos)


@register("H3_sharing_by_region")
def _h3(t):
    return sharing.sharing_by_region(t.pedido_clientes, t.clientes)


@register("H4_generate_shares")
def _h4(t):
    return _shares_view(sharing.generate_shares(t.pedidos, t.clientes))


@register("H5_create_shared_orders")
def _h5(t):
    """Re-create every shared order from JSON owner/line requests built from the shares."""
    req, req_lines = sharing.requests_from_shares(t.pedido_clientes, t.pedidos, t.itens_pedido)
    orders, owners, lines, rejected = sharing.create_shared_orders(req, t.pedidos, req_lines)
    return orders.select("id_pedido", F.date_format("data_pedido", "yyyy-MM-dd").alias("data_pedido"),
                         F.date_format("data_entrega", "yyyy-MM-dd").alias("data_entrega"), "id_cliente",
                         "tipo_contrato", "status", F.col("valor_total").cast("double").alias("valor_total"))


def _created(t, part):
    req, req_lines = sharing.requests_from_shares(t.pedido_clientes, t.pedidos, t.itens_pedido)
    return sharing.create_shared_orders(req, t.pedidos, req_lines)[part]


@register("H5b_shared_order_owners")
def _h5b(t):
    return _created(t, 1).select("id_pedido", "id_cliente", F.col("percentual_propriedade").cast("double").alias("percentual_propriedade"),
                                 F.col("valor_proporcional").cast("double").alias("valor_proporcional"), "tipo_participacao")


@register("H5c_shared_order_lines")
def _h5c(t):
    return _created(t, 2).select("id_pedido", "id_produto", *[F.col(c).cast("double").alias(c) for c in ("quantidade", "preco_unitario", "subtotal")])


@register("H5d_rejected_requests")
def _h5d(t):
    """Requests without owners, with broken JSON, without a client and with owners short of 100 %, by order id."""
    req, req_lines = sharing.requests_from_shares(t.pedido_clientes, t.pedidos, t.itens_pedido)
    k = F.col("id_solicitacao") % 5
    broken = (F.when(k == 0, "[]").when(k == 1, "{bad").when(k == 2, '[{"percentual":100}]')
              .when(k == 3, '[{"cliente_id":1,"percentual":60.5},{"cliente_id":2,"percentual":39}]').otherwise(F.col("proprietarios")))
    return sharing.create_shared_orders(req.withColumn("proprietarios", broken), t.pedidos, req_lines)[3]


@register("H6_refresh_proportional_values")
def _h6(t):
    corrected, _, _ = _batch_log(t, with_log=False)
    return _shares_view(sharing.refresh_proportional_values(t.pedido_clientes, t.pedidos, corrected))


@register("H7_share_check")
def _h7(t):
    return sharing.share_check(t.pedido_clientes)


@register("H8_ownership_view")
def _h8(t):
    return sharing.ownership_view(t.pedidos, t.clientes, t.pedido_clientes)


@register("H9_active_groups")
def _h9(t):
    return sharing.active_groups(t.grupos_compra, t.cliente_grupo, t.clientes).select(
        "id_grupo", "nome_grupo", "tipo_grupo", "representante_id", "representante", "total_membros")


@register("H10_group_members")
def _h10(t):
    """Active members of the first group."""
    return sharing.group_members(t.cliente_grupo, t.clientes, 1).select(
        "id_cliente", "nome", "tipo_cliente", "regiao", F.col("percentual_participacao").cast("double").alias("percentual_participacao"),
        F.date_format("data_entrada", "yyyy-MM-dd").alias("data_entrada"))


@register("H11_order_documents")
def _h11(t):
    """Documents of all orders, owners and lines written out as text in their order."""
    docs = sharing.order_documents(t.pedidos, t.pedido_clientes, t.itens_pedido, t.produtos, clientes=t.clientes)
    text = lambda rows, *fields: F.array_join(F.transform(rows, lambda x: F.concat_ws("|", *[x[f].cast("string") for f in fields])), ";")
    return docs.select("id_pedido", "parte", "partes", F.date_format("data_pedido", "yyyy-MM-dd").alias("data_pedido"), "id_cliente", "status",
                       F.col("valor_total").cast("double").alias("valor_total"),
                       text("proprietarios", "id_cliente", "nome", "tipo_cliente", "percentual", "valor").alias("proprietarios"),
                       text("itens", "id_produto", "produto_nome", "quantidade", "preco_unitario", "subtotal").alias("itens"))


# ---------------------------------------------------------------- lineage, integrity, duplicates
from orderlens.operators import lineage, publishing  # noqa: E402
from orderlens.sources.versions import read_published  # noqa: E402


def _traced_view(df):
    return df.select("id_pedido", "numero_pedido", "chave_unica", "hash_integridade", "versao")


@register("L1_order_numbers")
def _l1(t):
    """Order numbers, natural keys and integrity hashes (L1, L2, L3)."""
    return _traced_view(lineage.traced_orders(t.pedidos))


@register("L4_audit_rows")
def _l4(t):
    """Audit rows between the orders and their batch-corrected version."""
    corrected, _, _ = _batch_log(t, with_log=False)
    rows = lineage.audit_rows(t.pedidos, corrected, "SISTEMA", CORRECTION_TIME)
    return rows.withColumn("data_hora", F.date_format("data_hora", "yyyy-MM-dd HH:mm:ss"))


@register("L4b_audit_summary")
def _l4b(t):
    """Audit operations per type between the orders up to a year before the newest and the corrected
    orders from a year after the oldest: inserts, deletes and updates."""
    corrected, _, _ = _batch_log(t, with_log=False)
    newest, oldest = (t.pedidos.agg(f("data_pedido")).scalar() for f in (F.max, F.min))
    audit = lineage.audit_rows(t.pedidos.where(F.col("data_pedido") <= F.add_months(newest, -12)),
                               corrected.where(F.col("data_pedido") >= F.add_months(oldest, 12)), "SISTEMA", CORRECTION_TIME)
    return audit.groupBy("tabela_afetada", "operacao").agg(F.count(F.lit(1)).alias("registros"))


@register("L5_stamp_updates")
def _l5(t):
    """Version stamping of the batch corrections on traced orders."""
    traced = lineage.traced_orders(t.pedidos)
    corrected, _, _ = _batch_log(t, with_log=False)
    changed = corrected.join(t.pedidos.select("id_pedido", F.col("valor_total").alias("_old")), "id_pedido") \
        .where(F.col("valor_total") != F.col("_old")).drop("_old")
    ok, _ = lineage.stamp_updates(traced, changed, "SISTEMA", CORRECTION_TIME)
    return ok.select("id_pedido", "versao", "hash_integridade",
                     F.col("valor_total").cast("double").alias("valor_total"))


@register("L6_integrity_report")
def _l6(t):
    """Integrity of traced orders after values were changed outside the system (C6 values)."""
    traced = lineage.traced_orders(t.pedidos)
    corrected, _, _ = _batch_log(t, with_log=False)
    current = traced.drop("valor_total").join(corrected.select("id_pedido", "valor_total"), "id_pedido")
    return lineage.integrity_report(current)


@register("L5b_refused_updates")
def _l5b(t):
    """Refused corrections: orders whose stored row was changed outside the system (here every seventh id's status)."""
    traced = lineage.traced_orders(t.pedidos)
    altered = traced.withColumn("status", F.when(F.col("id_pedido") % 7 == 0, F.concat("status", F.lit("*"))).otherwise(F.col("status")))
    corrected, _, _ = _batch_log(t, with_log=False)
    changed = corrected.join(t.pedidos.select("id_pedido", F.col("valor_total").alias("_old")), "id_pedido") \
        .where(F.col("valor_total") != F.col("_old")).drop("_old")
    _, refused = lineage.stamp_updates(altered, changed, "SISTEMA", CORRECTION_TIME)
    return refused


@register("L7_traced_view")
def _l7(t):
    """The traced view after every seventh order's status was changed outside the system: those are CORROMPIDO."""
    traced = lineage.traced_orders(t.pedidos)
    altered = traced.withColumn("status", F.when(F.col("id_pedido") % 7 == 0, F.concat("status", F.lit("*"))).otherwise(F.col("status")))
    corrected, _, _ = _batch_log(t, with_log=False)
    audit = lineage.audit_rows(t.pedidos, corrected, "SISTEMA", CORRECTION_TIME)
    return lineage.traced_view(altered.select(*traced.columns), t.clientes, audit)


@register("L8_duplicate_candidates")
def _l8(t):
    return lineage.duplicate_links(t.pedidos, t.clientes)


@register("L8b_duplicate_groups")
def _l8b(t):
    return lineage.duplicate_groups(lineage.duplicate_links(t.pedidos, t.clientes))


@register("L9_duplicate_alerts")
def _l9(t):
    alerts = lineage.duplicate_alerts(lineage.duplicate_links(t.pedidos, t.clientes), CORRECTION_TIME)
    return alerts.select("tabela", "registros", "similaridade", "motivo",
                         F.date_format("data_detecao", "yyyy-MM-dd HH:mm:ss").alias("data_detecao"))


@register("L10_audit_retention")
def _l10(t):
    corrected, _, _ = _batch_log(t, with_log=False)
    audit = lineage.audit_rows(t.pedidos, corrected, "SISTEMA", CORRECTION_TIME)
    _, removed = lineage.retain_audit(audit, "2003-09-01", years=2)
    return removed


@register("L10b_retained_audit")
def _l10b(t):
    """The stored audit table after retention: corrections dated on their orders' days, between 8 and 12 o'clock, and a limit
    of 10 o'clock on a day in their midst."""
    corrected, _, _ = _batch_log(t, with_log=False)
    audit = lineage.audit_rows(t.pedidos, corrected, "SISTEMA", CORRECTION_TIME)
    day = F.get_json_object("dados_novos", "$.data_pedido").cast("timestamp")
    audit = audit.withColumn("data_hora", day + F.make_dt_interval(hours=(8 + F.col("id_registro") % 5).cast("int")))
    path = _scratch(t, "l10")
    lineage.write_audit_table(audit, path)
    lineage.retain_audit_table(t.spark, path, AUDIT_REF, years=2)
    return t.spark.read.parquet(path).select("tabela_afetada", "operacao", "id_registro", F.date_format("data_hora", "yyyy-MM-dd HH:mm:ss").alias("data_hora"))


@register("L4c_published_correction")
def _l4c(t):
    """Corrected orders of the version published after the first one, with their audit row and their shares' sum."""
    path = _scratch(t, "versions")
    t.pedidos = t.pedidos.checkpoint(eager=True)  # numbering and shares start from the orders, derived once
    publishing.first_version(t.spark, path, t.pedidos, t.itens_pedido, t.clientes, t.pedido_clientes)
    publishing.correct_published(t.spark, path, quando=CORRECTION_TIME)
    read = lambda name: read_published(t.spark, path, name)
    shares = read("pedido_clientes").groupBy("id_pedido").agg(F.sum("valor_rateado").cast("double").alias("valor_rateado"))
    audit = read("audit_log").select(F.col("id_registro").alias("id_pedido"), "operacao", F.get_json_object("dados_anteriores", "$.versao").cast("int").alias("versao_anterior"))
    return (read("pedidos").select("id_pedido", "versao", F.col("valor_total").cast("double").alias("valor_total"))
            .join(audit, "id_pedido").join(shares, "id_pedido", "left"))


@register("N1_item_keys")
def _n1(t):
    """Contiguous surrogate keys of the order lines (distributed numbering)."""
    return t.itens_pedido_com_id.select("id_item", "id_pedido", "id_produto",
                                        F.col("subtotal").cast("double").alias("subtotal"))


# ---------------------------------------------------------------- data quality
from orderlens.operators import quality  # noqa: E402


def _model_tables(t, with_item_ids=False):
    return {"clientes": t.clientes, "produtos": t.produtos, "pedidos": t.pedidos,
            "itens_pedido": t.itens_pedido_com_id if with_item_ids else t.itens_pedido,
            "pedido_clientes": t.pedido_clientes}


@register("Q1_constraint_report")
def _q1(t):
    return quality.constraint_report(_model_tables(t))


@register("Q2_key_report")
def _q2(t):
    return quality.key_report(_model_tables(t, with_item_ids=True))


@register("Q2b_line_keys")
def _q2b(t):
    """Keys that the lines bring along: order and line number, which must be one, and order and product, which need not."""
    lines = t.raw("lineitem").select(F.col("l_orderkey").alias("id_pedido"), F.col("l_linenumber").alias("numero_linha"), F.col("l_partkey").alias("id_produto"))
    return quality.key_report({"itens_pedido": lines}, [("itens_pedido", ["id_pedido", "numero_linha"]), ("itens_pedido", ["id_pedido", "id_produto"]),
                                                        ("itens_pedido", ["id_produto"])])


@register("Q3_orphan_report")
def _q3(t):
    return quality.orphan_report(_model_tables(t))


@register("Q4_header_vs_lines")
def _q4(t):
    return quality.header_vs_lines(t.pedidos, t.itens_pedido)


# ---------------------------------------------------------------- sources and browsing
from orderlens.sources import browse  # noqa: E402
from orderlens.sources import io as sio  # noqa: E402

# parameters: an order-date range, a search term and page present in the test tables
S9_INICIO, S9_FIM = "2000-01-01", "2000-12-31"
S12_TERM, S12_PAGE = "customer#0000001", 2


@register("S4_row_counts")
def _s4(t):
    return sio.row_counts({"clientes": t.clientes, "produtos": t.produtos, "pedidos": t.pedidos,
                           "itens_pedido": t.itens_pedido})


@register("S5_high_water_marks")
def _s5(t):
    return sio.high_water_marks({"clientes": t.clientes, "produtos": t.produtos, "pedidos": t.pedidos,
                                 "itens_pedido": t.chaves_itens})


@register("S6_data_page_customers")
def _s6a(t):
    return browse.data_page_customers(t.clientes)


@register("S6b_data_page_orders")
def _s6b(t):
    return browse.data_page_orders(t.pedidos, t.clientes)


@register("S6c_data_page_items")
def _s6c(t):
    return browse.data_page_items(t.itens_pedido_com_id, t.produtos)


@register("S7_customer_browse")
def _s7(t):
    return browse.customer_browse(t.clientes)


@register("S8_product_browse")
def _s8(t):
    return browse.product_browse(t.produtos)


@register("S9_order_browse")
def _s9(t):
    return browse.order_browse(t.pedidos, t.clientes, S9_INICIO, S9_FIM)


@register("S6d_data_page_products")
def _s6d(t):
    return browse.data_page_products(t.produtos)


@register("S10_item_browse")
def _s10(t):
    return browse.data_page_items(t.itens_pedido_com_id, t.produtos)


@register("S1_tables_written_and_read")
def _s1(t):
    """The order tables written, read again with their schemas and conformed: rows and sum of keys."""
    base = f"{checkpoint_dir(t.spark)}/s1-{uuid.uuid4().hex}"
    tables = {"clientes": t.clientes, "produtos": t.produtos, "pedidos": t.pedidos}
    sio.write_tables(tables, base)
    read = sio.load_tables(t.spark, base, names=list(tables))
    out = None
    for name, df in read.items():
        part = sio.conform(name, df).agg(F.count(F.lit(1)).alias("registros"), F.sum(sio.KEYS[name]).alias("soma_chaves"))
        part = part.select(F.lit(name).alias("tabela"), "registros", "soma_chaves")
        out = part if out is None else out.unionByName(part)
    return out


@register("S11_json_records")
def _s11(t):
    return sio.as_json_records(browse.customer_browse(t.clientes))


@register("S12_search_page")
def _s12(t):
    return browse.search_page(browse.customer_browse(t.clientes), S12_TERM, ["nome", "regiao"],
                              [F.col("id_cliente").asc()], page=S12_PAGE)


@register("S12b_next_page")
def _s12b(t):
    """The page after page 2 of S12, sought from that page's last row."""
    last = _s12(t).agg(F.max("id_cliente")).first()[0]
    return browse.next_page(browse.customer_browse(t.clientes), S12_TERM, ["nome", "regiao"], [("id_cliente", True)], {"id_cliente": last})


@register("S14_customer_pick_list")
def _s14(t):
    return browse.customer_pick_list(t.clientes)


# ---------------------------------------------------------------- text
from orderlens.operators import intent  # noqa: E402

# parameter: the conversations hold pseudo-words, so the registered lexicon uses
# fragments that occur in them (the model's own lexicon is intent.LEXICO_COM_DADOS)
X2_LEXICON = [("produto", ["ment"]), ("risco", ["sch"]), ("anomalia", ["ö", "ß"]), ("tendencia", ["tion"])]


@register("X2_intent_tags")
def _x2(t):
    msgs = t.raw("conversations").select("conv_id", "turn", "role", "text")
    return intent.tag_messages(msgs, "text", X2_LEXICON).drop("text")


@register("X2b_intent_counts")
def _x2b(t):
    msgs = t.raw("conversations").select("conv_id", "turn", "role", "text")
    return intent.intent_counts(intent.tag_messages(msgs, "text", X2_LEXICON), ["role"])


# ---------------------------------------------------------------- streaming
from orderlens.streaming import alerts as st_alerts  # noqa: E402
from orderlens.streaming import audit as st_audit  # noqa: E402
from orderlens.streaming import shares as st_shares  # noqa: E402
from orderlens.streaming import sink  # noqa: E402


def _scratch(t, tag):
    return f"{checkpoint_dir(t.spark)}/{tag}-{uuid.uuid4().hex}"


@register("ST1_audit_stream")
def _st1(t):
    """Change feed of every order (version 1) and its batch correction (version 2)
    through the keyed audit stream."""
    base = _scratch(t, "st1")
    t.pedidos.withColumn("versao", F.lit(1)).withColumn("ts", F.col("data_pedido").cast("timestamp")).write.parquet(f"{base}/in/part=1")
    pedidos = t.spark.read.parquet(f"{base}/in/part=1").drop("versao", "ts")  # derived once; the correction starts from the stored orders
    corrected, _, _ = divergence.correct_all_pending(pedidos, t.itens_pedido, t.clientes, divergence.empty_log(t.spark),
                                                     quando=CORRECTION_TIME, with_log=False)
    changed = corrected.join(pedidos.select("id_pedido", F.col("valor_total").alias("_old")), "id_pedido") \
        .where(F.col("valor_total") != F.col("_old")).drop("_old")
    v2 = changed.withColumn("versao", F.lit(2)).withColumn("ts", F.col("data_pedido").cast("timestamp")
                                                           + F.expr("INTERVAL 1 HOUR"))
    v2.write.parquet(f"{base}/in/part=2")
    schema = t.spark.read.parquet(f"{base}/in").schema
    stream = t.spark.readStream.schema(schema).parquet(f"{base}/in")
    st_audit.start_audit_stream(stream.drop("part"), f"{base}/out", f"{base}/ckpt").awaitTermination()
    return t.spark.read.parquet(f"{base}/out").select("id_registro", "versao", "operacao", "resultado")


@register("ST2_divergence_alerts")
def _st2(t):
    """Header and line events of all orders through the keyed alert stream; an end-of-stream
    event, within the bound on event times, closes the last orders."""
    base = _scratch(t, "st2")
    ev = st_alerts.order_events(t.pedidos, t.itens_pedido)
    ev.write.parquet(f"{base}/in/b=0")
    stored = t.spark.read.parquet(f"{base}/in")
    newest = stored.agg(F.max("ts")).first()[0] or datetime.datetime(1970, 1, 1)
    end = t.spark.range(1).select(F.lit("fim").alias("tipo"), F.lit(None).cast("long").alias("id_pedido"),
                                  F.lit(newest + datetime.timedelta(days=10)).alias("ts"), F.lit(None).cast("decimal(15,2)").alias("valor"))
    end.write.parquet(f"{base}/in/b=1")
    stream = t.spark.readStream.schema(stored.schema).parquet(f"{base}/in").drop("b")
    queries = st_alerts.start_alert_stream(stream, f"{base}/out", f"{base}/ckpt", newest=F.lit(newest + datetime.timedelta(days=30)))
    for q in queries:
        q.awaitTermination()
    alerts = t.spark.read.parquet(f"{base}/out/alertas")
    return alerts.select("id_pedido", F.date_format("dia", "yyyy-MM-dd").alias("dia"), "valor_registrado",
                         "valor_calculado", "tipo_anomalia")


@register("ST3_share_refresh_stream")
def _st3(t):
    """Value changes of the batch correction as a stream refreshing the shares."""
    base = _scratch(t, "st3")
    corrected, _, _ = _batch_log(t, with_log=False)
    changed = (corrected.join(t.pedidos.select("id_pedido", F.col("valor_total").alias("_old")), "id_pedido")
               .where(F.col("valor_total") != F.col("_old"))
               .select("id_pedido", "valor_total", F.lit(2).alias("versao"),
                       F.col("data_pedido").cast("timestamp").alias("ts")))
    changed.write.parquet(f"{base}/in")
    stream = t.spark.readStream.schema(changed.schema).parquet(f"{base}/in")
    sharing.generate_shares(t.pedidos, t.clientes).write.parquet(f"{base}/shares")
    q = st_shares.start_share_refresh(stream, lambda: t.spark.read.parquet(f"{base}/shares"), f"{base}/out", f"{base}/ckpt")
    q.awaitTermination()
    sink.compact_epochs(t.spark, f"{base}/out", st_shares.newest_shares, 0)
    return _shares_view(sink.read_compacted(t.spark, f"{base}/out", st_shares.newest_shares).drop("ts", "versao"))


@register("W1_purchase_gaps")
def _w1(t):
    return rfv.purchase_gaps(t.pedidos)


# ---------------------------------------------------------------- option variants
@register("R9c_rfv_points")
def _r9c(t):
    return rfv.rfv_points(rfv.rfv_fixed(t.pedidos, t.clientes))


@register("B1d_dashboard_monthly_chronological")
def _b1d(t):
    return dashboard.dashboard_monthly(_filtered(t), legacy=False)


@register("B2b_value_histogram_hole_free")
def _b2b(t):
    return dashboard.value_histogram(t.pedidos, hole_free=True)


@register("R6b_segment_kpis_filtered")
def _r6b(t):
    """Segment counts of one region."""
    return rfv.segment_kpis(rfv.rfv_fixed(t.pedidos, t.clientes), regiao="AMERICA")


@register("IN4b_inactivity_kpis_min_days")
def _in4b(t):
    """Inactivity totals of customers quiet for 200 days or more."""
    return inactivity.inactivity_kpis(inactivity.inactive_customers(t.pedidos, t.clientes, min_days=90), min_days=200)


@register("TR6b_year_columns")
def _tr6b(t):
    """Month table with a column of sales and orders per year (A12, wide form)."""
    return trends.year_columns(trends.year_month_matrix(t.pedidos), datetime.date(2001, 1, 1))


@register("Q1b_violating_rows")
def _q1b(t):
    return quality.violating_rows("pedidos", t.pedidos, "id_pedido")


@register("H11b_order_document_sizes")
def _h11b(t):
    """Structure of the order documents: parts, owners and lines per document."""
    docs = sharing.order_documents(t.pedidos, t.pedido_clientes, t.itens_pedido, t.produtos)
    return docs.select("id_pedido", "parte", "partes",
                       F.size("proprietarios").cast("long").alias("n_proprietarios"),
                       F.size("itens").cast("long").alias("n_itens"))
