"""Reference dates and rolling periods."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Portuguese month abbreviations, January first.
MONTHS_PT = ["Jan", "Fev", "Mar", "Abr", "Mai", "Jun", "Jul", "Ago", "Set", "Out", "Nov", "Dez"]

RefDate = "str | _dt.date | Column | None"


def anchor_date(pedidos: DataFrame) -> Column:
    """Latest order date among non-cancelled orders, else today.

    Returned as a scalar subquery, so it stays inside the plan: Spark runs the
    one-row aggregate once and reuses it wherever the anchor appears.
    """
    latest = (pedidos.where(F.col("status") != "Cancelado")
              .agg(F.max("data_pedido").alias("anchor")))
    return F.coalesce(latest.scalar(), F.current_date())


def resolve_anchor(pedidos: DataFrame) -> _dt.date:
    """P3 evaluated once: the anchor as a value (one aggregate, one row to the driver).

    Pass it as ``ref_date`` when several operators share the anchor or when the
    order table is stored and clustered by date: a literal bound becomes a
    parquet pushed filter, a scalar subquery does not.
    """
    return (pedidos.where(F.col("status") != "Cancelado")
            .agg(F.coalesce(F.max("data_pedido"), F.current_date()).alias("a")).first()["a"])


def ref_column(pedidos: DataFrame, ref_date=None) -> Column:
    """The reference date as a DATE column: explicit value or the data anchor."""
    if ref_date is None:
        return anchor_date(pedidos)
    if isinstance(ref_date, Column):
        return ref_date.cast("date")
    if isinstance(ref_date, _dt.date):
        ref_date = ref_date.isoformat()
    return F.lit(str(ref_date)).cast("date")


def days_before(ref: Column, days: int) -> Column:
    """Ref - N days."""
    return F.date_sub(ref, int(days))


def months_before(ref: Column, months: int) -> Column:
    """Ref - N months with end-of-month clipping (31 May - 6 months = 30 Nov)."""
    return F.add_months(ref, -int(months))


def start_of_previous_year(ref: Column) -> Column:
    """1 January of the year before ``ref``."""
    return F.add_months(F.trunc(ref, "year"), -12)


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole days between two dates (integer)."""
    return F.datediff(later, earlier)


def month_label_pt(date_col: Column) -> Column:
    """Portuguese month abbreviation of a date."""
    return F.element_at(F.array(*[F.lit(m) for m in MONTHS_PT]), F.month(date_col))
