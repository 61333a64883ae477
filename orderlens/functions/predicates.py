"""Reusable row predicates (P1, P5-P9, P14) as Spark Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.numeric import dec


def not_cancelled(status: str = "status") -> Column:
    """Status != 'Cancelado' (NULL status is dropped too, as in SQL)."""
    return F.col(status) != "Cancelado"


def in_closed_range(col: str, inicio=None, fim=None) -> Column:
    """P5: optional inclusive bounds; absent bounds impose nothing."""
    cond = F.lit(True)
    if inicio is not None:
        cond = cond & (F.col(col) >= F.lit(str(inicio)).cast("date"))
    if fim is not None:
        cond = cond & (F.col(col) <= F.lit(str(fim)).cast("date"))
    return cond


def region_filter(df: DataFrame, regiao: str | None, column: str = "regiao") -> DataFrame:
    """Region equality; '' / 'todas' / None mean no filter."""
    if regiao is None or regiao == "" or regiao.lower() == "todas":
        return df
    return df.where(F.col(column) == regiao)


def like_escape(term: str) -> str:
    """Escape LIKE wildcards so a user term matches literally."""
    return term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def abs_divergence(a: Column, b: Column, tol: str = "0.01") -> Column:
    """|a - b| > tol (decimal arithmetic)."""
    return F.abs(a - b) > dec(tol)


def rel_divergence(a: Column, b: Column, fraction: str = "0.05") -> Column:
    """|a - b| > fraction * b."""
    return F.abs(a - b) > b * dec(fraction)


def active(col: str = "ativo") -> Column:
    """Active-row flag."""
    return F.col(col) == F.lit(True)
