"""Distributed descriptive statistics: histograms (A14), box summaries (A15),
correlation matrices (A7) and the strongest off-diagonal value (A16).

Exact quantiles of a whole table are selected (``selection``) without sorting it.
Those of groups come from the distributed ranking (X1): rows are numbered in
(group, value, id) order, so each group is a contiguous range of numbers; the
few order statistics each quartile needs are picked by conditional aggregates
and interpolated linearly -- nothing is collected per group, so a group
holding a third of the rows costs no more than any other.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.plans.ranking import with_global_row_number
from orderlens.plans.selection import keys_at
from orderlens.session import checkpoint_dir

QUARTILES = [("q1", 0.25), ("mediana", 0.5), ("q3", 0.75)]


def equal_width_histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """``bins`` equal-width bins over [min, max] of an integer column.

    Bin i covers [min + i*w, min + (i+1)*w), the last bin is closed; the bin
    index is computed with integer arithmetic.  Empty bins are kept.
    """
    v = F.col(col).cast("long")
    # bounds as scalar subqueries (one aggregate, evaluated once)
    lo = df.agg(F.min(v)).scalar()
    hi = df.agg(F.max(v)).scalar()
    span = hi - lo
    idx = F.when(span == 0, F.lit(0)).otherwise(
        F.least(F.call_function("div", (v - lo) * bins, F.nullif(span, F.lit(0))), F.lit(bins - 1)))
    counts = df.select(idx.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("contagem"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (spine.join(counts, "bin", "left")
            .select("bin", (lo + F.call_function("div", span * F.col("bin"), F.lit(bins))).alias("limite_inferior"),
                    F.coalesce("contagem", F.lit(0)).alias("contagem")))


def grouped_box(df: DataFrame, groups: list[str], value: str, tiebreak: str) -> DataFrame:
    """Per group n, min, q1, median, q3, max, 1.5*IQR whiskers and outlier count.

    Quartiles use linear interpolation between order statistics at
    (n - 1) * p, the usual 'linear' / ``quantile_cont`` definition.
    """
    v = F.col(value).cast("double")
    base = df.select(*groups, v.alias("_v"), F.col(tiebreak).alias("_id"))
    if not groups:
        return _global_box(base)
    order = [F.col(g).asc_nulls_first() for g in groups] + [F.col("_v").asc(), F.col("_id").asc()]
    ranked = with_global_row_number(base, order, "_rn")
    # each group is a contiguous range of row numbers: attach its first number and size
    g = ranked.groupBy(*groups).agg(F.min("_rn").alias("_start"), F.count(F.lit(1)).alias("_cnt"))
    r2 = _join_null_safe(ranked, g, groups)
    picks = []
    for name, p in QUARTILES:
        pos = (F.col("_cnt") - 1) * F.lit(p)
        picks += [F.max(F.when(F.col("_rn") == F.col("_start") + F.floor(pos), F.col("_v"))).alias(name + "_lo"),
                  F.max(F.when(F.col("_rn") == F.col("_start") + F.ceil(pos), F.col("_v"))).alias(name + "_hi")]
    stats = _interpolate(r2.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("minimo"),
                                                 F.max("_v").alias("maximo"), *picks))
    inside = (_join_null_safe(r2, stats.select(*groups, "_lf", "_uf"), groups)
              .groupBy(*groups)
              .agg(F.count_if((F.col("_v") < F.col("_lf")) | (F.col("_v") > F.col("_uf"))).alias("outliers"),
                   F.min(F.when(F.col("_v") >= F.col("_lf"), F.col("_v"))).alias("bigode_inferior"),
                   F.max(F.when(F.col("_v") <= F.col("_uf"), F.col("_v"))).alias("bigode_superior")))
    return (_join_null_safe(stats, inside, groups)
            .select(*groups, "n", "minimo", "q1", "mediana", "q3", "maximo", "iqr",
                    "bigode_inferior", "bigode_superior", "outliers"))


def _join_null_safe(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` in which NULL meets NULL (the NULL group is a group)."""
    b = b.select(*[F.col(c).alias(f"_k_{c}") if c in keys else F.col(c) for c in b.columns])
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return a.join(b, on).drop(*[f"_k_{c}" for c in keys])


def _interpolate(stats: DataFrame) -> DataFrame:
    for name, p in QUARTILES:
        pos = (F.col("n") - 1) * F.lit(p)
        frac = pos - F.floor(pos)
        lo, hi = F.col(name + "_lo"), F.col(name + "_hi")
        stats = stats.withColumn(name, lo + (hi - lo) * frac)
    return (stats.withColumn("iqr", F.col("q3") - F.col("q1"))
            .withColumn("_lf", F.col("q1") - F.col("iqr") * 1.5)
            .withColumn("_uf", F.col("q3") + F.col("iqr") * 1.5))


def _global_box(base: DataFrame) -> DataFrame:
    """Box summary of all rows: the order statistics of the quartiles are selected (``selection.keys_at``), and one
    aggregate beside them gives the rest.  The two columns are written once, as they are read for each step."""
    checkpoint_dir(base.sparkSession)
    base = base.checkpoint(eager=True)
    n = base.count()
    places = [(name, (n - 1) * p) for name, p in QUARTILES] if n else []
    ranks = sorted({f(pos) + 1 for _, pos in places for f in (math.floor, math.ceil)})
    at = {r: k["_v"] for r, k in zip(ranks, keys_at(base, [("_v", True), ("_id", True)], ranks, n))}
    q = {name: None for name, _ in QUARTILES}
    for name, pos in places:
        lo, hi = at[math.floor(pos) + 1], at[math.ceil(pos) + 1]
        q[name] = None if lo is None or hi is None else lo + (hi - lo) * (pos - math.floor(pos))
    iqr = None if q["q1"] is None or q["q3"] is None else q["q3"] - q["q1"]
    double = lambda x: F.lit(x).cast("double")
    lf, uf = (double(None), double(None)) if iqr is None else (double(q["q1"] - iqr * 1.5), double(q["q3"] + iqr * 1.5))
    v = F.col("_v")
    rest = base.agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("minimo"), F.max(v).alias("maximo"),
                    F.min(F.when(v >= lf, v)).alias("bigode_inferior"), F.max(F.when(v <= uf, v)).alias("bigode_superior"),
                    F.count_if((v < lf) | (v > uf)).alias("outliers"))
    return rest.select("n", "minimo", *[double(q[name]).alias(name) for name in ("q1", "mediana", "q3")], "maximo", double(iqr).alias("iqr"),
                       "bigode_inferior", "bigode_superior", "outliers")


def correlation_matrix(df: DataFrame, cols: list[str], scale: dict[str, int] | None = None,
                       min_rows: int = 4, digits: int = 2) -> DataFrame:
    """Pearson correlation of every pair of ``cols`` as a long table (var_x, var_y, corr).

    Each pair's co-moments are centred on running means and merged between partitions
    (``covar_pop``), in one aggregate pass, so that values far from zero and many rows
    don't cancel; the quotient is rounded half-even (like pandas).  Rows with a NULL in either
    column don't count for the pair.  Constant columns give NULL instead of a division error.
    Fewer than ``min_rows`` rows give an empty result.  ``scale`` multiplies columns by
    powers of ten first.
    """
    scale = scale or {}
    value = {c: (F.col(c) * (10 ** scale.get(c, 0))).cast("double") for c in cols}
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, a in enumerate(cols):
        for b in cols[i:]:
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            x, y = F.when(both, value[a]), F.when(both, value[b])
            aggs.append(F.struct(F.covar_pop(x, y).alias("xy"), F.var_pop(x).alias("x"), F.var_pop(y).alias("y")).alias(f"_m_{a}_{b}"))
    m = df.agg(*aggs)

    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            of = F.col(f"_m_{a}_{b}" if i <= j else f"_m_{b}_{a}")
            r = F.try_divide(of["xy"], F.sqrt(of["x"]) * F.sqrt(of["y"]))
            rows.append(F.struct(F.lit(i * len(cols) + j).alias("ordem"), F.lit(a).alias("var_x"),
                                 F.lit(b).alias("var_y"), F.bround(r, digits).alias("corr")))
    return (m.where(F.col("_n") >= min_rows)
            .select(F.explode(F.array(*rows)).alias("_r")).select("_r.*"))


def strongest_off_diagonal(corr: DataFrame) -> DataFrame:
    """The signed off-diagonal value with the largest magnitude (first in row-major
    matrix order on ties); 0 when there is none."""
    return corr.where(F.col("var_x") != F.col("var_y")).agg(
        F.coalesce(F.max_by(F.col("corr"), F.struct(F.abs(F.col("corr")), -F.col("ordem"))),
                   F.lit(0.0)).alias("correlacao_principal"))
