"""SQL fragments shared by the oracle queries (DuckDB dialect).

They mirror the exact-arithmetic helpers of orderlens.functions.numeric.
"""


def rhu(num: str, den: str) -> str:
    """round(num / den) half away from zero for integers, den > 0 (NULL when den = 0)."""
    n = f"CAST({num} AS HUGEINT)"
    d = f"NULLIF(CAST({den} AS HUGEINT), 0)"
    return f"CAST(CASE WHEN {n} >= 0 THEN (2 * {n} + {d}) // (2 * {d}) ELSE -((-2 * {n} + {d}) // (2 * {d})) END AS BIGINT)"


def cents(x: str) -> str:
    return f"CAST(({x}) * 100 AS HUGEINT)"


def avg_money(total: str, count: str) -> str:
    return f"(CAST({rhu(cents(total), count)} AS DOUBLE) / 100.0::DOUBLE)"


def ratio_pct(num: str, den: str, digits: int = 2) -> str:
    s = 10 ** digits
    return f"(CAST({rhu(cents(num) + f' * {100 * s}', cents(den))} AS DOUBLE) / {float(s)}::DOUBLE)"


def ratio_pct_int(num: str, den: str, digits: int = 2) -> str:
    s = 10 ** digits
    return f"(CAST({rhu(f'CAST({num} AS HUGEINT) * {100 * s}', den)} AS DOUBLE) / {float(s)}::DOUBLE)"


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


METRICS = """(SELECT id_cliente, MAX(data_pedido) AS ultima, MIN(data_pedido) AS primeira,
        COUNT(*) AS total_pedidos, SUM(valor_total) AS soma
   FROM pedidos WHERE status != 'Cancelado' GROUP BY id_cliente)"""


def segment_fixed(days: str, orders: str, accented: bool = True) -> str:
    champ = "Campeão" if accented else "Campeao"
    return (f"CASE WHEN {days} <= 30 AND {orders} >= 5 THEN '{champ}' "
            f"WHEN {days} <= 60 AND {orders} >= 3 THEN 'Fiel' "
            f"WHEN {days} <= 90 THEN 'Ativo' ELSE 'Em Risco' END")


def histogram_sql(src: str, col: str, bins: int = 20) -> str:
    return f"""hb AS (SELECT MIN(CAST({col} AS BIGINT)) AS lo, MAX(CAST({col} AS BIGINT)) AS hi FROM {src}),
hc AS (SELECT CASE WHEN hb.hi = hb.lo THEN 0
                   ELSE LEAST((CAST(s.{col} AS BIGINT) - hb.lo) * {bins} // (hb.hi - hb.lo), {bins - 1}) END AS bin,
              COUNT(*) AS contagem
       FROM {src} s CROSS JOIN hb GROUP BY 1)
SELECT CAST(r.range AS INTEGER) AS bin, hb.lo + (hb.hi - hb.lo) * r.range // {bins} AS limite_inferior,
       COALESCE(hc.contagem, 0) AS contagem
FROM range({bins}) r CROSS JOIN hb LEFT JOIN hc ON hc.bin = r.range"""


def box_sql(src: str, groups: list[str], value: str, tiebreak: str, extra: str = "") -> str:
    """Box summary per group with linear-interpolated quartiles, 1.5*IQR whiskers, outliers."""
    g = ", ".join(groups)
    gsel = (g + ", ") if groups else ""
    part = f"PARTITION BY {g}" if groups else ""
    join_on = " AND ".join(f"b.{c} IS NOT DISTINCT FROM s.{c}" for c in groups) or "TRUE"
    grp = f"GROUP BY {g}" if groups else ""
    quart = []
    for name, p in (("q1", 0.25), ("mediana", 0.5), ("q3", 0.75)):
        pos = f"pos_{name}"
        lo = f"MAX(CASE WHEN rn = CAST(FLOOR({pos}) AS BIGINT) + 1 THEN v END)"
        hi = f"MAX(CASE WHEN rn = CAST(CEIL({pos}) AS BIGINT) + 1 THEN v END)"
        quart.append(f"{lo} + ({hi} - {lo}) * MAX({pos} - FLOOR({pos})) AS {name}")
    return f"""bx_0 AS (SELECT {gsel}CAST({value} AS DOUBLE) AS v,
                   ROW_NUMBER() OVER ({part} ORDER BY CAST({value} AS DOUBLE), {tiebreak}) AS rn,
                   COUNT(*) OVER ({part}) AS n FROM {src}),
bx_r AS (SELECT *, (n - 1) * CAST(0.25 AS DOUBLE) AS pos_q1, (n - 1) * CAST(0.5 AS DOUBLE) AS pos_mediana,
                (n - 1) * CAST(0.75 AS DOUBLE) AS pos_q3 FROM bx_0),
bx_q AS (SELECT {gsel}MAX(n) AS n, MIN(v) AS minimo, MAX(v) AS maximo, {", ".join(quart)}
         FROM bx_r {grp}),
bx_s AS (SELECT *, q3 - q1 AS iqr, q1 - (q3 - q1) * 1.5 AS lf, q3 + (q3 - q1) * 1.5 AS uf FROM bx_q)
SELECT {", ".join("b." + c for c in groups) + ", " if groups else ""}b.n, b.minimo, b.q1, b.mediana, b.q3, b.maximo, b.iqr,
       MIN(CASE WHEN s.v >= b.lf THEN s.v END) AS bigode_inferior,
       MAX(CASE WHEN s.v <= b.uf THEN s.v END) AS bigode_superior,
       COUNT(CASE WHEN s.v < b.lf OR s.v > b.uf THEN 1 END) AS outliers{extra}
FROM bx_s b JOIN bx_r s ON {join_on}
GROUP BY {", ".join("b." + c for c in groups) + ", " if groups else ""}b.n, b.minimo, b.q1, b.mediana, b.q3, b.maximo, b.iqr"""


def rhe(num: str, den: str) -> str:
    n = f"ABS(CAST({num} AS HUGEINT))"
    d = f"NULLIF(CAST({den} AS HUGEINT), 0)"
    q = f"({n} // {d})"
    r2 = f"(({n} - {q} * {d}) * 2)"
    mag = f"(CASE WHEN {r2} > {d} THEN {q} + 1 WHEN {r2} = {d} AND {q} % 2 = 1 THEN {q} + 1 ELSE {q} END)"
    return f"CAST(CASE WHEN CAST({num} AS HUGEINT) < 0 THEN -{mag} ELSE {mag} END AS BIGINT)"


def pct_of(num: str, den: str, digits: int = 1, half_even: bool = True) -> str:
    s = 10 ** digits
    f = rhe if half_even else rhu
    return f"(CAST({f(cents(num) + f' * {100 * s}', cents(den))} AS DOUBLE) / {float(s)}::DOUBLE)"


def money_millions_text(x: str) -> str:
    t = rhe(cents(x), "10000000")
    return f"('R$ ' || CAST({t} // 10 AS VARCHAR) || '.' || CAST({t} % 10 AS VARCHAR) || 'M')"


def money_units_text(x: str) -> str:
    return f"('R$ ' || replace(format('{{:,}}', CAST({rhe(cents(x), '100')} AS BIGINT)), ',', '.'))"
