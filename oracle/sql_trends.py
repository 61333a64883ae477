"""Oracle SQL: trends (TR1-TR9) and inactivity (IN1-IN6)."""

from oracle.sqlparts import avg_money, cents, dbl, ratio_pct, rhu

# A month and, as ``antes``, the total of the latest earlier month that has orders.
MONTHLY = """por_mes AS (
  FROM pedidos SELECT last_day(data_pedido) - CAST(day(last_day(data_pedido)) - 1 AS INTEGER) AS mes, sum(valor_total) AS total, count() AS contratos
  WHERE NOT (status = 'Cancelado') GROUP BY ALL),
mensal AS (
  FROM por_mes m ASOF LEFT JOIN (SELECT mes AS mes_antes, total AS antes FROM por_mes) e ON m.mes > e.mes_antes SELECT m.*, e.antes)"""

GROWTH = ratio_pct("total - antes", "antes", 2)

TR1_CTE = f"""{MONTHLY},
tr1 AS (FROM mensal SELECT strftime(mes, '%Y-%m') AS mes_ano, strftime(mes, '%b/%Y') AS mes_label,
               {dbl('total')} AS vendas, contratos, {GROWTH} AS crescimento, mes)"""

TR1 = ", " + TR1_CTE + "\nFROM tr1 SELECT * EXCLUDE (mes)"

TR2 = f""", {MONTHLY}
FROM mensal m SELECT strftime(mes, '%Y-%m') AS mes_ano, contratos AS total_contratos, {dbl('total')} AS total_vendas,
  {GROWTH} AS crescimento_percentual, {avg_money('total', 'contratos')} AS ticket_medio_mes,
  (SELECT {dbl('sum(y.total)')} FROM mensal y WHERE y.mes <= m.mes AND year(y.mes) = year(m.mes)) AS acumulado_ano"""

TR3 = f""", {MONTHLY}
FROM mensal SELECT CAST(mes AS VARCHAR) AS mes, contratos AS total_pedidos, {dbl('total')} AS receita_mes,
  {dbl('antes')} AS receita_anterior, {GROWTH} AS crescimento_percentual"""

TR4 = ", " + TR1_CTE + f"""
SELECT CAST(SUM(CAST(vendas AS DECIMAL(28,2))) AS DOUBLE) AS total_vendas, CAST(SUM(contratos) AS BIGINT) AS total_contratos,
       {rhu(cents('SUM(CAST(vendas AS DECIMAL(28,2)))'), 'SUM(contratos) * 100')} AS ticket_medio,
       arg_max(crescimento, CASE WHEN crescimento IS NOT NULL THEN mes_ano END) AS ultimo_crescimento
FROM tr1"""

TR5 = ", " + TR1_CTE + """
SELECT mes_ano, vendas, contratos, crescimento,
       CAST(SUM(CAST(vendas AS DECIMAL(28,2))) OVER (ORDER BY mes_ano ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS acumulado,
       CAST(SUM(CAST(vendas AS DECIMAL(28,2))) OVER (ORDER BY mes_ano DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS acumulado_tabela,
       CASE WHEN crescimento > 5 THEN '↗️' WHEN crescimento < -5 THEN '↘️' ELSE '➡️' END AS tendencia
FROM tr1"""

TR6_CTE = """agg AS (
  SELECT CAST(EXTRACT(YEAR FROM p.data_pedido) AS INTEGER) AS ano, CAST(EXTRACT(MONTH FROM p.data_pedido) AS INTEGER) AS mes,
         SUM(valor_total) AS v, COUNT(*) AS c
  FROM pedidos p CROSS JOIN anchor a
  WHERE p.status != 'Cancelado' AND p.data_pedido >= CAST(DATE_TRUNC('year', a.ref) - INTERVAL 1 YEAR AS DATE)
  GROUP BY 1, 2),
matrix AS (
  SELECT y.ano, m.mes,
         ['Jan','Fev','Mar','Abr','Mai','Jun','Jul','Ago','Set','Out','Nov','Dez'][m.mes] AS mes_nome,
         CAST(COALESCE(agg.v, 0) AS DOUBLE) AS vendas, CAST(COALESCE(agg.c, 0) AS BIGINT) AS contratos
  FROM (SELECT DISTINCT ano FROM agg) y CROSS JOIN (SELECT CAST(range AS INTEGER) AS mes FROM range(1, 13)) m
  LEFT JOIN agg ON agg.ano = y.ano AND agg.mes = m.mes)"""

TR6 = ", " + TR6_CTE + "\nSELECT * FROM matrix"

TR6B = ", " + TR6_CTE + """
SELECT mes, mes_nome, coalesce(max(vendas) FILTER (ano = 2000), 0) AS vendas_2000, coalesce(max(contratos) FILTER (ano = 2000), 0) AS contratos_2000,
       coalesce(max(vendas) FILTER (ano = 2001), 0) AS vendas_2001, coalesce(max(contratos) FILTER (ano = 2001), 0) AS contratos_2001
FROM matrix GROUP BY mes, mes_nome"""

TR7 = ", " + TR6_CTE + f""",
py AS (SELECT ano, SUM(CAST(vendas AS DECIMAL(28,2))) AS tot,
              COUNT(CASE WHEN CAST(vendas AS DECIMAL(28,2)) > 0 THEN 1 END) AS meses,
              FIRST(mes_nome ORDER BY CAST(vendas AS DECIMAL(28,2)) DESC, mes) AS melhor_mes
       FROM matrix GROUP BY ano),
b AS (SELECT MIN(ano) AS a0, MAX(ano) AS a1, COUNT(*) AS anos FROM py)
SELECT b.anos,
       CASE WHEN b.anos >= 2 AND f.tot > 0 THEN {ratio_pct('l.tot - f.tot', 'f.tot', 1)} END AS yoy_pct,
       l.melhor_mes,
       CAST({rhu(cents('l.tot') + ' * 12', 'GREATEST(l.meses, 1)')} AS DOUBLE) / 100.0::DOUBLE AS projecao
FROM b JOIN py f ON f.ano = b.a0 JOIN py l ON l.ano = b.a1"""

TR8 = ", " + TR1_CTE + f"""
SELECT mes_ano, CAST({rhu(cents('CAST(vendas AS DECIMAL(28,2))'), '1000000')} AS DOUBLE) / 100.0::DOUBLE AS vendas_milhoes,
       COALESCE(CAST({rhu(cents('CAST(crescimento AS DECIMAL(12,2))'), '10')} AS DOUBLE) / 10.0::DOUBLE, 0.0::DOUBLE) AS crescimento
FROM tr1"""

TR9_YEAR, TR9_QUARTER = 2000, 2

TR9 = ", " + TR1_CTE + f"""
SELECT mes_ano, mes_label, vendas, contratos, crescimento FROM tr1
WHERE EXTRACT(YEAR FROM mes) = {TR9_YEAR} AND EXTRACT(QUARTER FROM mes) = {TR9_QUARTER}"""

IN1_CTE = """in1 AS (
  SELECT c.id_cliente, c.nome, c.tipo_cliente, c.regiao, CAST(a.ref - u.u AS INTEGER) AS dias_inativo,
         strftime(u.u, '%d/%m/%Y') AS ultima_compra
  FROM clientes c JOIN (SELECT id_cliente, MAX(data_pedido) AS u FROM pedidos GROUP BY id_cliente) u
       ON u.id_cliente = c.id_cliente CROSS JOIN anchor a
  WHERE a.ref - u.u > {min_days})"""

IN1 = ", " + IN1_CTE.format(min_days=180) + "\nSELECT * FROM in1"

# Labels of inactivity by the days that they start after.
IN2_LABELS = [(365, 'Crítico (>1 ano)'), (180, 'Inativo (6-12 meses)'), (-1, 'Alerta (3-6 meses)')]

IN2 = f""", compras AS (FROM pedidos SELECT id_cliente, list(data_pedido) AS datas WHERE NOT (status = 'Cancelado') GROUP BY ALL),
visto AS (
  FROM clientes c LEFT JOIN compras USING (id_cliente), anchor
  SELECT c.* EXCLUDE (limite_credito), list_max(datas) AS ultima, coalesce(len(datas), 0) AS n, ref - coalesce(list_max(datas), data_cadastro) AS parado)
FROM visto SELECT id_cliente, nome, tipo_cliente, regiao, estado, CAST(coalesce(ultima, data_cadastro) AS VARCHAR) AS ultima_compra,
  CAST(parado AS INTEGER) AS dias_inativo, n AS total_pedidos_historico,
  if(n = 0, 'Nunca comprou', (SELECT arg_max(label, after) FROM (VALUES {', '.join(str(x) for x in IN2_LABELS)}) l(after, label) WHERE parado > after)) AS status_inatividade
WHERE n = 0 OR parado > 180"""

IN3 = """, validos AS (SELECT id_cliente, data_pedido FROM pedidos WHERE NOT (status = 'Cancelado')),
recentes AS (SELECT v.id_cliente FROM validos v, anchor WHERE v.data_pedido >= CAST(ref - INTERVAL 6 MONTH AS DATE)),
ultimos AS (SELECT id_cliente, max(data_pedido) AS ultimo FROM validos GROUP BY ALL)
FROM clientes LEFT JOIN ultimos USING (id_cliente), anchor
SELECT id_cliente, nome, tipo_cliente, regiao, CAST(ultimo AS VARCHAR) AS ultimo_pedido, CAST(ref - ultimo AS INTEGER) AS dias_inativo
WHERE id_cliente NOT IN (FROM recentes)"""

BANDS = """COUNT(CASE WHEN COALESCE(dias_inativo, 0) > 365 THEN 1 END) AS mais_1_ano,
       COUNT(CASE WHEN COALESCE(dias_inativo, 0) BETWEEN 180 AND 365 THEN 1 END) AS de_6_a_12_meses,
       COUNT(CASE WHEN COALESCE(dias_inativo, 0) >= 90 AND COALESCE(dias_inativo, 0) < 180 THEN 1 END) AS de_3_a_6_meses"""

IN4 = ", " + IN1_CTE.format(min_days=90) + f"""
SELECT COUNT(*) AS total, {BANDS}, CAST(COUNT(*) * 15000 AS BIGINT) AS perda_estimada FROM in1"""

IN4B = IN4 + " WHERE dias_inativo >= 200"

IN5 = ", " + IN1_CTE.format(min_days=90) + f"""
SELECT regiao, COUNT(*) AS total, {BANDS} FROM in1 GROUP BY regiao"""

IN6 = ", " + IN1_CTE.format(min_days=180) + """
SELECT *, CASE WHEN dias_inativo > 365 THEN 'Crítico' WHEN dias_inativo > 180 THEN 'Alerta' ELSE 'Atenção' END AS rotulo
FROM in1"""

SQL = {"IN4b_inactivity_kpis_min_days": IN4B,
    "TR1_monthly_trend": TR1, "TR2_monthly_trend_ytd": TR2, "TR3_monthly_trend_test": TR3,
    "TR4_trend_kpis": TR4, "TR5_trend_table": TR5, "TR6_year_month_matrix": TR6, "TR6b_year_columns": TR6B,
    "TR7_year_comparison": TR7, "TR8_chart_feed": TR8, "TR9_trend_year_quarter": TR9,
    "IN1_inactive_customers": IN1, "IN2_inactive_or_never": IN2, "IN3_inactive_six_months": IN3,
    "IN4_inactivity_kpis": IN4, "IN5_inactivity_by_region": IN5, "IN6_inactivity_labels": IN6,
}
