"""Oracle SQL: RFV / RFM."""

from oracle.sqlparts import METRICS, avg_money, box_sql, dbl, histogram_sql, rhu, segment_fixed

RFV_CTE = f"""rfv AS (
  SELECT c.id_cliente, c.nome, c.tipo_cliente, c.regiao,
         CAST(a.ref - m.ultima AS INTEGER) AS dias_desde_ultimo,
         strftime(m.ultima, '%d/%m/%Y') AS ultima_data,
         m.total_pedidos,
         {avg_money('m.soma', 'm.total_pedidos')} AS ticket_medio,
         {dbl('m.soma')} AS valor_total,
         {segment_fixed('(a.ref - m.ultima)', 'm.total_pedidos')} AS segmento
  FROM clientes c JOIN {METRICS} m ON c.id_cliente = m.id_cliente CROSS JOIN anchor a)"""

R1 = ", " + RFV_CTE + "\nSELECT * FROM rfv"

# The score ladder (least and greatest recency score, least order and value score, label).
LADDER = [(4, 5, 4, 4, 'Campeão'), (3, 5, 3, 1, 'Fiel'), (3, 5, 1, 1, 'Ativo'), (1, 2, 1, 3, 'Em Risco (Alto Valor)'), (1, 5, 1, 1, 'Inativo')]


def quintile(order: str) -> str:
    """The fifth in which a row lies when rows are dealt in ``order`` and the first fifths take the remainder."""
    place, rows = f"(ROW_NUMBER() OVER (ORDER BY {order}) - 1)", "COUNT(*) OVER ()"
    return (f"CAST(CASE WHEN {place} < ({rows} % 5) * ({rows} // 5 + 1) THEN {place} // ({rows} // 5 + 1) "
            f"ELSE {rows} % 5 + ({place} - ({rows} % 5) * ({rows} // 5 + 1)) // GREATEST({rows} // 5, 1) END + 1 AS BIGINT)")


R2 = f""", placed AS (
  FROM {METRICS} k SELECT *, {quintile('ultima, id_cliente')} AS por_data,
    {quintile('total_pedidos, id_cliente')} AS por_numero, {quintile('soma, id_cliente')} AS por_valor),
ladder(r_min, r_max, f_min, m_min, label, step) AS (VALUES {', '.join(f"({a}, {b}, {c}, {d}, '{e}', {n})" for n, (a, b, c, d, e) in enumerate(LADDER))})
FROM placed NATURAL JOIN clientes, anchor
SELECT id_cliente, nome, tipo_cliente, regiao, estado, CAST(ref - ultima AS INTEGER) AS dias_desde_ultimo_pedido, CAST(ultima AS VARCHAR) AS ultima_data,
       total_pedidos, {avg_money('soma', 'total_pedidos')} AS ticket_medio, {dbl('soma')} AS valor_total,
       -- the gaps of a customer add up to the time from the first purchase to the last
       {rhu('ultima - primeira', 'total_pedidos - 1')} AS gap_medio_dias,
       por_data AS score_r, por_numero AS score_f, por_valor AS score_m, por_data + por_numero + por_valor AS score_rfm_total,
       (SELECT arg_min(label, step) FROM ladder
        WHERE por_data BETWEEN r_min AND r_max AND por_numero >= f_min AND por_valor >= m_min) AS segmento"""

R3 = f""", placed AS (
  FROM {METRICS} k, anchor SELECT *, CAST(ref - ultima AS INTEGER) AS idade,
    {quintile('ultima DESC, id_cliente')} AS q_data, {quintile('total_pedidos DESC, id_cliente')} AS q_numero, {quintile('soma DESC, id_cliente')} AS q_valor,
    list(soma) OVER (ORDER BY soma DESC, id_cliente ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING) AS acima)
FROM placed SELECT id_cliente, CAST(ultima AS VARCHAR) AS ultima_compra, total_pedidos AS frequencia, {dbl('soma')} AS valor_total,
  idade AS recencia_dias, q_data AS score_r, q_numero AS score_f, q_valor AS score_v, q_data + q_numero + q_valor AS score_rfv,
  {dbl('acima[1]')} AS valor_anterior"""


def _segments(accented: bool) -> str:
    return f""", seg AS (SELECT {segment_fixed('(a.ref - m.ultima)', 'm.total_pedidos', accented)} AS segmento
             FROM {METRICS} m CROSS JOIN anchor a),
cnt AS (SELECT segmento, COUNT(*) AS clientes FROM seg GROUP BY segmento)
SELECT cnt.segmento, cnt.clientes, t.total_clientes, t.em_risco
FROM cnt CROSS JOIN (SELECT CAST(SUM(clientes) AS BIGINT) AS total_clientes,
                            CAST(COALESCE(SUM(CASE WHEN segmento = 'Em Risco' THEN clientes END), 0) AS BIGINT) AS em_risco
                     FROM cnt) t"""


R4 = _segments(True)
R5 = _segments(False)

R6 = ", " + RFV_CTE + """,
spine AS (SELECT * FROM (VALUES ('Campeão', 0), ('Fiel', 1), ('Ativo', 2), ('Em Risco', 3)) v(segmento, ordem)),
cnt AS (SELECT segmento, COUNT(*) AS clientes FROM rfv GROUP BY segmento)
SELECT s.segmento, s.ordem, COALESCE(c.clientes, 0) AS clientes, t.total_clientes
FROM spine s LEFT JOIN cnt c ON c.segmento = s.segmento
CROSS JOIN (SELECT COUNT(*) AS total_clientes FROM rfv) t"""

R6B = ", " + RFV_CTE + """
SELECT segmento, CAST(ordem AS INTEGER) AS ordem, count(id_cliente) AS clientes, CAST(sum(count(id_cliente)) OVER () AS BIGINT) AS total_clientes
FROM (SELECT unnest(['Campeão', 'Fiel', 'Ativo', 'Em Risco']) AS segmento, unnest(range(4)) AS ordem)
LEFT JOIN (SELECT * FROM rfv WHERE regiao = 'AMERICA') USING (segmento) GROUP BY segmento, ordem"""

R7 = ", " + RFV_CTE + """
SELECT segmento, COUNT(*) AS clientes, CAST(SUM(CAST(valor_total AS DECIMAL(28,2))) AS DOUBLE) AS valor
FROM rfv GROUP BY segmento"""

R8 = ", " + RFV_CTE + f""",
r AS (SELECT regiao, COUNT(*) AS clientes, COUNT(CASE WHEN segmento = 'Campeão' THEN 1 END) AS campeoes,
             SUM(CAST(valor_total AS DECIMAL(28,2))) AS v FROM rfv GROUP BY regiao)
SELECT regiao, clientes, campeoes, {dbl('v')} AS valor, {avg_money('v', 'clientes')} AS valor_por_cliente FROM r"""

R9 = ", " + RFV_CTE + ",\n" + histogram_sql("rfv", "dias_desde_ultimo", 20)

R9_BOX = ", " + RFV_CTE + ",\n" + box_sql("rfv", [], "valor_total", "id_cliente")

R10 = ", " + RFV_CTE + """
SELECT *, ROW_NUMBER() OVER (ORDER BY valor_total DESC, id_cliente) AS posicao
FROM (SELECT * FROM rfv ORDER BY valor_total DESC, id_cliente LIMIT 5) t"""

R9C = ", " + RFV_CTE + "\nSELECT id_cliente, nome, total_pedidos, dias_desde_ultimo, valor_total FROM rfv"

W1 = """
SELECT id_cliente, id_pedido, strftime(data_pedido, '%Y-%m-%d') AS data_pedido,
       strftime(LAG(data_pedido) OVER w, '%Y-%m-%d') AS data_anterior,
       CAST(data_pedido - LAG(data_pedido) OVER w AS INTEGER) AS gap_dias
FROM pedidos WHERE status != 'Cancelado'
WINDOW w AS (PARTITION BY id_cliente ORDER BY data_pedido, id_pedido)"""

SQL = {
    "W1_purchase_gaps": W1,
    "R1_rfv_fixed": R1, "R2_rfm_scores": R2, "R3_rfv_test_scores": R3,
    "R4_segment_counts": R4, "R5_segment_counts_anchor": R5, "R6_segment_kpis": R6, "R6b_segment_kpis_filtered": R6B,
    "R7_segment_summary": R7, "R8_region_summary": R8, "R9_recency_histogram": R9,
    "R9b_value_box": R9_BOX, "R10_top_customers": R10, "R9c_rfv_points": R9C,
}
