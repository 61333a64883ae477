"""Oracle SQL: streaming operators with a batch equivalent (ST2, ST3)."""

SUMS = "(SELECT id_pedido, SUM(subtotal) AS vc, COUNT(*) AS n FROM itens_pedido GROUP BY id_pedido)"

ST2 = f"""
SELECT p.id_pedido, strftime(p.data_pedido, '%Y-%m-%d') AS dia, CAST(p.valor_total AS DOUBLE) AS valor_registrado,
       CAST(s.vc AS DOUBLE) AS valor_calculado,
       CASE WHEN p.valor_total > s.vc THEN 'SOBREFATURAMENTO' ELSE 'SUBFATURAMENTO' END AS tipo_anomalia
FROM pedidos p JOIN {SUMS} s ON s.id_pedido = p.id_pedido
WHERE ABS(p.valor_total - s.vc) > 0.01"""

ST3 = f"""
SELECT pc.id_pedido, pc.id_cliente, CAST(pc.percentual_rateio AS DOUBLE) AS percentual_rateio,
       CAST(CAST(ROUND(CAST(s.vc AS DECIMAL(15,2)) * pc.percentual_rateio * 0.01, 2) AS DECIMAL(15,2)) AS DOUBLE) AS valor_rateado
FROM pedido_clientes pc JOIN pedidos p ON p.id_pedido = pc.id_pedido JOIN {SUMS} s ON s.id_pedido = p.id_pedido
WHERE ABS(p.valor_total - s.vc) > 0.01"""

# ST1: every order enters as version 1 (INSERT); each corrected order arrives as version 2
# with a changed value (UPDATE, audited).
ST1 = f"""
SELECT id_pedido AS id_registro, 1 AS versao, 'INSERT' AS operacao, 'AUDITADO' AS resultado FROM pedidos
UNION ALL
SELECT p.id_pedido, 2, 'UPDATE', 'AUDITADO'
FROM pedidos p JOIN {SUMS} s ON s.id_pedido = p.id_pedido WHERE ABS(p.valor_total - s.vc) > 0.01"""

SQL = {"ST1_audit_stream": ST1, "ST2_divergence_alerts": ST2, "ST3_share_refresh_stream": ST3}
NEEDS_SHARES = {"ST3_share_refresh_stream"}
