"""Oracle SQL: numbering, integrity, audit, duplicates."""

from oracle.sqlparts import cents, rhu

TRACED = """traced AS (
  SELECT p.*, n.numero_pedido,
         CAST(p.id_cliente AS VARCHAR) || '-' || strftime(p.data_pedido, '%Y%m%d') || '-' || n.numero_pedido AS chave_unica
  FROM pedidos p JOIN (
    SELECT id_pedido,
           'AGR-' || CAST(EXTRACT(YEAR FROM data_pedido) AS VARCHAR) || '-' ||
           format('{:06d}', CASE EXTRACT(YEAR FROM data_pedido) WHEN 2024 THEN 10001 WHEN 2025 THEN 20001 ELSE 1 END
                     + ROW_NUMBER() OVER (PARTITION BY EXTRACT(YEAR FROM data_pedido) ORDER BY data_pedido, id_pedido) - 1) AS numero_pedido
    FROM pedidos) n ON n.id_pedido = p.id_pedido)"""


def hash_of(alias: str = "") -> str:
    a = alias + "." if alias else ""
    parts = [f"CAST({a}id_pedido AS VARCHAR)", f"{a}numero_pedido", f"CAST({a}id_cliente AS VARCHAR)",
             f"CAST(CAST({a}valor_total AS DECIMAL(15,2)) AS VARCHAR)", f"{a}status", f"strftime({a}data_pedido, '%Y-%m-%d')"]
    return "sha256(" + " || '|' || ".join(f"COALESCE({p}, '')" for p in parts) + ")"


SUMS = "(SELECT id_pedido, SUM(subtotal) AS vc FROM itens_pedido GROUP BY id_pedido)"
CORRECTED = f"""corr AS (
  SELECT p.id_pedido, CAST(s.vc AS DECIMAL(15,2)) AS nv FROM pedidos p JOIN {SUMS} s ON s.id_pedido = p.id_pedido
  WHERE ABS(p.valor_total - s.vc) > 0.01)"""

L1 = ", " + TRACED + f"""
SELECT id_pedido, numero_pedido, chave_unica, {hash_of()} AS hash_integridade, 1 AS versao FROM traced"""

L5 = ", " + TRACED + ", " + CORRECTED + f""",
upd AS (SELECT t.id_pedido, t.numero_pedido, t.id_cliente, c.nv AS valor_total, t.status, t.data_pedido
        FROM traced t JOIN corr c ON c.id_pedido = t.id_pedido)
SELECT id_pedido, 2 AS versao, {hash_of()} AS hash_integridade, CAST(valor_total AS DOUBLE) AS valor_total FROM upd"""

L6 = ", " + TRACED + ", " + CORRECTED + f""",
cur AS (SELECT t.id_pedido, t.numero_pedido, t.id_cliente, COALESCE(c.nv, t.valor_total) AS valor_total, t.status,
               t.data_pedido, {hash_of('t')} AS stored
        FROM traced t LEFT JOIN corr c ON c.id_pedido = t.id_pedido)
SELECT id_pedido, numero_pedido, CASE WHEN stored = {hash_of()} THEN 'VALIDO' ELSE 'CORROMPIDO' END AS status,
       stored AS hash_armazenado, {hash_of()} AS hash_calculado
FROM cur"""

ALTERED = "CASE WHEN id_pedido % 7 = 0 THEN status || '*' ELSE status END"
L5B = ", " + CORRECTED + """
SELECT id_pedido, 'INTEGRIDADE_COMPROMETIDA' AS motivo FROM corr JOIN pedidos USING (id_pedido) WHERE id_pedido % 7 = 0 AND status IS NOT NULL"""

L7 = ", " + TRACED + ", " + CORRECTED + f""",
stored AS (SELECT *, {hash_of()} AS hash_integridade FROM traced),
altered AS (SELECT * REPLACE ({ALTERED} AS status) FROM stored)
SELECT t.* REPLACE (CAST(t.data_pedido AS VARCHAR) AS data_pedido, CAST(t.data_entrega AS VARCHAR) AS data_entrega, CAST(t.valor_total AS DOUBLE) AS valor_total),
       1 AS versao, c.nome AS cliente_nome,
       CASE WHEN k.id_pedido IS NOT NULL THEN '2001-08-02 10:00:00' END AS ultima_alteracao,
       CAST(k.id_pedido IS NOT NULL AS BIGINT) AS total_alteracoes,
       CASE WHEN t.hash_integridade = {hash_of('t')} THEN 'VALIDO' ELSE 'CORROMPIDO' END AS status_integridade
FROM altered t JOIN clientes c ON c.id_cliente = t.id_cliente LEFT JOIN corr k ON k.id_pedido = t.id_pedido"""


def _islands(name: str, where: str, group: str, linked: str, by_value: bool) -> str:
    """Rows beside the row before them in their island, by gaps and islands."""
    order = f"PARTITION BY {group} ORDER BY valor_total, id_pedido"
    return f"""{name} AS (
  SELECT *, first_value(id_pedido) OVER (PARTITION BY {group}, ilha ORDER BY valor_total, id_pedido) AS grupo, {by_value} AS por_valor
  FROM (SELECT *, count(*) FILTER (WHERE NOT coalesce({linked}, false)) OVER ({order} ROWS UNBOUNDED PRECEDING) AS ilha
        FROM (SELECT *, lag(id_pedido) OVER ({order}) AS antes, lag(valor_total) OVER ({order}) AS valor_antes FROM pedidos WHERE {where})))"""


LINKS = (_islands("faixas", "valor_total > 0", "id_cliente, data_pedido", "valor_total - valor_antes < 0.10 * valor_total", True) + ",\n"
         + _islands("entregas", "data_entrega IS NOT NULL", "id_cliente, data_pedido, data_entrega", "antes IS NOT NULL", False) + f""",
ligados AS (
  SELECT grupo, antes AS id_pedido_1, id_pedido AS id_pedido_2, nome AS cliente, CAST(data_pedido AS VARCHAR) AS data_pedido,
         CAST(valor_antes AS DOUBLE) AS valor_1, CAST(valor_total AS DOUBLE) AS valor_2,
         CASE WHEN valor_antes = valor_total THEN 100.0::DOUBLE
              ELSE CAST({rhu(f"{cents('valor_antes')} * 10000", cents('valor_total'))} AS DOUBLE) / 100.0::DOUBLE END AS similaridade, por_valor
  FROM (SELECT * FROM faixas UNION ALL SELECT * FROM entregas) JOIN clientes USING (id_cliente) WHERE grupo <> id_pedido)""")

L8 = ", " + LINKS + "\nSELECT * FROM ligados"

L8B = ", " + LINKS + """
SELECT por_valor, grupo, cliente, data_pedido, 1 + count(*) AS tamanho, min(valor_1) AS menor_valor, max(valor_2) AS maior_valor,
       max(similaridade) AS maior_similaridade
FROM ligados GROUP BY ALL"""

L9 = ", " + LINKS + """
SELECT 'pedidos' AS tabela, '[' || id_pedido_1 || ',' || id_pedido_2 || ']' AS registros, similaridade,
       'Mesmo cliente' || CASE WHEN por_valor THEN ' e data, valores a menos de 10%' ELSE ', data e entrega' END AS motivo,
       '2001-08-02 10:00:00' AS data_detecao
FROM ligados"""

L10 = ", " + CORRECTED + """
SELECT COUNT(CASE WHEN TIMESTAMP '2001-08-02 10:00:00' < TIMESTAMP '2003-09-01' - INTERVAL 2 YEAR THEN 1 END) AS removidos
FROM corr"""

L10B = ", " + CORRECTED + """,
dated AS (SELECT id_pedido, data_pedido + to_hours(CAST(8 + id_pedido % 5 AS INTEGER)) AS t FROM corr JOIN pedidos USING (id_pedido))
SELECT 'pedidos' AS tabela_afetada, 'UPDATE' AS operacao, id_pedido AS id_registro, strftime(t, '%Y-%m-%d %H:%M:%S') AS data_hora
FROM dated WHERE t >= TIMESTAMP '2000-06-15 10:00:00'"""

N1 = "\nSELECT id_item, id_pedido, id_produto, CAST(subtotal AS DOUBLE) AS subtotal FROM itens_pedido"

def _image(valor: str) -> str:
    """An order as JSON text; NULL fields are left out."""
    text = lambda c, x: f"""'"{c}":"' || {x} || '"'"""
    return "'{' || concat_ws(',', " + ", ".join([
        "'\"id_pedido\":' || id_pedido", text("data_pedido", "data_pedido::DATE::VARCHAR"), text("data_entrega", "data_entrega::DATE::VARCHAR"),
        "'\"id_cliente\":' || id_cliente", text("tipo_contrato", "tipo_contrato"), text("status", "status"), text("regiao_origem", "regiao_origem"),
        text("regiao_destino", "regiao_destino"), f"'\"valor_total\":' || CAST({valor} AS DECIMAL(15,2))"]) + ") || '}'"


L4 = ", " + CORRECTED + f"""
SELECT 'pedidos' AS tabela_afetada, 'UPDATE' AS operacao, id_pedido AS id_registro, {_image('valor_total')} AS dados_anteriores,
       {_image('nv')} AS dados_novos, 'SISTEMA' AS usuario_aplicacao, '2001-08-02 10:00:00' AS data_hora
FROM corr JOIN pedidos USING (id_pedido)"""

# The snapshot before ends a year before the newest order; the one after starts a year after the oldest.
L4B = ", " + CORRECTED + """,
span AS (SELECT CAST(max(data_pedido) - INTERVAL 1 YEAR AS DATE) AS a, CAST(min(data_pedido) + INTERVAL 1 YEAR AS DATE) AS b FROM pedidos),
ops AS (SELECT CASE WHEN data_pedido > a THEN 'INSERT' WHEN data_pedido < b THEN 'DELETE' WHEN id_pedido IN (SELECT id_pedido FROM corr) THEN 'UPDATE' END AS operacao
        FROM pedidos, span)
SELECT 'pedidos' AS tabela_afetada, operacao, count(*) AS registros FROM ops WHERE operacao IS NOT NULL GROUP BY operacao"""

SQL = {"L4_audit_rows": L4, "L4b_audit_summary": L4B,
    "L1_order_numbers": L1, "L5_stamp_updates": L5, "L6_integrity_report": L6, "L7_traced_view": L7,
    "L8_duplicate_candidates": L8, "L8b_duplicate_groups": L8B, "L9_duplicate_alerts": L9, "L10_audit_retention": L10, "L10b_retained_audit": L10B, "L5b_refused_updates": L5B, "N1_item_keys": N1,
}
