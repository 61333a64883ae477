"""Oracle SQL: shared purchases (H1-H4, H6-H8)."""


H4 = """
SELECT id_pedido, id_cliente, CAST(percentual_rateio AS DOUBLE) AS percentual_rateio,
       CAST(valor_rateado AS DOUBLE) AS valor_rateado FROM pedido_clientes"""

H1 = """, sizes AS (FROM pedido_clientes SELECT id_pedido, count() AS total_participantes GROUP BY ALL)
FROM sizes NATURAL JOIN pedido_clientes
  JOIN (SELECT id_cliente, nome AS cliente_nome, tipo_cliente FROM clientes) USING (id_cliente)
  JOIN (SELECT id_pedido, CAST(data_pedido AS VARCHAR) AS data_pedido, CAST(valor_total AS DOUBLE) AS valor_total, tipo_contrato, status, regiao_origem, regiao_destino FROM pedidos) USING (id_pedido)
SELECT id_pedido, id_cliente, cliente_nome, tipo_cliente, data_pedido, valor_total, total_participantes, tipo_contrato, status, regiao_origem, regiao_destino,
  CAST(percentual_rateio AS DOUBLE) AS percentual_rateio, CAST(valor_rateado AS DOUBLE) AS valor_rateado"""

# The older total counts half an order for each of its shares.
H2 = """, shared AS (SELECT p.valor_total, list(s.id_cliente) AS owners FROM pedidos p JOIN pedido_clientes s USING (id_pedido) GROUP BY p.id_pedido, p.valor_total)
SELECT count() AS total_pedidos, CAST(len(list_distinct(flatten(list(owners)))) AS BIGINT) AS total_clientes,
       CAST(sum(valor_total * len(owners)) / 2 AS DOUBLE) AS valor_total_legado, CAST(sum(valor_total) AS DOUBLE) AS valor_total
FROM shared"""

H3 = """, places AS (SELECT DISTINCT s.id_pedido, c.regiao FROM pedido_clientes s, clientes c WHERE s.id_cliente = c.id_cliente),
orders_in AS (FROM places SELECT regiao, count() AS pedidos GROUP BY ALL),
money_in AS (FROM clientes SEMI JOIN pedido_clientes USING (id_cliente) SELECT regiao,
  sum((SELECT sum(valor_rateado) FROM pedido_clientes s WHERE s.id_cliente = clientes.id_cliente)) AS valor GROUP BY ALL)
FROM orders_in JOIN money_in USING (regiao) SELECT regiao, pedidos, CAST(valor AS DOUBLE) AS valor"""

H7 = """
SELECT id_pedido, CAST(ROUND(SUM(percentual_rateio), 2) AS DOUBLE) AS soma_pct,
       ABS(ROUND(SUM(percentual_rateio), 2) - 100) <= 0.01 AS valido
FROM pedido_clientes GROUP BY id_pedido HAVING COUNT(*) > 1"""

# The ownership labels and the text of an owner, "name (share%)", largest share first.
H8 = """, owners AS (
  FROM pedido_clientes NATURAL JOIN (SELECT id_cliente, nome FROM clientes)
  SELECT id_pedido, list_sort(list({'k': -percentual_rateio, 'i': id_cliente, 'text': concat(nome, ' (', percentual_rateio, '%)')})) AS named GROUP BY ALL)
FROM pedidos NATURAL JOIN (SELECT id_cliente, nome AS cliente_principal, tipo_cliente FROM clientes) LEFT JOIN owners USING (id_pedido)
SELECT id_pedido, CAST(data_pedido AS VARCHAR) AS data_pedido, CAST(data_entrega AS VARCHAR) AS data_entrega, CAST(valor_total AS DOUBLE) AS valor_total,
  status, tipo_contrato, regiao_origem, regiao_destino, id_cliente, cliente_principal, tipo_cliente, if(named IS NULL, 'INDIVIDUAL', 'COMPARTILHADO') AS tipo_ownership,
  if(named IS NULL, cliente_principal, array_to_string(list_transform(named, lambda o: o.text), ', ')) AS todos_proprietarios"""

# H6: shares of orders whose total changed under the batch correction (C6) are recomputed.
H6 = """, sums AS (SELECT id_pedido, SUM(subtotal) AS vc FROM itens_pedido GROUP BY id_pedido),
newv AS (SELECT p.id_pedido, CAST(s.vc AS DECIMAL(15,2)) AS nv FROM pedidos p JOIN sums s ON s.id_pedido = p.id_pedido
         WHERE ABS(p.valor_total - s.vc) > 0.01)
SELECT pc.id_pedido, pc.id_cliente, CAST(pc.percentual_rateio AS DOUBLE) AS percentual_rateio,
       CAST(CASE WHEN n.nv IS NOT NULL THEN CAST(ROUND(n.nv * pc.percentual_rateio * 0.01, 2) AS DECIMAL(15,2))
                 ELSE pc.valor_rateado END AS DOUBLE) AS valor_rateado
FROM pedido_clientes pc LEFT JOIN newv n ON n.id_pedido = pc.id_pedido"""

# H5: one creation request per shared order (owners by share, lines of the order);
# every request sums to 100 and is accepted; ids continue after the orders' maximum.
H5 = """, req AS (SELECT DISTINCT id_pedido FROM pedido_clientes),
holder AS (SELECT id_pedido, arg_max(id_cliente, (percentual_rateio, -id_cliente)) AS id_cliente
           FROM pedido_clientes GROUP BY id_pedido),
val AS (SELECT i.id_pedido, SUM(CAST(i.quantidade * i.preco_unitario AS DECIMAL(15,2))) AS v
        FROM itens_pedido i JOIN req USING (id_pedido) GROUP BY i.id_pedido)
SELECT (SELECT MAX(id_pedido) FROM pedidos) + ROW_NUMBER() OVER (ORDER BY r.id_pedido) AS id_pedido,
       strftime(p.data_pedido, '%Y-%m-%d') AS data_pedido, strftime(p.data_entrega, '%Y-%m-%d') AS data_entrega,
       h.id_cliente, p.tipo_contrato, 'Pendente' AS status, CAST(COALESCE(v.v, 0) AS DOUBLE) AS valor_total
FROM req r JOIN pedidos p ON p.id_pedido = r.id_pedido JOIN holder h ON h.id_pedido = r.id_pedido
LEFT JOIN val v ON v.id_pedido = r.id_pedido"""

CREATED = """, created AS (
  SELECT id_pedido AS origem, (SELECT MAX(id_pedido) FROM pedidos) + dense_rank() OVER (ORDER BY id_pedido) AS novo, id_cliente, percentual_rateio
  FROM pedido_clientes),
linhas AS (
  SELECT novo, id_produto, quantidade, preco_unitario, CAST(quantidade * preco_unitario AS DECIMAL(15,2)) AS subtotal
  FROM (SELECT DISTINCT origem, novo FROM created) JOIN itens_pedido ON id_pedido = origem),
valores AS (SELECT novo, SUM(subtotal) AS v FROM linhas GROUP BY novo)"""

H5B = CREATED + """
SELECT novo AS id_pedido, id_cliente, CAST(percentual_rateio AS DOUBLE) AS percentual_propriedade,
       CAST(CAST(ROUND(CAST(COALESCE(v, 0) AS DECIMAL(15,2)) * percentual_rateio * 0.01, 2) AS DECIMAL(15,2)) AS DOUBLE) AS valor_proporcional,
       'COMPRADOR' AS tipo_participacao
FROM created LEFT JOIN valores USING (novo)"""

H5C = CREATED + """
SELECT novo AS id_pedido, id_produto, CAST(CAST(quantidade AS DECIMAL(12,2)) AS DOUBLE) AS quantidade,
       CAST(CAST(preco_unitario AS DECIMAL(12,2)) AS DOUBLE) AS preco_unitario, CAST(subtotal AS DOUBLE) AS subtotal
FROM linhas"""

H5D = """
SELECT id_pedido AS id_solicitacao, ['SEM_PROPRIETARIOS', 'JSON_INVALIDO', 'CLIENTE_AUSENTE', 'PERCENTUAL_99.50'][1 + id_pedido % 5] AS motivo
FROM (SELECT DISTINCT id_pedido FROM pedido_clientes) WHERE id_pedido % 5 < 4"""

H11 = """, donos AS (
  SELECT id_pedido, string_agg(concat_ws('|', id_cliente, nome, tipo_cliente, percentual_rateio, valor_rateado), ';' ORDER BY percentual_rateio DESC, id_cliente) AS proprietarios
  FROM pedido_clientes LEFT JOIN clientes USING (id_cliente) GROUP BY id_pedido),
linhas AS (
  SELECT id_pedido, string_agg(concat_ws('|', id_produto, nome, quantidade, i.preco_unitario, subtotal), ';'
                               ORDER BY id_produto, i.preco_unitario, quantidade, subtotal) AS itens
  FROM itens_pedido i JOIN produtos USING (id_produto) GROUP BY id_pedido)
SELECT id_pedido, 0::BIGINT AS parte, 1::BIGINT AS partes, strftime(data_pedido, '%Y-%m-%d') AS data_pedido, id_cliente, status,
       CAST(valor_total AS DOUBLE) AS valor_total, coalesce(proprietarios, '') AS proprietarios, coalesce(itens, '') AS itens
FROM pedidos LEFT JOIN donos USING (id_pedido) LEFT JOIN linhas USING (id_pedido)"""

L4C = """, somas AS (SELECT id_pedido, CAST(sum(subtotal) AS DECIMAL(15,2)) AS novo, sum(subtotal) AS v FROM itens_pedido GROUP BY id_pedido),
corrigidos AS (SELECT id_pedido, novo FROM pedidos JOIN somas USING (id_pedido) WHERE abs(valor_total - v) > 0.01)
SELECT id_pedido, 2 AS versao, CAST(novo AS DOUBLE) AS valor_total, 'UPDATE' AS operacao, 1 AS versao_anterior,
       (SELECT CAST(sum(CAST(round(novo * percentual_rateio * 0.01, 2) AS DECIMAL(15,2))) AS DOUBLE) FROM pedido_clientes s
        WHERE s.id_pedido = corrigidos.id_pedido) AS valor_rateado
FROM corrigidos"""

H11B = """, n_own AS (SELECT id_pedido, COUNT(*) AS k FROM pedido_clientes GROUP BY 1),
n_it AS (SELECT id_pedido, COUNT(*) AS k FROM itens_pedido GROUP BY 1)
SELECT p.id_pedido, CAST(0 AS BIGINT) AS parte,
       CAST(1 AS BIGINT) AS partes,
       COALESCE(o.k, 0) AS n_proprietarios, COALESCE(i.k, 0) AS n_itens
FROM pedidos p LEFT JOIN n_own o ON o.id_pedido = p.id_pedido LEFT JOIN n_it i ON i.id_pedido = p.id_pedido"""

# The groups of the stand-in tables: one per nation, every fifth closed, every fourth customer gone.
H9 = """
SELECT CAST(n_nationkey + 1 AS BIGINT) AS id_grupo, n_name AS nome_grupo,
       ['COOPERATIVA', 'ASSOCIACAO', 'CONSORCIO', 'GRUPO_INFORMAL'][1 + n_nationkey % 4] AS tipo_grupo,
       min(c_custkey) AS representante_id, arg_min(c_name, c_custkey) AS representante, count(c_custkey) AS total_membros
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey % 5 <> 4 GROUP BY n_nationkey, n_name"""

H10 = """
FROM clientes JOIN customer ON c_custkey = id_cliente
SELECT id_cliente, nome, tipo_cliente, regiao, (id_cliente % 1000) * 5 / 100.0 AS percentual_participacao, CAST(data_cadastro AS VARCHAR) AS data_entrada
WHERE c_nationkey = 0 AND id_cliente % 4 <> 0"""

SQL = {"H11_order_documents": H11, "L4c_published_correction": L4C, "H9_active_groups": H9, "H10_group_members": H10, "H5_create_shared_orders": H5, "H5b_shared_order_owners": H5B, "H5c_shared_order_lines": H5C, "H5d_rejected_requests": H5D, "H11b_order_document_sizes": H11B,
    "H1_shared_participants": H1, "H2_sharing_kpis": H2, "H3_sharing_by_region": H3,
    "H4_generate_shares": H4, "H6_refresh_proportional_values": H6, "H7_share_check": H7,
    "H8_ownership_view": H8,
}
NEEDS_SHARES = set(SQL) - {"H9_active_groups", "H10_group_members"}
