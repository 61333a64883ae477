"""Oracle SQL: sources and browsing (S4-S14), intent tags."""

S4 = """
SELECT 'clientes' AS tabela, COUNT(*) AS registros FROM clientes
UNION ALL SELECT 'produtos', COUNT(*) FROM produtos
UNION ALL SELECT 'pedidos', COUNT(*) FROM pedidos
UNION ALL SELECT 'itens_pedido', COUNT(*) FROM itens_pedido"""

S5 = """
SELECT 'clientes' AS tabela, 'id_cliente' AS chave, CAST(COALESCE(MAX(id_cliente), 0) AS BIGINT) AS maximo FROM clientes
UNION ALL SELECT 'produtos', 'id_produto', CAST(COALESCE(MAX(id_produto), 0) AS BIGINT) FROM produtos
UNION ALL SELECT 'pedidos', 'id_pedido', CAST(COALESCE(MAX(id_pedido), 0) AS BIGINT) FROM pedidos
UNION ALL SELECT 'itens_pedido', 'id_item', CAST(COALESCE(MAX(id_item), 0) AS BIGINT) FROM itens_pedido"""

S6 = """
FROM clientes SELECT id_cliente, regiao, tipo_cliente, nome, CAST(data_cadastro AS VARCHAR) AS data_cadastro,
  CAST(limite_credito AS DOUBLE) AS limite_credito"""

S6B = """, nomes AS (FROM clientes SELECT id_cliente, nome AS cliente)
FROM nomes NATURAL JOIN pedidos SELECT id_pedido, cliente, tipo_contrato, status, regiao_origem, regiao_destino,
  CAST(valor_total AS DOUBLE) AS valor_total, strftime(data_pedido, '%d/%m/%Y') AS data_pedido"""

S6D = """
FROM produtos SELECT * EXCLUDE (custo_referencia) REPLACE (CAST(preco_unitario AS DOUBLE) AS preco_unitario)"""

ITEMS = """
FROM produtos NATURAL JOIN (SELECT * EXCLUDE (preco_unitario, unidade), preco_unitario AS preco FROM itens_pedido)
SELECT id_item, id_pedido, nome AS produto, CAST(quantidade AS DOUBLE) AS quantidade,
  coalesce(CAST(preco AS DOUBLE), 0) AS preco_unitario, coalesce(CAST(subtotal AS DOUBLE), 0) AS subtotal"""

CUSTOMERS = """SELECT id_cliente, nome, tipo_cliente, regiao, estado, strftime(data_cadastro, '%d/%m/%Y') AS data_cadastro,
       CAST(COALESCE(limite_credito, 0) AS DOUBLE) AS limite_credito FROM clientes"""

S7 = "\n" + CUSTOMERS

S8 = """
SELECT id_produto, nome, categoria, subcategoria, unidade, CAST(COALESCE(preco_unitario, 0) AS DOUBLE) AS preco_unitario
FROM produtos"""

S9 = """, no_ano AS (FROM pedidos WHERE data_pedido BETWEEN DATE '2000-01-01' AND DATE '2000-12-31')
FROM no_ano NATURAL JOIN (FROM clientes SELECT id_cliente, nome AS cliente_nome)
SELECT id_pedido, cliente_nome, tipo_contrato, status, regiao_origem, regiao_destino, coalesce(CAST(valor_total AS DOUBLE), 0) AS valor_total,
  strftime(COLUMNS('^data_'), '%d/%m/%Y')"""

S12 = f""", cb AS ({CUSTOMERS})
SELECT * FROM cb WHERE contains(lower(nome), 'customer#0000001') OR contains(lower(regiao), 'customer#0000001')
ORDER BY id_cliente LIMIT 25 OFFSET 25"""

S12B = S12.replace("OFFSET 25", "OFFSET 50")

S14 = "\nSELECT id_cliente, nome, tipo_cliente, regiao FROM clientes"

S1 = """
SELECT 'clientes' AS tabela, count() AS registros, CAST(sum(id_cliente) AS BIGINT) AS soma_chaves FROM clientes
UNION ALL SELECT 'produtos', count(), CAST(sum(id_produto) AS BIGINT) FROM produtos
UNION ALL SELECT 'pedidos', count(), CAST(sum(id_pedido) AS BIGINT) FROM pedidos"""

S11 = """
FROM clientes SELECT CAST(to_json({'id_cliente': id_cliente, 'nome': nome, 'tipo_cliente': tipo_cliente, 'regiao': regiao, 'estado': estado,
  'data_cadastro': strftime(data_cadastro, '%d/%m/%Y'), 'limite_credito': CAST(coalesce(limite_credito, 0) AS DOUBLE)}) AS VARCHAR) AS registro"""

X2_CASE = """CASE WHEN contains(lower(text), 'ment') THEN 'produto'
            WHEN contains(lower(text), 'sch') THEN 'risco'
            WHEN contains(lower(text), 'ö') OR contains(lower(text), 'ß') THEN 'anomalia'
            WHEN contains(lower(text), 'tion') THEN 'tendencia' ELSE 'outros' END"""

X2 = f"\nSELECT conv_id, turn, role, {X2_CASE} AS intencao FROM conversations"

X2B = f"\nSELECT role, {X2_CASE} AS intencao, COUNT(*) AS mensagens FROM conversations GROUP BY 1, 2"

SQL = {
    "S1_tables_written_and_read": S1, "S11_json_records": S11,
    "S4_row_counts": S4, "S5_high_water_marks": S5, "S6_data_page_customers": S6,
    "S6b_data_page_orders": S6B, "S6d_data_page_products": S6D, "S6c_data_page_items": ITEMS, "S7_customer_browse": S7,
    "S8_product_browse": S8, "S9_order_browse": S9, "S10_item_browse": ITEMS,
    "S12_search_page": S12, "S12b_next_page": S12B, "S14_customer_pick_list": S14, "X2_intent_tags": X2, "X2b_intent_counts": X2B,
}
