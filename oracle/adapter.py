"""DuckDB form of the stand-in order tables (same rules as orderlens.sources.adapter).

Every oracle query is ``with_tables(body)``: these CTEs followed by the
operator's own SQL.  Only integer and decimal arithmetic is used so DuckDB
and Spark agree exactly.
"""

CLIENTES = """clientes AS (
  SELECT c.c_custkey AS id_cliente, c.c_name AS nome, c.c_mktsegment AS tipo_cliente,
         r.r_name AS regiao, n.n_name AS estado,
         CAST(DATE '1994-01-01' + CAST(c.c_custkey % 365 AS INTEGER) AS DATE) AS data_cadastro,
         CAST(c.c_acctbal AS DECIMAL(15,2)) AS limite_credito
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
                  JOIN region r ON n.n_regionkey = r.r_regionkey)"""

PRODUTOS = """produtos AS (
  SELECT p_partkey AS id_produto, p_name AS nome, p_type AS categoria, p_brand AS subcategoria,
         CAST(NULL AS VARCHAR) AS unidade,
         CAST(p_retailprice AS DECIMAL(12,2)) AS preco_unitario,
         CASE WHEN p_partkey % 5 = 0 THEN CAST(NULL AS DECIMAL(12,2))
              ELSE CAST(ROUND(CAST(p_retailprice AS DECIMAL(12,2)) * 0.65, 2) AS DECIMAL(12,2)) END AS custo_referencia
  FROM part)"""

ITENS = """itens_pedido AS (
  SELECT ROW_NUMBER() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
                                     l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
                                     l_shipdate) AS id_item,
         l_orderkey AS id_pedido, l_partkey AS id_produto,
         CAST(l_quantity AS DECIMAL(12,2)) AS quantidade,
         CAST((CAST(ROUND(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT)) * 0.01 AS DECIMAL(12,2)) AS preco_unitario,
         CAST(NULL AS VARCHAR) AS unidade,
         CAST(CAST(l_quantity AS DECIMAL(12,2))
              * CAST((CAST(ROUND(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT)) * 0.01 AS DECIMAL(12,2))
              AS DECIMAL(15,2)) AS subtotal
  FROM lineitem)"""

PEDIDOS = """pedidos AS (
  SELECT o.o_orderkey AS id_pedido,
         CAST(o.o_orderdate AS DATE) AS data_pedido,
         CAST(CAST(o.o_orderdate AS DATE) + CAST(o.o_orderkey % 30 AS INTEGER) AS DATE) AS data_entrega,
         o.o_custkey AS id_cliente,
         o.o_orderpriority AS tipo_contrato,
         CASE WHEN o.o_orderkey % 10 = 0 THEN 'Cancelado'
              WHEN o.o_orderstatus = 'F' THEN 'Executado'
              WHEN o.o_orderstatus = 'O' THEN 'Em Andamento'
              WHEN o.o_orderstatus = 'P' THEN 'Pendente' END AS status,
         CASE WHEN o.o_orderkey % 11 <> 0 THEN ['Norte', 'Nordeste', 'Centro-Oeste', 'Sudeste', 'Sul'][o.o_orderkey % 5 + 1] END AS regiao_origem,
         CASE WHEN o.o_orderkey % 13 <> 0 THEN ['Norte', 'Nordeste', 'Centro-Oeste', 'Sudeste', 'Sul'][o.o_orderkey % 7 % 5 + 1] END AS regiao_destino,
         CAST(CASE WHEN o.o_orderkey % 7 = 0 OR s.itens IS NULL THEN CAST(o.o_totalprice AS DECIMAL(15,2))
                   ELSE s.itens END AS DECIMAL(15,2)) AS valor_total
  FROM orders o
  LEFT JOIN (SELECT id_pedido, SUM(subtotal) AS itens FROM itens_pedido GROUP BY id_pedido) s
         ON s.id_pedido = o.o_orderkey)"""

ANCHOR = """anchor AS (
  SELECT COALESCE(MAX(data_pedido), CURRENT_DATE) AS ref FROM pedidos WHERE status != 'Cancelado')"""

# Share generator (H4) in SQL: same hash rule as orderlens.operators.sharing.
SHARES = """top_orders AS (
  SELECT id_pedido, id_cliente, valor_total FROM (
    SELECT id_pedido, id_cliente, valor_total,
           ROW_NUMBER() OVER (ORDER BY valor_total DESC, id_pedido) AS rn, COUNT(*) OVER () AS n FROM pedidos) t
  WHERE rn <= GREATEST(1, CAST(FLOOR(n * CAST(0.15 AS DOUBLE)) AS BIGINT))),
ranked AS (
  SELECT id_cliente, regiao, ROW_NUMBER() OVER (ORDER BY regiao NULLS FIRST, id_cliente) AS rn,
         COUNT(*) OVER () AS big_n FROM clientes),
regions AS (SELECT regiao, MIN(rn) AS start, COUNT(*) AS rcnt FROM ranked GROUP BY regiao),
picks AS (
  SELECT t.id_pedido, t.id_cliente, t.valor_total,
         CASE WHEN g.rcnt > 1 THEN g.start + (r.rn - g.start + 1 + ((t.id_pedido % 2147483648 * 1103515245 + 12345) % 2147483648) % (g.rcnt - 1)) % g.rcnt
              WHEN r.big_n > 1 THEN (r.rn + ((t.id_pedido % 2147483648 * 1103515245 + 12345) % 2147483648) % (r.big_n - 1)) % r.big_n + 1 END AS prn,
         2000 + ((t.id_pedido % 2147483648 * 1664525 + 1013904223) % 2147483648) % 2001 AS co_bp
  FROM top_orders t JOIN ranked r ON r.id_cliente = t.id_cliente
  JOIN regions g ON g.regiao IS NOT DISTINCT FROM r.regiao),
partners AS (SELECT p.*, r2.id_cliente AS partner FROM picks p JOIN ranked r2 ON r2.rn = p.prn),
pedido_clientes AS (
  SELECT id_pedido, id_cliente, CAST((10000 - co_bp) * 0.01 AS DECIMAL(5,2)) AS percentual_rateio,
         CAST(ROUND(valor_total * CAST((10000 - co_bp) * 0.01 AS DECIMAL(5,2)) * 0.01, 2) AS DECIMAL(15,2)) AS valor_rateado
  FROM partners
  UNION ALL
  SELECT id_pedido, partner, CAST(co_bp * 0.01 AS DECIMAL(5,2)),
         CAST(ROUND(valor_total * CAST(co_bp * 0.01 AS DECIMAL(5,2)) * 0.01, 2) AS DECIMAL(15,2))
  FROM partners)"""


def with_tables(body: str, shares: bool = False) -> str:
    ctes = [CLIENTES, PRODUTOS, ITENS, PEDIDOS, ANCHOR]
    if shares:
        ctes.append(SHARES)
    return "WITH " + ",\n".join(ctes) + "\n" + body
