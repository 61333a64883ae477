"""Business data model: schemas of the order tables and their fixed domains."""

from __future__ import annotations

from pyspark.sql import types as T

# Domains declared by the order model's CHECK constraints.
TIPOS_CLIENTE = ["Produtor Rural", "Cooperativa", "Trading Company", "Processadora", "Atacadista"]
CATEGORIAS = ["Commodity", "Serviço"]
TIPOS_CONTRATO = ["Spot", "A Termo", "Futuro"]
STATUS_PEDIDO = ["Executado", "Pendente", "Cancelado", "Em Andamento"]
TIPOS_CORRECAO = ["AUTOMATICA", "MANUAL"]
TIPOS_GRUPO = ["COOPERATIVA", "ASSOCIACAO", "CONSORCIO", "GRUPO_INFORMAL"]
TIPOS_PARTICIPACAO = ["COMPRADOR", "FINANCIADOR", "REPRESENTANTE"]
OPERACOES_AUDITORIA = ["INSERT", "UPDATE", "DELETE"]

CANCELADO = "Cancelado"


def _s(name, typ, nullable=True):
    return T.StructField(name, typ, nullable)


STR = T.StringType()
LONG = T.LongType()
INT = T.IntegerType()
DATE = T.DateType()
TS = T.TimestampType()
BOOL = T.BooleanType()
MONEY = T.DecimalType(15, 2)
PRICE = T.DecimalType(12, 2)
PCT = T.DecimalType(5, 2)

CLIENTES = T.StructType([
    _s("id_cliente", LONG, False), _s("nome", STR), _s("tipo_cliente", STR), _s("regiao", STR),
    _s("estado", STR), _s("data_cadastro", DATE), _s("limite_credito", MONEY),
])
PRODUTOS = T.StructType([
    _s("id_produto", LONG, False), _s("nome", STR), _s("categoria", STR), _s("subcategoria", STR),
    _s("unidade", STR), _s("preco_unitario", PRICE), _s("custo_referencia", PRICE),
])
PEDIDOS = T.StructType([
    _s("id_pedido", LONG, False), _s("data_pedido", DATE), _s("data_entrega", DATE),
    _s("id_cliente", LONG), _s("tipo_contrato", STR), _s("status", STR),
    _s("regiao_origem", STR), _s("regiao_destino", STR), _s("valor_total", MONEY),
])
ITENS_PEDIDO = T.StructType([
    _s("id_item", LONG), _s("id_pedido", LONG), _s("id_produto", LONG), _s("quantidade", PRICE),
    _s("preco_unitario", PRICE), _s("unidade", STR), _s("subtotal", MONEY),
])
PEDIDO_CLIENTES = T.StructType([
    _s("id_pedido", LONG, False), _s("id_cliente", LONG, False),
    _s("percentual_rateio", PCT), _s("valor_rateado", MONEY),
])
LOG_CORRECOES = T.StructType([
    _s("id_correcao", LONG), _s("id_pedido", LONG), _s("campo_corrigido", STR),
    _s("valor_anterior", MONEY), _s("valor_novo", MONEY), _s("tipo_correcao", STR),
    _s("usuario_correcao", STR), _s("motivo_correcao", STR), _s("data_correcao", TS),
])
GRUPOS_COMPRA = T.StructType([
    _s("id_grupo", LONG), _s("nome_grupo", STR), _s("tipo_grupo", STR), _s("representante_id", LONG),
    _s("data_criacao", DATE), _s("ativo", BOOL), _s("observacoes", STR),
])
CLIENTE_GRUPO = T.StructType([
    _s("id_cliente", LONG), _s("id_grupo", LONG), _s("percentual_participacao", PCT),
    _s("data_entrada", DATE), _s("ativo", BOOL),
])
PEDIDO_COPROPRIETARIO = T.StructType([
    _s("id_pedido", LONG), _s("id_cliente", LONG), _s("percentual_propriedade", PCT),
    _s("valor_proporcional", MONEY), _s("tipo_participacao", STR),
])
AUDITORIA_GLOBAL = T.StructType([
    _s("id_auditoria", LONG), _s("tabela_afetada", STR), _s("operacao", STR), _s("id_registro", LONG),
    _s("dados_anteriores", STR), _s("dados_novos", STR), _s("usuario_aplicacao", STR),
    _s("hash_integridade", STR), _s("data_hora", TS),
])

SCHEMAS = {
    "clientes": CLIENTES,
    "produtos": PRODUTOS,
    "pedidos": PEDIDOS,
    "itens_pedido": ITENS_PEDIDO,
    "pedido_clientes": PEDIDO_CLIENTES,
    "log_correcoes": LOG_CORRECOES,
    "grupos_compra": GRUPOS_COMPRA,
    "cliente_grupo": CLIENTE_GRUPO,
    "pedido_coproprietario": PEDIDO_COPROPRIETARIO,
    "auditoria_global": AUDITORIA_GLOBAL,
}

# Parents before children: the order a full refresh writes tables in.
LOAD_ORDER = ["clientes", "produtos", "pedidos", "itens_pedido", "pedido_clientes"]

# Surrogate key of each table (S5 high-water marks, N1 numbering).
KEYS = {
    "clientes": "id_cliente",
    "produtos": "id_produto",
    "pedidos": "id_pedido",
    "itens_pedido": "id_item",
}
