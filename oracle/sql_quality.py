"""Oracle SQL: data quality (Q1-Q4)."""

from orderlens.operators.quality import FOREIGN_KEYS, KEYS, RULES, _rule_name


def _viol(col, kind, param):
    if kind == "not_null":
        return f"{col} IS NULL"
    if kind == "max_len":
        return f"COALESCE(length({col}) > {param}, FALSE)"
    if kind == "in":
        dom = ", ".join("'" + v.replace("'", "''") + "'" for v in param)
        return f"COALESCE({col} NOT IN ({dom}), FALSE)"
    if kind == "gt":
        return f"COALESCE({col} <= {param}, FALSE)"
    if kind == "ge":
        return f"COALESCE({col} < {param}, FALSE)"
    if kind == "pct":
        return f"COALESCE({col} <= 0 OR {col} > 100, FALSE)"
    raise ValueError(kind)


def _q1():
    parts = []
    for t, c, k, p in RULES:
        parts.append(f"SELECT '{t}' AS tabela, '{_rule_name(c, k, p)}' AS regra, "
                     f"COUNT(CASE WHEN {_viol(c, k, p)} THEN 1 END) AS violacoes FROM {t}")
    return "\n" + "\nUNION ALL ".join(parts)


def _q2():
    parts = []
    for t, cols in KEYS:
        c = ", ".join(cols)
        parts.append(f"SELECT '{t}' AS tabela, '{','.join(cols)}' AS chave, COUNT(*) AS chaves_duplicadas, "
                     f"CAST(COALESCE(SUM(n), 0) AS BIGINT) AS linhas_em_duplicidade "
                     f"FROM (SELECT {c}, COUNT(*) AS n FROM {t} GROUP BY {c} HAVING COUNT(*) > 1) d")
    return "\n" + "\nUNION ALL ".join(parts)


def _q3():
    keys = dict(KEYS)
    parts = []
    for child, col, parent in FOREIGN_KEYS:
        pk = keys[parent][0]
        parts.append(f"SELECT '{child}' AS tabela, '{col}' AS coluna, '{parent}' AS referencia, COUNT(*) AS orfaos "
                     f"FROM {child} x WHERE x.{col} IS NOT NULL AND NOT EXISTS "
                     f"(SELECT 1 FROM {parent} y WHERE y.{pk} = x.{col})")
    return "\n" + "\nUNION ALL ".join(parts)


Q4 = """
SELECT COUNT(CASE WHEN s.s IS NOT NULL AND ABS(p.valor_total - s.s) > 0.01 THEN 1 END) AS divergentes,
       COUNT(CASE WHEN s.s IS NULL THEN 1 END) AS sem_itens, COUNT(*) AS total_pedidos
FROM pedidos p LEFT JOIN (SELECT id_pedido, SUM(subtotal) AS s FROM itens_pedido GROUP BY 1) s ON s.id_pedido = p.id_pedido"""

def _q1b():
    parts = []
    for t, c, k, p in RULES:
        if t == "pedidos":
            parts.append(f"SELECT id_pedido, '{_rule_name(c, k, p)}' AS regra FROM pedidos WHERE {_viol(c, k, p)}")
    return "\n" + "\nUNION ALL ".join(parts)


Q2B = "\n" + "\nUNION ALL ".join(
    f"SELECT 'itens_pedido' AS tabela, '{names}' AS chave, count(*) AS chaves_duplicadas, CAST(coalesce(sum(n), 0) AS BIGINT) AS linhas_em_duplicidade "
    f"FROM (SELECT count(*) AS n FROM lineitem GROUP BY {cols} HAVING count(*) > 1)"
    for names, cols in (("id_pedido,numero_linha", "l_orderkey, l_linenumber"), ("id_pedido,id_produto", "l_orderkey, l_partkey"), ("id_produto", "l_partkey")))

SQL = {"Q2b_line_keys": Q2B, "Q1b_violating_rows": _q1b(),"Q1_constraint_report": _q1(), "Q2_key_report": _q2(), "Q3_orphan_report": _q3(), "Q4_header_vs_lines": Q4}
NEEDS_SHARES = {"Q1_constraint_report", "Q2_key_report", "Q3_orphan_report"}
