"""Tag messages with the first matching intent.

Matching is a plain substring test on the lower-cased whole text (accents are
not folded), intents tried in priority order -- a chain of built-in
``contains`` tests inside one projection, so it stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Intent keyword sets in priority order, for questions answered
# with data and without it (the plain set lacks 'maior margem', 'correcao', 'receita').
LEXICO_COM_DADOS = [
    ("produto", ["margem", "lucro", "rentavel", "produto", "maior margem"]),
    ("risco", ["risco", "inativo", "churn", "cliente"]),
    ("anomalia", ["anomalia", "divergencia", "pendente", "correcao"]),
    ("tendencia", ["tendencia", "crescimento", "venda", "faturamento", "receita"]),
]
LEXICO_SEM_DADOS = [
    ("produto", ["margem", "lucro", "rentavel", "produto"]),
    ("risco", ["risco", "inativo", "churn", "cliente"]),
    ("anomalia", ["anomalia", "divergencia", "pendente"]),
    ("tendencia", ["tendencia", "crescimento", "venda", "faturamento"]),
]
OUTROS = "outros"


def intent_of(text_col: str, lexicon=LEXICO_COM_DADOS) -> F.Column:
    """First intent of ``lexicon`` with a keyword contained in lower(text), else 'outros'."""
    t = F.lower(F.col(text_col))
    expr = None
    for intent, words in lexicon:
        cond = F.lit(False)
        for w in words:
            cond = cond | t.contains(w.lower())
        expr = F.when(cond, intent) if expr is None else expr.when(cond, intent)
    return F.coalesce(expr.otherwise(F.lit(None)), F.lit(OUTROS)) if expr is not None else F.lit(OUTROS)


def tag_messages(messages: DataFrame, text_col: str = "text", lexicon=LEXICO_COM_DADOS) -> DataFrame:
    """Every message with its intent."""
    return messages.withColumn("intencao", intent_of(text_col, lexicon))


def intent_counts(tagged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Messages per intent (optionally per extra columns such as role)."""
    return tagged.groupBy(*(by or []), "intencao").agg(F.count(F.lit(1)).alias("mensagens"))
