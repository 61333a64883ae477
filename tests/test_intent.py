"""First matching intent in priority order, substring match, accents not folded."""

from orderlens.operators import intent


def test_priority_and_lexicons(spark):
    msgs = spark.createDataFrame([
        (1, "Qual produto tem MAIOR MARGEM?"), (2, "cliente em risco e venda"), (3, "anomalia pendente"),
        (4, "crescimento da receita"), (5, "bom dia"), (6, "correção da tendência"), (7, "Correcao do pedido")],
        "id long, text string")
    with_data = {r.id: r.intencao for r in intent.tag_messages(msgs).collect()}
    assert with_data == {1: "produto", 2: "risco", 3: "anomalia", 4: "tendencia", 5: "outros",
                         6: "outros",  # accented words do not match the unaccented keywords
                         7: "anomalia"}
    plain = {r.id: r.intencao for r in intent.tag_messages(msgs, lexicon=intent.LEXICO_SEM_DADOS).collect()}
    assert plain[7] == "outros" and plain[4] == "tendencia"  # 'correcao' is only in the data lexicon
    counts = {r.intencao: r.mensagens for r in intent.intent_counts(intent.tag_messages(msgs)).collect()}
    assert counts["outros"] == 2 and sum(counts.values()) == 7
