from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=240, seed=7):
    """Rows of documents: words of syllables, shared lines, fields with numbers, exact and near copies."""
    r = random.Random(seed)
    syllables = ["an", "ti", "on", "the", "re", "sh", "ou", "wh", "ed", "ly", "ing", "or"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    line = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    common = [line(9) for _ in range(6)] + ["Released under version {} of the common terms of use here."]
    rows = []
    for i in range(n):
        kind = r.random()
        if rows and kind < 0.15:
            text = r.choice(rows[:40])[1]
        elif rows and kind < 0.45:  # near copy: some words changed
            w = r.choice(rows[:15])[1].split(" ")
            for _ in range(r.randint(1, 4)):
                w[r.randrange(len(w))] = word()
            text = " ".join(w)
        else:
            parts = [line(r.randint(4, 40)) for _ in range(r.randint(1, 5))]
            if r.random() < 0.5:
                parts.insert(r.randrange(len(parts) + 1), r.choice(common).format(r.randint(1, 99)))
            text = "\n".join(parts)
        rows.append((i, text, r.choice(["en", "de"]), "src0" if r.random() < 0.35 else f"src{r.randint(1, 6)}", len(text)))
    return rows


#: Odd rows: nulls, empty, blank and letterless texts, one long word, a long text, a repeated row.
LONG = "\n".join(" ".join(f"w{(i * 7919 + j) % 5003}x" for j in range(60)) for i in range(700))
ODD = [(1000, None, "en", "src0", None), (1001, "", "en", None, 0), (1002, " \n\t\n ", None, "src1", 5), (1003, "42 + 1 = 43 !!", "en", "src1", 14),
       (1004, "x" * 100_000, "de", "src2", 100_000), (1005, LONG, "en", "src3", len(LONG)), (1005, LONG, "en", "src3", len(LONG)),
       (1006, "One two", "en", "src0", 7), (1007, "ONE two", "en", "src0", 7), (1008, "Été à Noël, ça va bien 漢字 \U0001F600 ñandú", "fr", "src2", 40)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCUMENTS).repartition(6).cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, one with a null id, and extra columns whose names the operators use inside."""
    df = spark.createDataFrame([*ODD, (None, "A text without an id that is long enough", "en", "src9", None)], DOCUMENTS)
    for name in ("_id", "id", "n", "rows", "size", "node", "label", "keep_id", "n_lines", "rank", "lang_pred", "score", "_text", "copies", "_row"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)
