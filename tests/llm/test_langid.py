import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from orderlens.llm import langid

SF = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(SF)
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and {r.doc_id for r in held} == {i for i in range(1000) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_labels_are_not_used(spark):
    docs = spark.read.parquet(SF)
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    run = lambda d: sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.identify(d).collect())
    assert run(docs) == run(other)


def test_odd_rows(odd, none):
    got = {}
    for r in langid.identify(odd).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == odd.count()
    for i in (1000, 1001, 1002, 1003):
        assert (got[i][0].lang_pred, got[i][0].score) == ("und", 0.0)
    assert got[1005][0] == got[1005][1] and got[1005][0].lang_pred in ("en", "de", "fr")
    assert got[None][0].held_out is False
    assert langid.identify(none).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_stretches_add_up(monkeypatch):
    """A long text has the same n-grams however it is cut into stretches."""
    text = " ".join(f"wörter{i} und{'!' * (i % 5)} mehr" for i in range(400))
    whole = np.sort(np.concatenate([h for h in langid._features(text)]))
    monkeypatch.setattr(langid, "STRETCH", 97)
    cut = np.concatenate([h for h in langid._features(text)])
    extra = len(cut) - len(whole)
    assert 0 <= extra
    assert np.isin(whole, cut).all()


def test_labels_past_one_block(spark, monkeypatch):
    """Every label is in the model, the rarest too, and blocks give the scores of one matrix."""
    rows = [(i, (chr(0x4E00 + 2 * i) + chr(0x4E01 + 2 * i)) * (2 if i % 5 else 9), f"l{i * 37 % 64}") for i in range(64)]
    docs = spark.createDataFrame([*rows, (99, "123", "en")], "doc_id long, text string, lang string")

    def run():
        return {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs.drop("lang"), langid.train(docs)).collect()}

    whole = run()
    monkeypatch.setattr(langid, "MAX_LANGS", 10)
    cut = run()
    assert all(whole[i][0] == cut[i][0] and abs(whole[i][1] - cut[i][1]) < 1e-9 for i in whole)
    assert all(cut[i][0] == lang for i, _, lang in rows) and cut[99] == ("und", 0.0)


def plain_naive_bayes(rows, held_out, smoothing=0.5):
    """{id: (language, probability)} by the textbook, n-gram by n-gram in plain integers."""
    def grams(text):
        s = re.sub(" +", " ", " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " ")
        for n in langid.ORDERS:
            for i in range(len(s) - n + 1):
                h = n
                for c in s[i:i + n]:
                    h = (h * 0x9E3779B97F4A7C15 % 2 ** 64) ^ ord(c)
                yield (h * 0xD6E8FEB86659FD93 % 2 ** 64) >> 48

    letters = lambda t: any(c.isalpha() for c in t or "")
    counts = {}
    for i, text, lang, *_ in rows:
        if lang is not None and letters(text) and not held_out(i):
            counts.setdefault(lang, Counter()).update(grams(text))
    out = {}
    for i, text, *_ in rows:
        if not letters(text) or not counts:
            out[i] = ("und", 0.0)
            continue
        g = list(grams(text))
        weight = min(1.0, langid.EVIDENCE / len(g))
        scores = {}
        for lang, c in counts.items():
            whole = sum(c.values()) + smoothing * langid.FEATURES
            scores[lang] = weight * sum(math.log((c[x] + smoothing) / whole) for x in g)
        top = max(scores.values())
        total = sum(math.exp(s - top) for s in scores.values())
        best = min(x for x, s in scores.items() if s == top)
        out[i] = (best, 1 / total)
    return out


def test_against_plain_naive_bayes(spark, rows):
    few = [(i, f"{text[:300]} {'sehr schön über Straße' if lang == 'de' else 'very nice over street'}", lang) for i, text, lang, *_ in rows[:90]]
    few += [(500, "schön", None), (501, "12 34", "en"), (502, None, "de"), (503, "", None)]
    docs = spark.createDataFrame(few, "doc_id long, text string, lang string").repartition(4)
    want = plain_naive_bayes(few, lambda i: zlib.crc32(str(i).encode()) % 3 == 1)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()} and {x[0] for x in want.values()} == {"en", "de", "und"}
    assert all(abs(got[i][1] - want[i][1]) < 1e-4 for i in want)


def test_long_text_of_many_languages_in_bounded_memory():
    """The evidence of a long text is looked up in parts, with the sums of the whole."""
    r = np.random.default_rng(3)
    langs = [f"l{i:02d}" for i in range(64)]
    matrix = r.normal(-9, 1, (langid.FEATURES, len(langs))).astype(np.float32)
    text = "".join(map(chr, r.integers(97, 123, 300_000)))
    tracemalloc.start()
    try:
        got = langid._best(text, langs, -1.0, matrix)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    grams = np.concatenate(list(langid._features(text)))
    times = np.bincount(grams, minlength=langid.FEATURES)
    want = -1.0 + times @ matrix.astype(np.float64) * (langid.EVIDENCE / len(grams))
    assert got[0] == langs[int(want.argmax())] and abs(got[1] - want.max()) < 1e-9
    assert peak < 50 << 20
