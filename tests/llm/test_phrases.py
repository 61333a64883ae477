import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.llm import hat_trie, phrases

DOCUMENTS = "doc_id long, text string, lang string"


def plain(rows, max_words=3, min_count=10, inside=50, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) by the definition."""
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(small)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, max_words + 1):
                f[lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        longer = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i:i + m]] = max(longer[p[i:i + m]], a)
        scored = []
        for p, a in found.items():
            score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            if not longer[p] or 100 * longer[p] < inside * a:
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for i, x in enumerate(sorted(scored)[:top])]
    return sorted(out)


def mined(df, **kw):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(df, **kw).collect())


@pytest.mark.parametrize("kw", [{}, {"max_words": 4, "min_count": 3, "inside_percent": 70}, {"max_words": 2, "min_count": 5, "top": 7}])
def test_against_plain_version(docs, rows, kw):
    got = mined(docs, **kw)
    assert got == plain([(r[1], r[2]) for r in rows], kw.get("max_words", 3), kw.get("min_count", 10), kw.get("inside_percent", 50), kw.get("top", 2000))
    assert len(got) > 10


def test_spills_and_bursts(docs, rows, monkeypatch):
    """Small bounds: containers burst, subtrees are spilled many times, pieces are cut."""
    for own, chunk in ((1, 1 << 18), (4, 30)):
        monkeypatch.setattr(hat_trie, "OWN", own)
        monkeypatch.setattr(hat_trie, "BURST", 8)
        monkeypatch.setattr(hat_trie, "PATHS", 500)
        monkeypatch.setattr(phrases, "_CHUNK", chunk)
        want = Counter()
        for lang in ("en", "de"):
            for text in (r[1] for r in rows if r[2] == lang):
                for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.lower()):
                    w = piece.split()
                    want[lang, ""] += len(w)
                    want.update((lang, " ".join(w[i:i + m])) for m in (1, 2, 3) for i in range(len(w) - m + 1))
        batches = [b for lang in ("en", "de") for b in _batches(lang, [r[1] for r in rows if r[2] == lang])]
        got, runs, largest = Counter(), 0, 0
        for run in phrases._runs(3, 20)(iter(batches)):
            runs += 1
            for r in run.to_pylist():
                found = hat_trie.unpack(r["phrases"]).decode().split("\n")
                largest = max(largest, len(found))
                for phrase, n in zip(found, np.frombuffer(hat_trie.unpack(r["counts"]), "<i8")):
                    got[r["lang"], phrase] += int(n)
        assert got == want and runs > 20 and largest < 1000


def _batches(lang, texts):
    import pyarrow as pa
    return [pa.RecordBatch.from_pydict({"lang": [lang] * 10, "text": (texts[i:i + 10] + [None] * 10)[:10]}) for i in range(0, len(texts), 10)]


def test_odd_rows(odd, none):
    got = mined(odd)
    assert got == plain([(r.text, r.lang) for r in odd.select("text", "lang").collect()])
    assert mined(none) == []


def test_pieces_case_and_nulls(spark):
    rows = [("Áé BB\tcc, dd ee bb", None)] * 10 + [(None, "en"), ("", "en"), ("x" * 200_000, "en"), ("a b c " * 70_000, "zz")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCUMENTS).withColumn("n", F.lit("clash")).withColumn("prefix", F.lit("clash"))
    got = mined(df)
    assert got == plain(rows) and ("und", "Áé bb cc") in [(r[0], r[2]) for r in got]


def test_wide_products(spark):
    """Scores whose products pass 64 bits."""
    a, big = 10**14, 10**15 - 1
    row = spark.range(1).select(phrases._score(F.lit(a), F.lit(big), F.lit(3 * a)).alias("s")).first()
    assert row.s == 10**6 * a * a // (big * 3 * a)


def _counted(texts, depth, parts, least=1):
    """Counts by language and phrase, through runs and their sums."""
    import pyarrow as pa
    batches = [pa.RecordBatch.from_pydict({"lang": [lang for lang, _ in texts], "text": [text for _, text in texts]})]
    runs = sorted((r for run in phrases._runs(depth, parts)(iter(batches)) for r in run.to_pylist()), key=lambda r: (r["part"], r["lang"]))
    got = [r for b in hat_trie.merged([pa.RecordBatch.from_pylist(runs, schema=hat_trie.RUN)], least) for r in b.to_pylist()]
    assert len({(r["lang"], r["phrase"]) for r in got}) == len(got)
    return {(r["lang"], r["phrase"]): r["f"] for r in got}


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 6])
@pytest.mark.parametrize("chunk", [1 << 18, 1, 9])
def test_cuts_and_sums_at_any_depth(monkeypatch, depth, chunk):
    """Odd characters, cuts inside pieces, bursts, spills and sums in several rounds change no count."""
    for name, value in (("OWN", 3), ("BURST", 6), ("PATHS", 300), ("MERGE_BYTES", 200)):
        monkeypatch.setattr(hat_trie, name, value)
    monkeypatch.setattr(phrases, "_CHUNK", chunk)
    rng = random.Random(depth)
    words = ["a", "b", "a", "c", "\x1c", "d\x85e", "f\u00a0g", "\x00", "\ufffd", "\u2028x", "\U0001f600", *map(str, range(40))]
    texts = [(rng.choice(["en", "de", "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ", ", "\n\n", ".  ", "\x0b", "\r"])
              for _ in range(rng.randrange(60)))) for _ in range(60)]
    texts += [("en", None), ("en", ""), ("none", " \n . "), ("de", "  a b"), ("de", "a b c d e f  ")]
    want = Counter()
    for lang, text in texts:
        want[lang, ""] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text or ""):
            w = re.findall(r"[^\x20\x09]+", piece)
            want[lang, ""] += len(w)
            want.update((lang, " ".join(w[i:i + m])) for m in range(1, depth + 1) for i in range(len(w) - m + 1))
    assert _counted(texts, depth, 12) == want
    assert _counted(texts, depth, 300, 4) == {k: n for k, n in want.items() if n >= 4 or not k[1]}


def test_words_are_counted_in_bulk():
    """Lines of Python that the trie runs don't grow with a text's words."""
    texts, lines = [("en", "one two, three four five six one two three. " * 20_000)], 0

    def trace(frame, event, arg):
        nonlocal lines
        if frame.f_code.co_filename != hat_trie.__file__:
            return None
        lines += event == "line"
        return trace
    sys.settrace(trace)
    try:
        got = _counted(texts, 3, 20)
    finally:
        sys.settrace(None)
    assert got["en", ""] == 180_000 and got["en", "one two"] == 40_000 and lines < 18_000
