from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from orderlens.llm import mixing
from tests.llm import brute


def test_targets_and_copies(docs, rows):
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(text.split())
    want = brute.targets(sizes)
    taken = Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert r.copies in (int(want[r.source] // sizes[r.source]), int(want[r.source] // sizes[r.source]) + 1) and r.copies <= 2
        taken[r.source] += r.size * r.copies
    for s in sizes:  # within a tenth, with a few dozen documents a source
        assert abs(taken[s] - want[s]) <= 0.1 * want[s]
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_reruns_agree(docs):
    a, b = (sorted(map(tuple, mixing.mix(d).select("doc_id", "copies").collect())) for d in (docs, docs.repartition(11)))
    assert a == b


def test_emitted_rows(docs):
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    out = mixing.emit(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({k: v for k, v in copies.items() if v})


def test_fractions_are_probabilities(spark):
    """Over many documents of one size each rate's fraction is the share that gets one copy more."""
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"),
                                    F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"))
    share = {r.source: r.s for r in mixing.mix(df).groupBy("source").agg((F.sum("copies") / F.count("*")).alias("s")).collect()}
    want = brute.targets({"s0": 6667 * 3, "s1": 6667 * 3, "s2": 6666 * 3})
    for s, x in share.items():
        assert x == pytest.approx(want[s] / 20_000, abs=0.005)


def test_odd_rows(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert [by[i][0].size for i in (1000, 1001, 1002, 1006, 1004)] == [0, 0, 0, 2, 1]
    assert by[1005][0].copies == by[1005][1].copies
    assert by[1001][0].source_size == 0 and by[1001][0].target == 0  # the null source has no words
    assert mixing.emit(odd).columns == odd.columns
    assert mixing.mix(none).count() == 0 and mixing.emit(none).count() == 0
