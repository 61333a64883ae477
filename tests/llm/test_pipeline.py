"""The pipeline against plain versions of its stages, each on its own input."""

from collections import Counter

import pytest

import corpus_pipeline as P
from tests.llm import brute


@pytest.fixture(scope="module")
def results(spark, docs, tmp_path_factory):
    out, now = {}, docs
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp(name))
        stage(spark, now, "").write.mode("overwrite").parquet(path)
        before, now = now, spark.read.parquet(path)
        out[name] = ([tuple(r) for r in before.collect()], [tuple(r) for r in now.collect()], now.columns)
    return out


def test_order_and_columns(results, docs):
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "source_mixing", "best_fit_packing"]
    assert all(results[n][2] == docs.columns for n, _ in P.STAGES[:-1])


def test_language(results):
    before, after, _ = results["language_id"]
    assert sorted(before) == sorted(after)  # all have letters


def test_lines(results):
    before, after, _ = results["line_dedup"]
    rest = {i: (t, n) for i, t, _, n in brute.line_dedup([r[:2] for r in before])}
    want = [(i, rest[i][0], lang, source, len(rest[i][0]) if rest[i][1] else n) for i, _, lang, source, n in before if rest[i][0].split() or not rest[i][1]]
    assert sorted(after) == sorted(want) and len(after) < len(before)


def test_near_copies(results):
    before, after, _ = results["ngram_jaccard"]
    stay = {i for i, _, c in brute.jaccard_components([r[:2] for r in before], 5, 80) if i == c}
    assert sorted(after) == sorted(r for r in before if r[0] in stay)


def test_mix(results):
    before, after, _ = results["source_mixing"]
    times = Counter(after)
    assert set(after) <= set(before) and max(times.values()) <= 2
    size, taken = Counter(), Counter()
    for r in before:
        size[r[3]] += len(r[1].split())
    for r in after:
        taken[r[3]] += len(r[1].split())
    for s, t in brute.targets(size).items():
        assert abs(taken[s] - t) <= 0.15 * t


def test_packed(results):
    before, after, columns = results["best_fit_packing"]
    assert columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert Counter(r[0] for r in after if r[1] == 0) == Counter(r[0] for r in before)
    full = Counter()
    for r in after:
        full[r[5]] += r[3]
    assert max(full.values()) <= 2048


def test_odd_rows(spark, odd, none, tmp_path):
    """Nulls, repeats and clashing columns pass through every stage; an empty table stays empty."""
    for k, df in enumerate((odd, none)):
        now = df
        for name, stage in P.STAGES:
            columns = now.columns
            now = stage(spark, now, "")
            now.write.parquet(f"{tmp_path}/{k}-{name}")
            now = spark.read.schema(now.schema).parquet(f"{tmp_path}/{k}-{name}")
            if name == "language_id" and k == 0:
                assert sorted({r.doc_id for r in now.collect()}, key=str) == sorted({1004, 1005, 1006, 1007, 1008, None}, key=str)
            if name == "ngram_jaccard" and k == 0:
                assert sorted((r.doc_id for r in now.collect()), key=str) == sorted([1004, 1005, 1006, 1008, None], key=str)
            if name != "best_fit_packing":
                assert now.columns == columns
        assert (now.count() > 0) == (k == 0)


def test_language_rejects(spark, docs):
    junk = spark.createDataFrame([(5000, "123 456 --- !!", "en", "src0", 3), (5001, None, "en", "src0", 3)], docs.schema)
    out = P.language_id(spark, docs.unionByName(junk), "")
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in docs.collect())


def test_near_copies_by_row(spark, docs):
    """Unlike texts of one id are apart, null ids are members, and the row that stays is defined."""
    one, two, three = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, one, "en", "src0", 1), (2, one, "en", "src1", 1), (2, two, "en", "src1", 1), (2, two, "de", "src1", 1), (3, f"{two} more", "en", "src2", 1),
            (None, one, "en", "src3", 1), (None, three, "en", "src3", 1), (None, three, "en", "src4", 1)]
    runs = [sorted(map(tuple, P.near_copies(spark, spark.createDataFrame(part, docs.schema).repartition(n), "").collect()), key=str)
            for part, n in ((rows, 1), (rows[::-1], 3))]
    assert runs[0] == runs[1]
    assert sorted(((r[0], r[1]) for r in runs[0]), key=str) == sorted([(1, one), (2, two), (None, three)], key=str)
