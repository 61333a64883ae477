import random
import tracemalloc

import numpy as np
import pytest

from pyspark.sql import functions as F

from orderlens.llm import common, graph, jaccard
from orderlens.llm.graph import components
from tests.llm import brute


def run(df, k, percent):
    return sorted(tuple(r) for r in jaccard.jaccard_components(df, k, percent).collect())


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_against_plain_version(docs, rows, k, percent):
    want = brute.jaccard_components([(i, t) for i, t, *_ in rows], k, percent)
    assert run(docs, k, percent) == want
    assert len({x[2] for x in want}) < len(want)


def test_one_large_group_of_near_copies(spark):
    """Copies of one text with up to twelve words changed: links between copies, not to the first only."""
    r = random.Random(5)
    base = [f"w{r.randrange(10_000)}" for _ in range(150)]
    rows = []
    for i in range(160):
        w = list(base) if i % 3 else rows[r.randrange(len(rows))][1].split() if rows else list(base)
        for _ in range(r.randint(0, 7)):
            w[r.randrange(150)] = f"v{r.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(df, 3, 90) == brute.jaccard_components(rows, 3, 90)


def test_odd_rows(odd, none):
    got = {}
    for r in jaccard.jaccard_components(odd).collect():
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert sum(map(len, got.values())) == odd.count()
    assert got[1000] == [(0, 1000)] and got[1001] == [(0, 1001)] and got[1002] == [(0, 1002)]
    assert got[1004] == [(1, 1004)] and got[1006] == [(1, 1006)] and got[1007] == [(1, 1006)]  # ASCII case doesn't count
    assert len(got[1005]) == 2 and len(set(got[1005])) == 1
    assert got[None] == [(7, None)]
    assert jaccard.jaccard_components(none).count() == 0


def test_fragments_hold_every_ngram_once():
    grams = jaccard.ngram_set(" ".join(f"a{i}" for i in range(5000)), 3)
    order = jaccard.Order(np.bincount((grams >> np.uint64(48)).astype(int), minlength=1 << 16))
    sizes = np.bincount(order.fragment(grams), minlength=jaccard.FRAGMENTS)
    assert sizes.sum() == len(grams) and sizes.min() > 0.5 * len(grams) / jaccard.FRAGMENTS
    keys = order.keys(order.sort(grams))
    assert (keys[1:] >= keys[:-1]).all()


def test_components_of_a_path_a_star_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 260)] + [(300, 301), (301, 302), (302, 300)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()))
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, **{x: 7 for x in range(200, 260)}, 300: 300, 301: 300, 302: 300}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize("meeting", [512, 3])
def test_links_are_whole(spark, monkeypatch, meeting):
    """Every row's number of links, and every pair of unlike sets, in groups of near copies and of copies."""
    monkeypatch.setattr(jaccard, "MEETING", meeting)
    r = random.Random(9)
    texts = []
    for g in range(3):
        base = [f"g{g}w{r.randrange(10_000)}" for _ in range(120)]
        for _ in range(20):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(120)] = f"v{r.randrange(10_000)}"
            texts += [" ".join(w)] * r.randint(1, 3)
    rows = [*enumerate(texts), (1000, ""), (1001, None), (1002, "alone"), (None, texts[0]), (1003, "alone")]
    members, pairs = jaccard.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string"))
    members, pairs = members.collect(), {tuple(p) for p in pairs.collect()}
    sets = {i: brute.shingles(t, 3) for i, t in rows if i is not None}
    like = lambda x, y: bool(x) and bool(y) and 100 * len(x & y) >= 90 * len(x | y)
    want = {i: (len(s), sum(like(s, t) for j, t in sets.items() if j != i)) for i, s in sets.items()}
    assert {m.doc_id: (m.n_shingles, m.n_links) for m in members if m.doc_id is not None} == want and len(members) == len(rows)
    named = {sets[m.doc_id]: m.class_id for m in members if m.doc_id is not None}
    assert pairs == {(named[s], named[t]) for s in named for t in named if named[s] and named[t] and named[s] < named[t] and like(s, t)}
    assert [(m.class_id, m.n_links) for m in members if m.doc_id is None] == [(named[sets[0]], 0)]


def test_ngrams_are_shuffled_once(spark):
    """A task's copies give a set's rarest n-grams once, in narrow rows."""
    text = " ".join(f"w{i}" for i in range(100))
    df = spark.createDataFrame([(i, text) for i in range(5)] + [(9, text + " x")], "doc_id long, text string").coalesce(1)
    docs = df.toDF("_id", "_text")
    got = jaccard._prefixes(docs, 3, 90, spark.sparkContext.broadcast(jaccard._order(docs, 3)))
    assert got.columns == ["gram", "h1", "rest"] and got.count() == 10 + 10  # of 98 and 99 n-grams
    assert {c for _, _, c in run(df, 3, 90)} == {0}


def test_words_leave_nothing_behind():
    """A worker's memory doesn't grow with the words it has met."""
    tracemalloc.start()
    try:
        for part in range(20):
            jaccard.ngram_set(" ".join(f"word{part}x{i}" for i in range(2000)), 3)
        left = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert left < 1 << 20


def test_clear_pairs_move_half_of_the_bytes(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*words, f"end{i}"])) for i in range(5)] + [(9, " ".join(words[:20])), (10, " ".join([*words[:20], "end"]))]
    moved, segments = [], jaccard._segments

    def recorded(docs, k, order, bits):
        moved.append((bits, sorted(r[0] for r in docs.select("_id").collect())))
        return segments(docs, k, order, bits)

    monkeypatch.setattr(jaccard, "_segments", recorded)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(df, 3, 90) == brute.jaccard_components(rows, 3, 90)
    assert moved[:2] == [(32, [0, 1, 2, 3, 4]), (64, [9, 10])]  # short sets may hang on one n-gram


def test_groups_are_parted_only_where_one_is_hot(spark, monkeypatch):
    rows = spark.range(300).selectExpr("id % 100 key", "id")
    groups = rows.groupBy("key").agg(F.count("*").alias("n"))
    want = sorted(map(tuple, rows.join(groups, "key").collect()))
    for few, share, joins in ((100, 0.001, 1), (99, 0.1, 1), (99, 0.001, 3)):
        monkeypatch.setattr(common, "FEW_GROUPS", few)
        monkeypatch.setattr(common, "HOT_SHARE", share)
        got = common.join_groups(rows, groups, ["key"], "n")
        assert sorted(map(tuple, got.collect())) == want
        assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == joins


def test_small_graphs_are_one_partition(spark, monkeypatch):
    r = random.Random(5)
    edges = spark.createDataFrame([(r.randrange(300), r.randrange(300)) for _ in range(200)], "a long, b long").repartition(8, "a")
    got = components(edges, "a", "b")
    monkeypatch.setattr(graph, "SMALL", 0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, components(edges, "a", "b").collect()))
    assert got.rdd.getNumPartitions() == 1


@pytest.mark.parametrize("total", [0, 10 ** 9])
def test_only_sets_that_share_enough_go_on(spark, total):
    """Texts that share a passage with others cost nothing further; copies, near copies and sets inside others do go on."""
    r = random.Random(3)
    some = lambda n: [f"w{r.randrange(10 ** 9)}" for _ in range(n)]
    passage, base = some(60), some(100)
    texts = [" ".join([*some(40 + i), *passage, *some(30)]) for i in range(30)] + [" ".join([*base, w]) for w in some(4)] + [" ".join(passage), " ".join(some(20)), "", None]
    df = spark.createDataFrame([*enumerate(texts), (90, texts[3]), (91, "x y")], "_id long, _text string").repartition(5)
    sets = {i: jaccard.ngram_set(t, 5) for i, t in df.collect()}
    named = {jaccard._name(s)[0]: s for s in sets.values() if len(s)}
    want = {h for h, s in named.items() if 100 * len(np.intersect1d(s, np.concatenate([t for g, t in named.items() if g != h]))) >= 80 * len(s)}
    got = [h for h, in jaccard._kindred(df, 5, 80, total).collect()]
    assert len(set(got)) == len(got) and len(want) == 5 and want <= set(got) <= want | {jaccard._name(sets[3])[0]}
    met = jaccard._candidates(df, 5, 80, "_id", "_text")[-1]
    assert 0 < met.count() < 4 * 50 and {n for n, in met.select("n").distinct().collect()} <= {97}  # of four sets of 97 n-grams, not of all 60
    assert run(df.toDF("doc_id", "text"), 5, 80) == sorted((i, len(s), 30 if i in range(30, 34) else 3 if i == 90 else i) for i, s in sets.items())
