import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.llm.topk import BallTree, LOWEST, NO_ID, top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every, k=5):
    whole = lambda v: [math.floor(256 * float(np.float32(x))) for x in v]
    ok = [(i, whole(v)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(b) == len(a))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def run(spark, rows, every=50, **how):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("clash")).withColumn("score", F.lit(0))
    return sorted(tuple(r) for r in top_k(df, F.col("vec_id") % every == 0, **how).collect())


def test_many_shards_and_blocks(spark):
    """Clusters, one vector a third of all rows, and ties throughout."""
    r = np.random.default_rng(1)
    centers = r.normal(size=(6, 8))
    rows = [(i, ([0.5] * 8 if i % 3 == 0 else (centers[i % 6] + 0.1 * r.normal(size=8)).tolist()), 0) for i in range(900)]
    assert run(spark, rows, 20, shard_rows=100, block_rows=16) == plain(rows, 20)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, None, 0), (3, [None, 1.0], 0), (4, [float("nan"), 1.0], 0), (5, [float("inf"), 1.0], 0),
            (None, [1.0, 1.0], 0), (6, [-1.0, 0.003], 0), (50, [1.0], 0), (100, [3.0], 0), (7, [2.0], 0), (150, [1e9, 1.0], 0), (200, [], 0), (8, [], 0)]
    assert run(spark, rows) == plain(rows, 50)
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0], 0)]) == []


def test_repeated_rows(spark):
    rows = [(0, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0)]
    assert run(spark, rows) == [(0, 1, 1, 65536)] * 2 + [(0, 2, 1, 65536)] * 2


@pytest.mark.parametrize("seed", range(4))
def test_bounds_hold_and_prune(seed):
    r = np.random.default_rng(seed)
    points = np.concatenate([r.integers(-300, 300, (1, 6)) + r.integers(-20, 20, (400, 6)) for _ in range(8)])
    ids = r.permutation(len(points)).astype(np.int64)
    tree = BallTree(ids, points)
    queries = points[:50]
    true = queries @ tree.points.T
    upper = tree.upper(queries)
    for n, (start, stop, *_rest) in enumerate(tree.spans.tolist()):
        assert (true[:, start:stop].max(axis=1) <= upper[:, n]).all()
    none = np.full(50, LOWEST), np.full(50, NO_ID)
    scores, found = tree.search(queries, ids[:50], 5, *none)
    again, same = tree.search(queries, ids[:50], 5, scores[:, -1], found[:, -1] + 1)
    assert (again[:, 0] == scores[:, 0]).all() and (same[:, 0] == found[:, 0]).all()


def test_large_components(spark, tmp_path):
    """The query answers for vectors with large components, exactly, and fails where a score leaves 64 bits."""
    from orderlens.llm.queries import op2_exact_topk

    r = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x * 2.0 ** (21 if i % 4 else 0))) for x in r.normal(size=4)], 0) for i in range(120)]
    rows += [(200, [2.0 ** 22, 1.0, 0.0, 0.0], 0), (250, [1.0, 2.0 ** 40, 0.0, 0.0], 0)]  # its product with itself is not asked for
    rows = [(i, [v[0], 0.0, *v[2:]] if i < 200 else v, 0) for i, v, _ in rows]  # so that 250's scores stay inside
    whole = {i: [math.floor(256 * x) for x in v] for i, v, _ in rows}
    want = []
    for q in (0, 50, 100, 200, 250):
        best = sorted((-sum(x * y for x, y in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(tuple(x) for x in op2_exact_topk(spark, str(tmp_path)).collect()) == sorted(want)
    spark.createDataFrame([(0, [2.0 ** 30], 0), (1, [2.0 ** 30], 0)], SCHEMA).write.parquet(f"{tmp_path}/past/embeddings.parquet")
    with pytest.raises(Exception, match="leaves 64 bits"):
        op2_exact_topk(spark, f"{tmp_path}/past").collect()


def test_many_equal_large_vectors():
    """Equal vectors whose mean isn't theirs as floats are a leaf, however many."""
    points = np.tile([0x2ab54a98ceb1f0b, 0x3243f6a8885a308, 0x1b7e151628aed2a], (1000, 1))
    tree = BallTree(np.arange(1000), points)
    assert len(tree.ids) == 1000 and sorted(tree.ids) == list(range(1000))
    scores, ids = tree.search(np.ones((2, 3), np.int64), np.array([0, 5000]), 2, np.full(2, LOWEST), np.full(2, NO_ID))
    assert ids.tolist() == [[1, 2], [0, 1]] and (scores == points[0].sum()).all()


@pytest.mark.parametrize("scale", [1, 1 << 12, 1 << 20, 1 << 27])
def test_scores_are_exact_at_all_sizes(scale):
    """Products in 32-bit floats, 64-bit floats or integers, whichever holds them; ties and found rows count."""
    r = np.random.default_rng(scale)
    points = r.integers(-9, 9, (700, 5)) * scale + r.integers(0, 2, (700, 5))
    ids, queries = r.permutation(700).astype(np.int64), points[:40]
    half = [BallTree(ids[x], points[x]) for x in (slice(0, 300), slice(300, 700))]
    none, found = (np.full(40, LOWEST), np.full(40, NO_ID)), None
    for tree in half:
        found = tree.search(queries, ids[:40], 5, *none, found)
    true = np.where(ids[:40, None] == ids[None, :], LOWEST, queries @ points.T)
    best = np.lexsort((np.broadcast_to(ids, true.shape), ~true), axis=1)[:, :5]
    assert (found[0] == np.take_along_axis(true, best, 1)).all() and (found[1] == ids[best]).all()


def test_cells_hold_every_pair_once(spark, monkeypatch):
    """Blocks go to groups of shards, not to each shard, in as many bands as their bytes ask for."""
    from orderlens.llm import topk

    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=8).tolist(), 0) for i in range(600)] + [(i, r.normal(size=3).tolist(), 0) for i in range(600, 640)]
    for size, cells in ((topk.CELL_BYTES, topk.CELLS), (2000, 0)):
        monkeypatch.setattr(topk, "CELL_BYTES", size)
        monkeypatch.setattr(topk, "CELLS", cells)
        assert run(spark, rows, 10, shard_rows=20, block_rows=8) == plain(rows, 10)
