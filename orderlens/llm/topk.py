"""Exact top-k inner-product search: a ball tree per shard, searched by branch and bound."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import cut, python_ready

#: Vectors of a shard and queries of a block, about.
SHARD, BLOCK = 4096, 1024

#: Points of a leaf, at most (more only when all are equal).  Large enough that a leaf's products take longer than the step to it.
LEAF = 256

#: Bytes of trees, and of queries, that one task has at a time, about; tasks for each core, at least.
CELL_BYTES, CELLS = 32 << 20, 8

#: From here on a scaled component or a score leaves 64 bits.
PAST_64_BITS = 2.0 ** 63

LOWEST, NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class BallTree:
    """Nodes over integer points: spans of the reordered points, center, radius, smallest id, children."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order, nodes = np.arange(len(ids)), []
        waiting = [(0, len(ids), -1, 0)]
        while waiting:
            start, stop, parent, side = waiting.pop()
            here = order[start:stop]
            x = points[here].astype(np.float64)
            center = x.mean(axis=0)
            far = ((x - center) ** 2).sum(axis=1)
            nodes.append([start, stop, -1, -1, int(ids[here].min()), center, math.sqrt(far.max()) if len(far) else 0.0])
            if parent >= 0:
                nodes[parent][2 + side] = len(nodes) - 1
            if stop - start <= LEAF or far.max() == 0.0:
                continue
            one = x[far.argmax()]
            two = x[((x - one) ** 2).sum(axis=1).argmax()]
            left = ((x - one) ** 2).sum(axis=1) <= ((x - two) ** 2).sum(axis=1)
            if left.all():  # equal as floats, though not to their mean
                continue
            order[start:stop] = np.concatenate([here[left], here[~left]])
            at = start + int(left.sum())
            me = len(nodes) - 1
            waiting += [(start, at, me, 0), (at, stop, me, 1)]
        self.ids, self.points = ids[order], points[order]
        self.spans = np.array([n[:5] for n in nodes], np.int64).reshape(-1, 5)
        self.centers, self.radii = np.array([n[5] for n in nodes]), np.array([n[6] for n in nodes])

    def upper(self, queries: np.ndarray) -> np.ndarray:
        """(query, node) bounds of the integer scores: <q, center> + |q| * radius, with room for rounding."""
        q = queries.astype(np.float64)
        size, far = np.sqrt((q * q).sum(axis=1))[:, None], np.sqrt((self.centers ** 2).sum(axis=1)) + self.radii
        bound = q @ self.centers.T + size * self.radii[None, :]
        bound = np.floor(bound + 1e-6 + 1e-9 * np.abs(bound) + 1e-15 * (q.shape[1] + 8) * size * far[None, :])
        inside = (bound < PAST_64_BITS) & (bound > -PAST_64_BITS)
        return np.where(inside, np.where(inside, bound, 0.0).astype(np.int64), np.where(bound > 0, np.iinfo(np.int64).max, LOWEST + 1))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, kth: np.ndarray, kth_id: np.ndarray,
               found: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, ids) of each query among the points but its ``own`` id, and those ``found`` before.  ``kth`` and
        ``kth_id`` are the k-th scores and ids that the queries have elsewhere; what can't beat them is
        passed over, and so is left out.  Nodes are opened in the order of their bounds."""
        scores, ids = (x.copy() for x in found) if found else (np.full((len(queries), k), LOWEST), np.full((len(queries), k), NO_ID))
        upper, least = self.upper(queries), self.spans[:, 4]
        kth, kth_id = _better(scores, ids, kth, kth_id)
        # no sum of a product's terms, in any order, is beyond the product of the lengths: whole numbers that the float type holds
        most = math.sqrt((queries.astype(np.float64) ** 2).sum(axis=1).max(initial=0)) * (math.sqrt((self.centers[0] ** 2).sum()) + self.radii[0])
        kind = np.float32 if most < 2.0 ** 23 else np.float64 if most < 2.0 ** 52 else None
        asked = queries.astype(kind or np.int64)
        heap = [(-int(upper[:, 0].max(initial=LOWEST + 1)), 0)]
        while heap:
            _, node = heapq.heappop(heap)
            on = np.flatnonzero((upper[:, node] > kth) | ((upper[:, node] == kth) & (least[node] < kth_id)))
            if not len(on):
                continue
            start, stop, one, two, _ = self.spans[node].tolist()
            if one >= 0:
                for child in (one, two):
                    heapq.heappush(heap, (-int(upper[on, child].max()), child))
                continue
            points, names = self.points[start:stop], self.ids[start:stop]
            if kind:
                new = asked[on] @ points.T.astype(kind)
                at, to = np.divmod(np.flatnonzero(new >= kth[on].astype(kind)[:, None]), stop - start)
            else:
                new = _products(asked[on], points.astype(np.int64), own[on][:, None] != names[None, :])
                at, to = np.nonzero(new >= kth[on][:, None])
            new, row, name = new[at, to].astype(np.int64), on[at], names[to]
            good = (name != own[row]) & ((new > kth[row]) | (name < kth_id[row]))
            if not good.any():
                continue
            new, row, name = new[good], row[good], name[good]
            rows = np.unique(row)
            row, new, name = (np.concatenate(x) for x in ((np.repeat(rows, k), row), (scores[rows].ravel(), new), (ids[rows].ravel(), name)))
            best = np.lexsort((name, ~new, row))  # ~x: descending without overflow
            first = np.searchsorted(row[best], rows)
            best = best[(first[:, None] + np.arange(k)[None, :])]
            scores[rows], ids[rows] = new[best], name[best]
            kth[rows], kth_id[rows] = _better(scores[rows], ids[rows], kth[rows], kth_id[rows])
        return scores, ids


def _better(scores: np.ndarray, ids: np.ndarray, kth: np.ndarray, kth_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The better of the k-th (score, id) here and elsewhere, for each query."""
    here = (scores[:, -1] > kth) | ((scores[:, -1] == kth) & (ids[:, -1] < kth_id))
    return np.where(here, scores[:, -1], kth), np.where(here, ids[:, -1], kth_id)


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in the fewest of 2, 4 or 8 bytes each that hold them all."""
    low, high = x.min(initial=0), x.max(initial=0)
    return x.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)).tobytes()


def _unpacked(x: bytes, rows: int, dims: int) -> np.ndarray:
    return np.frombuffer(x, f"i{len(x) // (rows * dims)}" if rows * dims else np.int16).reshape(rows, dims)


def _products(a: np.ndarray, b: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The integer inner products of the rows of ``a`` and ``b``; an error for one ``asked`` that leaves 64 bits.  Sums modulo
    2**64 are right when the product is inside; what may not be is computed again in Python."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    most = np.abs(x) @ np.abs(y).T
    for i, j in zip(*np.nonzero(asked & (most * (1 + 1e-9) >= PAST_64_BITS))):
        score = sum(p * q for p, q in zip(a[i].tolist(), b[j].tolist()))
        if not -1 << 63 <= score < 1 << 63:
            raise OverflowError(f"the score {score} leaves 64 bits")
    return a @ b.T


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(flat), dims)


def _usable(v: Column) -> Column:
    x = F.transform(v, lambda e: e.cast("double"))
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    past = F.raise_error(F.lit("a component leaves 64 bits")).cast("long")
    whole = F.transform(x, lambda e: F.when(F.abs(e * 256) < PAST_64_BITS, F.floor(e * 256).cast("long")).otherwise(past))
    return F.when(v.isNotNull() & ~F.coalesce(bad, F.lit(True)), whole)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          shard_rows: int = SHARD, block_rows: int = BLOCK) -> DataFrame:
    """The k highest integer inner products of every query vector with all other vectors: query_id,
    rank, vec_id, score; ties go to the smaller id.

    A component x counts as floor(256 * x).  Vectors are dealt to shards by their place, not by id or
    value; each shard's ball tree is built once and written.  Blocks of queries first search one
    shard each; the k-th scores found there are shared with the search of all other shards, where
    nodes that can't beat them aren't opened.  For that, groups of shards and bands of blocks that fit one task
    meet in cells: each block goes to each group once, not to each shard, and a query has k rows of a cell.

    Vectors that are null or hold a null or non-finite component, and null ids take no part.  Scores are exact,
    whatever the components; a component of 2**55 or more, or a score met that leaves 64 bits, is an error.  Vectors meet those of their own length only.  A query's own are all rows of its
    id; a repeated query row is answered for each row.  Fewer than k others: all.  An empty table
    gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    python_ready(spark)
    rows = cut(vectors.select(F.col(id_col).cast("long").alias("id"), _usable(F.col(vector_col)).alias("v"), is_query.alias("q"))
               .where("id is not null and v is not null").withColumn("row", F.monotonically_increasing_id()).withColumn("dims", F.size("v")))
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if("q")).first()
    shards, blocks = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(asked / block_rows))

    def plant(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dims, shard = (x.as_py() for x in key)
        t = BallTree(table["id"].to_numpy(), _matrix(table["v"], dims))
        parts = [t.ids.tobytes(), _packed(t.points), *(x.tobytes() for x in (t.spans, t.centers, t.radii))]
        return pa.table({"dims": pa.array([dims], pa.int32()), "shard": pa.array([shard], pa.int64()), "bytes": pa.array([sum(map(len, parts))], pa.int64()),
                         "tree": pa.array([parts], pa.list_(pa.binary()))})

    def grown(dims: int, parts: list[bytes]) -> BallTree:
        t = BallTree.__new__(BallTree)
        t.ids, t.spans, t.radii = np.frombuffer(parts[0], np.int64), np.frombuffer(parts[2], np.int64).reshape(-1, 5), np.frombuffer(parts[4])
        t.points, t.centers = _unpacked(parts[1], len(t.ids), dims), np.frombuffer(parts[3]).reshape(len(t.spans), dims)
        return t

    def bundle(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dims, block = (x.as_py() for x in key)
        parts = [np.ascontiguousarray(table[x].to_numpy(), np.int64).tobytes() for x in ("row", "id", "kth", "kth_id")] + [_packed(_matrix(table["v"], dims))]
        return pa.table({"dims": pa.array([dims], pa.int32()), "block": pa.array([block], pa.int64()), "queries": pa.array([parts], pa.list_(pa.binary()))})

    def searched(trees: DataFrame, queries: DataFrame, on: str, at_home: bool) -> DataFrame:
        """The best of each query in all trees of its cell ``on``: in its block's home shard, or in the others."""
        def search(key: tuple[pa.Scalar, ...], planted: pa.Table, bundles: pa.Table) -> pa.Table:
            dims, out = key[0].as_py(), [[np.empty(0, np.int64)] for _ in range(4)]
            forest = [(s, grown(dims, t)) for s, t in zip(planted["shard"].to_pylist(), planted["tree"].to_pylist())]
            for block, parts in zip(bundles["block"].to_pylist(), bundles["queries"].to_pylist()):
                row, own, kth, kth_id = (np.frombuffer(x, np.int64) for x in parts[:4])
                v, best = _unpacked(parts[4], len(row), dims), None
                for shard, tree in forest:
                    if (block % shards == shard) == at_home:
                        best = tree.search(v, own, k, kth, kth_id, best)
                if best:
                    found = best[1] != NO_ID
                    at, _ = np.nonzero(found)
                    for column, values in zip(out, (row[at], own[at], best[1][found], best[0][found])):
                        column.append(values)
            return pa.table([pa.array(np.concatenate(c)) for c in out], ["row", "query_id", "vec_id", "score"])

        return (trees.select(*{"dims": 0, on: 0, "shard": 0, "tree": 0}).groupBy("dims", on).cogroup(queries.select("dims", on, "block", "queries").groupBy("dims", on))
                .applyInArrow(search, "row long, query_id long, vec_id long, score long"))

    def bundled(queries: DataFrame) -> DataFrame:
        return (queries.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
                .groupBy("dims", "block").applyInArrow(bundle, "dims int, block long, queries array<binary>"))

    trees = cut(rows.withColumn("shard", F.pmod(F.xxhash64(F.col("row"), F.lit(1)), F.lit(shards))).groupBy("dims", "shard")
                .applyInArrow(plant, "dims int, shard long, bytes long, tree array<binary>"))
    queries = rows.where("q")
    first = bundled(queries.withColumn("kth", F.lit(LOWEST)).withColumn("kth_id", F.lit(NO_ID))).withColumn("shard", F.pmod(F.col("block"), F.lit(shards)))
    near = cut(searched(trees.where(F.col("shard") < blocks), first, "shard", True))
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))  # k rows of a query and cell at most
    known = near.withColumn("_at", place).where(F.col("_at") == k).select("row", F.col("score").alias("kth"), F.col("vec_id").alias("kth_id"))
    again = cut(bundled(queries.join(known, "row", "left").withColumn("kth", F.coalesce("kth", F.lit(LOWEST))).withColumn("kth_id", F.coalesce("kth_id", F.lit(NO_ID)))))
    # a cell is a group of shards and a band of blocks that fit one task; queries are shuffled once for each group, trees once for each band
    size = trees.agg(F.sum("bytes")).first()[0] or 0
    asks = again.agg(F.sum(F.aggregate("queries", F.lit(0).cast("long"), lambda x, y: x + F.octet_length(y)))).first()[0] or 0
    groups = min(shards, max(math.ceil(size / CELL_BYTES), CELLS * spark.sparkContext.defaultParallelism))
    bands = min(blocks, math.ceil(asks / CELL_BYTES) or 1)
    cell = lambda group, band: F.concat_ws(" ", group, band)
    numbers = lambda most: F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    grid = trees.withColumn("_band", numbers(bands)).withColumn("cell", cell(F.pmod("shard", F.lit(groups)), F.col("_band")))
    rest = again.withColumn("_group", numbers(groups)).withColumn("cell", cell(F.col("_group"), F.pmod("block", F.lit(bands))))
    return (near.unionByName(searched(grid, rest, "cell", False))
            .withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
