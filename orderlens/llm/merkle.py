"""Merkle dataset manifest: hash trees of rows per group and of the groups, with a proof for every row.

A row's leaf is the hash of its fields.  Leaves of a group ascend by key; every 3 neighbours become
their hash until one node is left, the group's subroot, and the subroots in the groups' order become
the root the same way.

The tree is a rollup.  A leaf's rank, written in base 3, is its path: grouping by the rank without its last
digit puts siblings together, and a node is a struct of its digest and its children's structs.  ``LEVELS``
digits are grouped away inside blocks of 3**LEVELS ranks, which one exchange brings together, so a
row never holds more than a block.  Block digests are the leaves of the next round.  From the top
down, each block's struct is then opened by one nested transform and explode, which emits every
child with its siblings' digests; a block meets its own path in a grouping by block, so that no
proof needs a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import cut, join_groups
from orderlens.plans.ranking import with_global_row_number

#: Children of a node.
FAN = 3

#: Levels that one round groups away: a block has at most FAN ** LEVELS nodes.
LEVELS = 4

_STEP = "struct<left: string, right: string>"


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 (lowercase hex) of the fields: ``-`` for null, else UTF-8 byte count, ``:``, value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda x: x["digest"]), "")


def _blocks(nodes: DataFrame) -> DataFrame:
    """One row per block of ``nodes`` (tree, r, n, digest, payload): tree, n, block, node."""
    rows = (nodes.select("tree", "n", F.call_function("div", F.col("r"), F.lit(FAN ** LEVELS)).alias("block"), F.col("r").alias("q"),
                         F.struct("digest", "payload").alias("node"))
            .repartition("tree", "block"))
    for level in range(LEVELS):
        child = F.struct((F.col("q") % FAN).alias("digit"), F.col("node"))
        rows = (rows.groupBy("tree", "n", "block", F.call_function("div", F.col("q"), F.lit(FAN)).alias("q"))
                .agg(F.sort_array(F.collect_list(child)).alias("kids"))
                .withColumn("kids", F.transform("kids", lambda x: x["node"])))
        # a tree that has come down to one node keeps its digest
        digest = F.when(F.col("n") <= FAN ** level, F.col("kids")[0]["digest"]).otherwise(F.sha2(_joined(F.col("kids")), 256))
        rows = rows.select("tree", "n", "block", "q", F.struct(digest.alias("digest"), "kids").alias("node"))
    return rows.drop("q")


def _opened(node: Column, level: int, above: Column, n: Column) -> Column:
    """Array of (payload, path) of all nodes below ``node``; a path lists siblings from the bottom up."""
    if not level:
        return F.array(F.struct(node["payload"].alias("payload"), above.alias("path")))
    kids = node["kids"]

    def child(kid: Column, i: Column) -> Column:
        step = F.struct(_joined(F.slice(kids, 1, i)).alias("left"), _joined(F.slice(kids, i + 2, FAN)).alias("right"))
        own = F.when(n > FAN ** (level - 1), F.array(step)).otherwise(F.array().cast(f"array<{_STEP}>"))
        return _opened(kid, level - 1, F.concat(own, above), n)

    return F.flatten(F.transform(kids, child))


def _paths(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Payload, path, subroot and root of every node under ``blocks``; ``above`` has the same of each block's
    own digest, by (tree, block)."""
    both = (blocks.select("tree", "block", "n", "node", F.lit(None).cast(f"struct<path: array<{_STEP}>, subroot: string, root: string>").alias("up"))
            .unionByName(above.select("payload.tree", "payload.block", F.lit(None).cast("long").alias("n"),
                                      F.lit(None).cast(blocks.schema["node"].dataType).alias("node"), F.struct("path", "subroot", "root").alias("up"))))
    met = both.groupBy("tree", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "node", "up")])
    opened = met.select(F.explode(_opened(F.col("node"), LEVELS, F.col("up.path"), F.col("n"))).alias("x"), "up.subroot", "up.root")
    return opened.select("x.payload", "x.path", "subroot", "root")


def _ranked(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with tree (their group's number, from 1), r (rank there, from 0) and n (the group's rows); the groups."""
    order = [F.col("group").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("digest").asc()]
    ranked = (with_global_row_number(leaves, order, "rn")
              .withColumn("name", F.coalesce(F.concat(F.lit("="), F.col("group")), F.lit("-"))))
    found = ranked.groupBy("name", "group").agg(F.min("rn").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = cut(with_global_row_number(found, [F.col("group").asc_nulls_first()], "tree").drop("group"))
    return join_groups(ranked, groups, ["name"], "n").withColumn("r", F.col("rn") - F.col("first")), groups


def merkle_manifest(rows: DataFrame, fields: list[str], group: str, key: str, keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``rows``: ``key`` (under its own name), leaf, subroot, root, path and the
    columns of ``keep`` (name to expression over ``rows``).

    ``path`` lists, from the leaf's level to the root's, the joined digests of the siblings to the
    left and to the right of the node on the way (both empty for a lone node, which is hashed too).
    ``folded`` follows it from any leaf, ``proof`` lists its digests.

    Null fields count as ``-``.  A null group is a group of its own, before the others; null keys
    come first in their group; rows of one key are ordered by leaf, so equal rows have
    neighbouring leaves of one digest.  Very long texts are hashed where they are read: only
    digests are shuffled.  An empty table gives no rows.  Other columns are ignored, whatever their names.
    """
    keep = keep or {}
    leaves = cut(rows.select(F.col(group).cast("string").alias("group"), F.col(key).alias("key"), leaf_digest([F.col(c) for c in fields]).alias("digest"),
                             F.struct(F.col(key).alias("key"), *[c.alias(name) for name, c in keep.items()]).alias("kept")))
    placed, groups = _ranked(leaves)
    nodes = placed.select("tree", "r", "n", "digest", F.struct("kept", "digest").alias("payload"))
    most, rounds = groups.agg(F.max("n")).first()[0] or 0, []
    while True:  # the groups' own trees, round by round
        rounds.append(cut(_blocks(nodes)))
        nodes = rounds[-1].select("tree", F.col("block").alias("r"), F.call_function("div", F.col("n") + FAN ** LEVELS - 1, F.lit(FAN ** LEVELS)).alias("n"),
                                  F.col("node.digest").alias("digest"), F.struct("tree", "block").alias("payload"))
        if most <= FAN ** LEVELS:
            break
        most = -(-most // FAN ** LEVELS)
    last, count = len(rounds), groups.count()
    nodes = nodes.select(F.lit(0).cast("long").alias("tree"), (F.col("tree") - 1).alias("r"), F.lit(count).cast("long").alias("n"), "digest",
                         F.struct("payload", F.col("digest").alias("subroot")).alias("payload"))
    while True:  # the tree of the groups
        rounds.append(cut(_blocks(nodes)))
        if count <= FAN ** LEVELS:
            break
        count = -(-count // FAN ** LEVELS)
        nodes = rounds[-1].select("tree", F.col("block").alias("r"), F.lit(count).cast("long").alias("n"),
                                  F.col("node.digest").alias("digest"), F.struct("tree", "block").alias("payload"))
    above = rounds[-1].select(F.struct("tree", "block").alias("payload"), F.array().cast(f"array<{_STEP}>").alias("path"),
                              F.lit(None).cast("string").alias("subroot"), F.col("node.digest").alias("root"))
    for i in range(len(rounds) - 1, -1, -1):
        above = _paths(rounds[i], above)
        if i == last:
            above = above.select("payload.payload", "path", "payload.subroot", "root")
    return above.select(F.col("payload.kept.key").alias(key), F.col("payload.digest").alias("leaf"), "subroot", "root", "path",
                        *[F.col("payload.kept").getField(name).alias(name) for name in keep])


def proof(path: Column) -> Column:
    """All sibling digests of a path, level by level, left to right, as one string."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf gives with the siblings of a path."""
    return F.aggregate(path, leaf, lambda below, s: F.sha2(F.concat(s["left"], below, s["right"]), 256))
