import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from orderlens.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (row[c] for c in FIELDS)))


def tree(digests):
    """The root and every leaf's (left, right) siblings, by the definition."""
    place, paths = list(range(len(digests))), [[] for _ in digests]
    while len(digests) > 1:
        for i, p in enumerate(place):
            run = p - p % 3
            paths[i].append(("".join(digests[run:p]), "".join(digests[p + 1:run + 3])))
            place[i] = p // 3
        digests = [sha("".join(digests[i:i + 3])) for i in range(0, len(digests), 3)]
    return digests[0], paths


def plain(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        groups[s] = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r["doc_id"]) for r in groups[s]))
    trees = [tree([x[2] for x in groups[s]]) for s in names]
    root, top = tree([t[0] for t in trees])
    return sorted((x[3] is not None, x[3] or 0, x[2], t[0], root, tuple(path + up)) for s, t, up in zip(names, trees, top) for x, path in zip(groups[s], t[1]))


def manifest(df):
    out = merkle.merkle_manifest(df, FIELDS, "source", "doc_id")
    return sorted((r.doc_id is not None, r.doc_id or 0, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.path)) for r in out.collect())


@pytest.mark.parametrize("levels", [1, 3, 6])
def test_against_plain_version(docs, monkeypatch, levels):
    """Blocks of 3, 27 and 729 leaves: several rounds and one give the same trees."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    assert manifest(docs) == plain([r.asDict() for r in docs.collect()])


def test_odd_rows(odd, none):
    """Null source and id, empty, long and repeated rows, clashing columns."""
    rows = [r.asDict() for r in odd.collect()]
    got = manifest(odd)
    assert got == plain(rows) and len(got) == len(rows)
    assert merkle.merkle_manifest(none, FIELDS, "source", "doc_id").count() == 0


def test_lone_leaf_is_the_root(spark):
    one = spark.createDataFrame([(5, "s", None, 1, "a")], "doc_id long, source string, lang string, n_chars long, text string")
    r = merkle.merkle_manifest(one, FIELDS, "source", "doc_id").first()
    assert r.leaf == r.subroot == r.root == sha("1:51:s-1:11:a") and r.path == []


def test_tampering_shows(docs):
    """Every changed leaf fails its proof, every unchanged one passes."""
    changed = merkle.leaf_digest([F.concat("text", F.lit("!")) if c == "text" else F.col(c) for c in FIELDS])
    out = merkle.merkle_manifest(docs, FIELDS, "source", "doc_id", {"changed": F.when(F.col("doc_id") % 3 == 0, changed)})
    checked = out.select("doc_id", (merkle.folded(F.col("path"), F.coalesce("changed", "leaf")) == F.col("root")).alias("ok"))
    assert all(r.ok == (r.doc_id % 3 != 0) for r in checked.collect())


def test_proofs_need_no_join_of_leaves(docs):
    """A block meets its path by grouping."""
    leaves = merkle.merkle_manifest(docs, FIELDS, "source", "doc_id")
    assert "Join" not in leaves._jdf.queryExecution().optimizedPlan().toString()
