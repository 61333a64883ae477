"""N-gram Jaccard join by vertical partitioning, to connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import BROADCAST_ROWS, cut, forget, join_groups, python_ready
from orderlens.llm.graph import components

#: Fragments that the global n-gram order is cut into.
FRAGMENTS = 4

#: Fine fragments by hash, whose sizes bound the overlap of a pair before any n-gram is compared.
FINE = 64

#: Pairs are compared by the low 32 bits of their n-grams first, which moves half of the bytes.  Sets have up to NARROW n-grams
#: for that.  A few n-grams may then be alike or lost by chance; more than SLACK's number (of sets up to its key) of
#: them are far less likely than two equal 64-bit hashes, so pairs nearer the bound than that are compared in 64 bits.
NARROW, SLACK = 1 << 14, {1 << 10: 4, 1 << 14: 12}

#: Buckets of the n-gram counts (a power of two).  Frequent n-grams stand out from a bucket's mean count;
#: the larger the corpus, the more frequent they must be.
BUCKETS = 1 << 18

#: Sets of one n-gram that meet all others of it in one task, when all pairs are taken.
MEETING = 512

#: Sets whose copies one task leaves out of the prefixes, and of the n-grams that are dealt to ranges.
MEMO_SETS = 200_000

#: N-grams of a range of their hashes, whose repeats one task finds, about; n-grams and sets of a parcel that is dealt to them, at most.
RANGE, PARCEL, PARCEL_SETS = 2_000_000, 1_000_000, 1 << 16

#: Ids up to which texts are chosen by broadcast; the texts are shuffled for more of them.
BROADCAST_IDS = 1_000_000

# Odd 64-bit multipliers of the n-gram hash.
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def ngram_set(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's k-word n-grams, A-Z lower-cased; of fewer words, of
    the whole sequence; none without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    of = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(k, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        h = (h ^ of[i:len(words) - n + 1 + i]) * _MULTIPLIERS[i % 3]
        h ^= h >> np.uint64(29)
    h *= _MULTIPLIERS[0]
    return np.unique(h ^ (h >> np.uint64(32)))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _name(grams: np.ndarray) -> tuple[int, int]:
    """Two 64-bit halves of the 128-bit hash of a set."""
    d = xxhash.xxh3_128_digest(grams.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


class Order:
    """A total order of n-grams, rare ones first: by the count of the n-gram's bucket (in steps of a
    quarter of a doubling), then by hash.  Any such order gives right results; counts keep frequent
    n-grams out of the prefixes."""

    def __init__(self, counts: np.ndarray, fragments: int = FRAGMENTS):
        self.shift = np.uint64(64 - len(counts).bit_length() + 1)
        self.level = (4 * np.log2(np.maximum(counts, 1))).astype(np.uint8)
        share = np.bincount(self.level, weights=counts, minlength=256).cumsum()
        cuts = []
        for q in range(1, fragments):
            want = share[-1] * q / fragments
            at = int(np.searchsorted(share, want))
            low = share[at - 1] if at else 0.0
            inside = (want - low) / max(share[at] - low, 1.0)
            cuts.append((at << 56) + int(inside * 0.999 * (1 << 56)))
        self.cuts = np.array(cuts, np.uint64)

    def keys(self, grams: np.ndarray) -> np.ndarray:
        return (self.level[grams >> self.shift].astype(np.uint64) << np.uint64(56)) | (grams >> np.uint64(8))

    def sort(self, grams: np.ndarray) -> np.ndarray:
        return grams[np.lexsort((grams, self.level[grams >> self.shift]))]

    def fragment(self, grams: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts, self.keys(grams), "right")


def _signatures(docs: DataFrame, k: int) -> DataFrame:
    """(_id, n, h1, h2, sizes) of each row; ``sizes`` counts the set's n-grams in the FINE fragments
    (null for sets of millions, whose pairs it doesn't bound)."""
    names = ["_id", "n", "h1", "h2", "sizes"]
    types = [pa.int64()] * 4 + [pa.list_(pa.int16())]

    def sign(batches):
        forget()
        shift = np.uint64(64 - FINE.bit_length() + 1)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                grams = ngram_set(text.as_py(), k)
                sizes = np.bincount((grams >> shift).astype(np.int64), minlength=FINE)
                out.append((doc, len(grams), *_name(grams), sizes.astype(np.int16) if sizes.max() < 1 << 15 else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, types)], names)

    return docs.mapInArrow(sign, "_id long, n long, h1 long, h2 long, sizes array<smallint>")


def _steps(x: np.ndarray) -> bytes:
    """An ascending array of 16-bit numbers by its steps, in a byte each where all fit."""
    steps = np.diff(x, prepend=x.dtype.type(0))
    return (steps.astype(np.uint8) if steps.max(initial=0) < 256 else steps).tobytes()


def _places(steps: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, np.uint8 if len(steps) == n else np.uint16), dtype=np.int64)


def _kindred(docs: DataFrame, k: int, percent: int, total: int) -> DataFrame:
    """(h1) of the sets that may be similar to another one: those with percent of their n-grams in other sets too, as any that is
    similar to an unlike set has.  Some more may come (n-grams are compared by 32 bits inside a range of their hashes, and
    copies that two tasks meet share all of theirs), none are missed.

    All n-grams are shuffled once, in parcels: 32 bits of each, by ranges of their hashes.  A range finds those
    that repeat, and the parcel's sets count them.  ``total`` is about the number of n-grams."""
    bits = min(16, max(1, (total // RANGE).bit_length()))
    ranges = 1 << bits
    types, names = [pa.int32(), pa.int64(), pa.binary(), pa.binary()], ["part", "parcel", "sets", "grams"]

    def parcel(number: int, held: list[np.ndarray], named: list[int]) -> pa.RecordBatch:
        grams = np.concatenate(held)
        own = np.repeat(np.arange(len(held), dtype=np.uint16), [len(g) for g in held])
        part = (grams >> np.uint64(64 - bits)).astype(np.uint16)
        by = np.argsort(part, kind="stable")
        part, own, low = part[by], own[by], ((grams[by] << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        rows = [(int(part[i]), number, _steps(own[i:j]), low[i:j].tobytes()) for i, j in zip(cuts, cuts[1:])]
        rows.append((ranges + number % ranges, number, np.array(named, np.int64).tobytes(), np.array([len(g) for g in held], np.int64).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def deal(batches):
        forget()
        number, seen, held, named, size = TaskContext.get().partitionId() << 32, set(), [], [], 0
        for batch in batches:
            for text in batch.column(1):
                grams = ngram_set(text.as_py(), k)
                name = _name(grams)
                if not len(grams) or name in seen:
                    continue
                if len(seen) < MEMO_SETS:
                    seen.add(name)
                held.append(grams)
                named.append(name[0])
                size += len(grams)
                if size >= PARCEL or len(held) == PARCEL_SETS:
                    yield parcel(number, held, named)
                    number, held, named, size = number + 1, [], [], 0
        if held:
            yield parcel(number, held, named)

    def find(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if key[0].as_py() >= ranges:
            return table
        low = [np.frombuffer(x, np.uint32) for x in table["grams"].to_pylist()]
        every = np.concatenate(low)
        by = np.argsort(every)
        repeats = np.flatnonzero(every[by[1:]] == every[by[:-1]])
        shared = np.zeros(len(every), bool)
        shared[by[repeats]] = shared[by[repeats + 1]] = True
        sets, at = [], 0
        for steps, grams in zip(table["sets"].to_pylist(), low):
            sets.append(_steps(_places(steps, len(grams))[shared[at:at + len(grams)]].astype(np.uint16)))
            at += len(grams)
        counts = np.add.reduceat(shared.astype(np.int64), np.cumsum([0, *map(len, low[:-1])]))
        found = pa.table([table["part"], table["parcel"], pa.array(sets, pa.binary()), pa.array([int(c).to_bytes(4, "little") for c in counts], pa.binary())], names)
        return found.filter(pa.array(counts > 0))

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        named, sizes, places = None, None, []
        for part, sets, grams in zip(table["part"].to_pylist(), table["sets"].to_pylist(), table["grams"].to_pylist()):
            if part >= ranges:
                named, sizes = np.frombuffer(sets, np.int64), np.frombuffer(grams, np.int64)
            else:
                places.append(_places(sets, int.from_bytes(grams, "little")))
        common = np.bincount(np.concatenate(places), minlength=len(named)) if places else np.zeros(len(named), np.int64)
        return pa.table({"h1": pa.array(named[100 * common >= percent * sizes])})

    dealt = docs.mapInArrow(deal, "part int, parcel long, sets binary, grams binary")
    found = dealt.groupBy("part").applyInArrow(find, "part int, parcel long, sets binary, grams binary")
    return found.groupBy("parcel").applyInArrow(count, "h1 long").distinct()


def _of_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The ``docs`` whose _id is among ``ids``."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, ["_id"], "left_semi")


def _order(docs: DataFrame, k: int) -> Order:
    """The order of all n-grams, by counts in BUCKETS buckets of their hashes: a task sends one number
    for each at most, and so does the sum of all to the driver."""
    bits = BUCKETS.bit_length() - 1

    def count(batches):
        forget()
        sums = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            grams = [ngram_set(text.as_py(), k) for text in batch.column(1)]
            if grams:
                sums += np.bincount((np.concatenate(grams) >> np.uint64(64 - bits)).astype(np.int64), minlength=BUCKETS)
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(sums[found], pa.int64())], ["bucket", "c"])

    got = docs.mapInArrow(count, "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[got["bucket"].to_numpy()] = got["c"].to_numpy()
    return Order(counts)


def _prefixes(docs: DataFrame, k: int, percent: int, order) -> DataFrame:
    """(gram, h1, rest): the rarest n-grams of each set, one of which any similar set shares
    among its own rarest; ``rest`` counts the set's n-grams from this one on.  Copies that one task meets
    (while it remembers MEMO_SETS sets) come once."""
    def post(batches):
        forget()
        by, seen = order.value, set()
        for batch in batches:
            for text in batch.column(1):
                grams = ngram_set(text.as_py(), k)
                n = len(grams)
                if not n:
                    continue
                p = n - -(-percent * n // 100) + 1
                name = _name(grams)
                if name in seen:
                    continue
                if len(seen) < MEMO_SETS:
                    seen.add(name)
                yield pa.RecordBatch.from_arrays([_signed(by.sort(grams)[:p]), pa.array(np.full(p, name[0])),
                                                  pa.array(np.arange(n, n - p, -1, dtype=np.int32))], ["gram", "h1", "rest"])

    def joined(batches, rows=65_536):
        held, size = [], 0
        for b in post(batches):
            held.append(b)
            size += b.num_rows
            if size >= rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return docs.mapInArrow(joined, "gram long, h1 long, rest int")


def _segments(docs: DataFrame, k: int, order, bits: int = 64) -> DataFrame:
    """(h1, h2, fragment, grams): each set cut by the fragments of the global order; the grams' low ``bits``."""
    kind, arrow, named = (np.int32, pa.int32(), "int") if bits == 32 else (np.int64, pa.int64(), "long")

    def cut_up(batches):
        forget()
        by = order.value
        for batch in batches:
            out = ([], [], [], [])
            for text in batch.column(1):
                grams = ngram_set(text.as_py(), k)
                h1, h2 = _name(grams)
                part = by.fragment(grams)
                for f in np.unique(part).tolist():
                    for column, value in zip(out, (h1, h2, f, grams[part == f].astype(f"u{bits // 8}").view(kind))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()),
                                              pa.array(out[3], pa.list_(arrow))], ["h1", "h2", "fragment", "grams"])

    return docs.mapInArrow(cut_up, f"h1 long, h2 long, fragment int, grams array<{named}>")


def _may_be(n: str, rest: str, m: str, rest2: str, percent: int) -> Column:
    """Whether two sets can be similar when the n-gram they meet at is their first common one."""
    return (100 + percent) * F.least(F.col(rest), F.col(rest2)) >= percent * (F.col(n) + F.col(m))


def _linked(overlap: Column, percent: int) -> Column:
    """Whether two sets of na and nb n-grams with so many in common are similar."""
    return 100 * overlap >= percent * (F.col("na") + F.col("nb") - overlap)


def _overlaps(docs: DataFrame, sides: DataFrame, k: int, order, bits: int) -> DataFrame:
    """(a, b, na, nb, _o) of the pairs whose two ``sides`` are given.  The two meet fragment by fragment of the
    global order, each fragment's overlap is counted apart, and the counts are summed."""
    segments = _segments(_of_ids(docs, cut(sides.select("_id").distinct())), k, order, bits)
    few = sides.count() <= BROADCAST_ROWS
    met = segments.join(F.broadcast(sides.drop("_id")) if few else sides.drop("_id"), ["h1", "h2"])
    a, b = (F.first(F.when(F.col("side") == x, F.col("grams")), ignorenulls=True) for x in "ab")
    return (met.groupBy("a", "b", "na", "nb", "fragment").agg(a.alias("_a"), b.alias("_b"))
            .groupBy("a", "b", "na", "nb").agg(F.sum(F.coalesce(F.size(F.array_intersect("_a", "_b")), F.lit(0))).alias("_o")))


def _similar(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, percent: int, order) -> DataFrame:
    """The ``pairs`` (a, b, na, nb) that are similar.  The sizes of the fine fragments bound a pair's
    overlap; those that it leaves are compared by 32 bits of each n-gram, and by 64 where that may not decide."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sized = cut(classes.join(nodes, "node", "left_semi").select("node", "sizes", F.struct("h1", "h2", F.col("rep").alias("_id")).alias("is")))
    few = sized.count() <= BROADCAST_ROWS
    for x in "ab":
        one = sized.select(F.col("node").alias(x), F.col("sizes").alias(f"_{x}"), F.col("is").withField("side", F.lit(x)).alias(f"_s{x}"))
        pairs = pairs.join(F.broadcast(one) if few else one, x)
    most = F.aggregate(F.zip_with("_a", "_b", lambda u, v: F.least(u, v)), F.lit(0), lambda u, v: u + v.cast("int"))
    most = F.coalesce(most, F.col("na"))
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    slack = F.when(large <= min(SLACK), F.lit(SLACK[min(SLACK)])).otherwise(F.lit(SLACK[NARROW]))
    narrow = (large <= NARROW) & _linked(small - slack, percent)
    sides = cut(pairs.where((100 + percent) * most >= percent * (F.col("na") + F.col("nb"))).withColumn("_narrow", narrow)
                .select("_narrow", "a", "b", "na", "nb", F.explode(F.array("_sa", "_sb")).alias("_s")).select("_narrow", "a", "b", "na", "nb", "_s.*"))
    near = cut(_overlaps(docs, sides.where("_narrow").drop("_narrow"), k, order, 32).where(_linked(F.col("_o") + slack, percent))
               .select("a", "b", _linked(F.col("_o") - slack, percent).alias("_sure")))
    unsure = sides.where("not _narrow").unionByName(sides.where("_narrow").join(near.where("not _sure").select("a", "b"), ["a", "b"], "left_semi"))
    exact = _overlaps(docs, cut(unsure.drop("_narrow")), k, order, 64).where(_linked(F.col("_o"), percent))
    return near.where("_sure").select("a", "b").unionByName(exact.select("a", "b"))


def _pairs(met: DataFrame) -> DataFrame:
    """Distinct (a, b, na, nb) of rows (node, n, node2, m)."""
    first = F.col("node") < F.col("node2")
    return met.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"),
                      F.when(first, F.col("n")).otherwise(F.col("m")).alias("na"),
                      F.when(first, F.col("m")).otherwise(F.col("n")).alias("nb")).distinct()


def _candidates(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str):
    """What both joins start from: (_id, _text) of the rows, their signatures, the classes of equal sets, an
    n-gram order, and (gram, node, n, rest) of the rarest n-grams that several classes share."""
    spark = docs.sparkSession
    python_ready(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    signed = cut(_signatures(docs, k))
    rows = signed.drop("sizes")
    classes = cut(signed.where("n > 0").groupBy("h1", "h2").agg(F.min("_id").alias("rep"), F.first("n").alias("n"), F.first("sizes").alias("sizes"), F.count(F.lit(1)).alias("rows"))
                  .withColumn("node", F.monotonically_increasing_id()))
    # only sets that share enough of their n-grams go on, so that what follows grows with these
    total = signed.agg(F.sum("n")).first()[0] or 0
    kindred = cut(classes.where("rep is not null").join(_kindred(docs, k, percent, total), "h1", "left_semi").select("h1", "node", "n", "rep"))
    some = _of_ids(docs, cut(kindred.select(F.col("rep").alias("_id")).distinct()))
    order = spark.sparkContext.broadcast(_order(some, k))

    # the n-grams are shuffled once, with half of the sets' names: those of one set alone are dropped where they meet
    gram = Window.partitionBy("gram")
    shared = (_prefixes(some, k, percent, order).withColumn("_a", F.min("h1").over(gram)).withColumn("_z", F.max("h1").over(gram))
              .where("_a < _z").groupBy("gram", "h1").agg(F.max("rest").alias("rest")))
    met = cut(shared.join(kindred, "h1").select("gram", "node", F.col("n").cast("int").alias("n"), F.col("rest").cast("int").alias("rest")))
    return docs, rows, classes, order, met


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row of ``docs`` with its n-gram set's size and its component: id, n_shingles, component_id.

    Sets of distinct k-word n-grams of whole texts are linked when 100 * intersection >= percent *
    union.  component_id is the smallest id that links lead to, the row's own included.

    Equal sets are one class from the start, so copies are never paired.  Classes are candidates
    when they share one of their rarest n-grams, as every similar pair does, and the n-grams from
    there on can still suffice.  First each class meets, per shared n-gram, only the class that
    has most n-grams from it on; after the components of these links, classes that stay outside the
    component of that one meet all of other components.  So no link between components is lost,
    and a group of near copies costs about one pair per member and n-gram, not all pairs.  A pair's
    overlap is counted fragment by fragment of the global n-gram order, and the counts are summed.

    Rows without words have size 0 and are linked with nothing.  Rows with a null id belong to the
    component of an equal set, if any, but link nothing and are no component_id.  Repeated rows are
    equal sets; other columns are ignored; an empty table gives no rows.
    """
    docs, rows, classes, order, met = _candidates(docs, k, percent, id_col, text_col)
    # each n-gram's sets with its pivot, in one shuffle; only where some set of the n-gram could still be similar
    gram = Window.partitionBy("gram")
    pivot = F.max(F.struct((F.col("rest") / F.col("n")).alias("share"), (-F.col("node")).alias("node"), "n", "rest")).over(gram)
    near = cut(met.withColumn("_p", pivot).withColumn("_least", F.min("n").over(gram)).withColumn("_c", F.count(F.lit(1)).over(gram))
               .where((F.col("_c") > 1) & ((100 + percent) * F.col("rest") >= percent * (F.col("n") + F.col("_least"))))
               .select("gram", "node", "n", "rest", (-F.col("_p.node")).alias("node2"), F.col("_p.n").alias("m"), F.col("_p.rest").alias("rest2")))
    stars = cut(_pairs(near.where((F.col("node") != F.col("node2")) & _may_be("n", "rest", "m", "rest2", percent))))
    links = cut(_similar(docs, classes, stars, k, percent, order))
    labels = cut(components(links, "a", "b"))
    small = labels.count() <= BROADCAST_ROWS

    def labelled(df: DataFrame, node: str, label: str) -> DataFrame:
        of = labels.select(F.col("node").alias(node), F.col("component").alias(label))
        return df.join(F.broadcast(of) if small else of, node, "left").withColumn(label, F.coalesce(label, node))

    named = labelled(near, "node", "label")
    outside = cut(labelled(named, "node2", "label2").where("label <> label2")
                  .select("gram", F.col("node").alias("node2"), F.col("n").alias("m"), F.col("rest").alias("rest2"), F.col("label").alias("label2")))
    few = outside.count() <= BROADCAST_ROWS
    others = named.select("gram", "node", "n", "rest", "label").join(F.broadcast(outside) if few else outside, "gram")
    others = others.where((F.col("label") != F.col("label2")) & _may_be("n", "rest", "m", "rest2", percent))
    more = cut(_pairs(others).join(stars, ["a", "b"], "left_anti"))
    if more.limit(1).count():
        links = links.unionByName(_similar(docs, classes, more, k, percent, order))
        labels = components(links, "a", "b")
    named_classes = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named_classes.groupBy("component").agg(F.min("rep").alias("component_id"))
    named_classes = cut(named_classes.join(smallest, "component").select("h1", "h2", "rows", "component_id"))
    return (join_groups(rows.where("n > 0"), named_classes, ["h1", "h2"], "rows").select("_id", "n", "component_id")
            .unionByName(rows.where("n = 0").select("_id", "n", F.col("_id").alias("component_id")))
            .select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id"))


def jaccard_links(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links of the join whose components jaccard_components has, as two tables.

    Members, one row per row of ``docs``: id, n_shingles, class_id, n_links.  Rows of equal n-gram sets
    are one class, named by its set's 128-bit hash in hex.  n_links counts the other rows with an id
    that the row is linked with, those of its own class included.  Pairs, one row per two linked
    classes: class_a < class_b; each row of the one is linked with each of the other.

    All candidate pairs are verified, none are left to links of others, so that the work and the pairs grow
    with the square of the number of unlike sets in a group of near copies; copies cost nothing.  The sets
    of a frequent n-gram meet in blocks of MEETING, so that no task has all of its pairs.

    Rows without words have a null class and no links.  Rows with a null id are members of their
    class, but have no links (0) and count as none; a class of such rows alone is in no pair.
    """
    docs, rows, classes, order, met = _candidates(docs, k, percent, id_col, text_col)
    counts = cut(met.groupBy("gram").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1"))
    blocks = F.ceil(F.col("_c") / MEETING).cast("int")
    met = cut(join_groups(met, counts, ["gram"], "_c").withColumn("_blocks", blocks))
    one = met.withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")).select("gram", "block", "node", "n", "rest")
    all_blocks = met.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    others = all_blocks.select("gram", "block", F.col("node").alias("node2"), F.col("n").alias("m"), F.col("rest").alias("rest2"))
    pairs = cut(_pairs(one.join(others, ["gram", "block"]).where((F.col("node") < F.col("node2")) & _may_be("n", "rest", "m", "rest2", percent))))
    links = cut(_similar(docs, classes, pairs, k, percent, order))

    sizes = rows.where("n > 0 and _id is not null").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("own"))
    named = cut(classes.join(sizes, ["h1", "h2"], "left").withColumn("own", F.coalesce("own", F.lit(0)))
                .withColumn("class_id", F.lower(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in ("h1", "h2")]))))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = (both.join(named.select(F.col("node").alias("b"), "own"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("own").alias("_linked")))
    classed = cut(named.join(linked, "node", "left").select("h1", "h2", "rows", "class_id", (F.col("own") + F.coalesce("_linked", F.lit(0)) - 1).alias("n_links")))
    members = (join_groups(rows.where("n > 0"), classed, ["h1", "h2"], "rows")
               .select("_id", "n", "class_id", F.when(F.col("_id").isNull(), 0).otherwise(F.col("n_links")).cast("long").alias("n_links"))
               .unionByName(rows.where("n = 0").select("_id", "n", F.lit(None).cast("string").alias("class_id"), F.lit(0).cast("long").alias("n_links")))
               .select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "class_id", "n_links"))
    a, b = (named.select(F.col("node").alias(x), F.col("class_id").alias(f"_{x}")) for x in "ab")
    return members, (links.join(a, "a").join(b, "b").select(F.least("_a", "_b").alias("class_a"), F.greatest("_a", "_b").alias("class_b")))
