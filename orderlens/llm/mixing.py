"""Mixing sources to target weights by repetition rates and hash-seeded Bernoulli copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import cut, join_groups, words
from orderlens.plans.ranking import with_global_row_number

#: Seeds tried for each source; the one whose copies come nearest the target is used.
SEEDS = 32


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5,
                   most: float = 2.0) -> DataFrame:
    """One row per source of ``sizes`` (source, size): source, source_size, rows, target.

    Sources by code point, null last, weigh ``weights``, repeating.  They share ``share`` times all
    sizes by weight; a target stops at ``most`` times its source's size and the excess is shared
    anew by weight, until none is above.  Each round is one aggregate over the table of sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    ranked = with_global_row_number(per, [F.col("source").asc_nulls_last()], "_rank")
    per = cut(ranked.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                   (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int")))
              .withColumn("_most", F.lit(float(most)) * F.col("source_size")).drop("_rank"))
    total = share * (per.agg(F.sum("source_size")).first()[0] or 0)
    rate, full = 0.0, -1  # of words per unit of weight; sources at their most
    while True:
        at_most = F.col("_w") * F.lit(rate) > F.col("_most") if full >= 0 else F.lit(False)
        n, taken, weight = per.agg(F.count_if(at_most), F.sum(F.when(at_most, F.col("_most"))),
                                   F.sum(F.when(~at_most, F.col("_w")))).first()
        if n == full or not weight:
            break
        full, rate = n, (total - (taken or 0.0)) / weight
    return per.select("source", "source_size", "rows", F.least(F.col("_w") * F.lit(rate) if full >= 0 and weight else F.col("_most"),
                                                              F.col("_most")).alias("target"))


def _copies(seed: Column, doc: str, rate: Column) -> Column:
    """floor(rate) copies, and one more with the probability of the fraction, by a hash of seed and id."""
    draw = F.pmod(F.xxhash64(seed, F.col(doc)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("long")


def plan(sizes: DataFrame, **how) -> DataFrame:
    """Per source of ``sizes`` (_id, source, size): _source, source_size, rows, target, _rate, _seed."""
    targets = cut(source_targets(sizes, **how)
                  .withColumn("_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
                  .withColumn("_source", _key("source")).drop("source"))
    rows = join_groups(sizes.withColumn("_source", _key("source")), targets, ["_source"], "rows")
    tried = rows.groupBy("_source").agg(F.first("target").alias("_target"), *[
        F.sum(F.col("size") * _copies(F.lit(s), "_id", F.col("_rate"))).alias(f"_{s}") for s in range(SEEDS)])
    seeds = tried.select("_source", F.array_min(F.array(*[
        F.struct(F.abs(F.col(f"_{s}") - F.col("_target")).alias("off"), F.lit(s).alias("seed")) for s in range(SEEDS)]))
        .getField("seed").alias("_seed"))
    return cut(targets.join(seeds, "_source"))


def _key(source: str) -> Column:
    """The source as a key that is never null."""
    return F.to_json(F.struct(F.col(source).alias("source")))


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return cut(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """For each row of ``docs`` its copies in the mix: id, source, size, source_size, target, copies.

    Sizes are numbers of words, null texts have 0.  A source's repetition rate is its target over
    its size; a document is taken floor(rate) times, plus once more by a draw with the fraction's
    probability, seeded by its id: reruns agree, and repeated rows of one id are drawn alike.  Of
    SEEDS seeds each source uses the one whose words come nearest its target.  ``how`` goes to
    ``source_targets``.  A source without words has rate 0.  Null is a source of its own; a null id
    is drawn like any other value.  Other columns are ignored; an empty table gives no rows.
    """
    sizes = _sizes(docs, id_col, text_col, source_col)
    return (join_groups(sizes.withColumn("_source", _key("source")), plan(sizes, **how), ["_source"], "rows")
            .select(F.col("_id").alias(id_col), "source", "size", "source_size", "target",
                    _copies(F.col("_seed"), "_id", F.col("_rate")).alias("copies")))


def emit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: the rows of ``docs``, with their columns, as often as ``mix`` takes them.  Texts
    are not shuffled: sources are joined to them as hot groups or, when small, by source."""
    chosen = plan(_sizes(docs, id_col, text_col, source_col), **how).select("_source", "rows", "_rate", "_seed")
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}  # no clash with the plan's columns
    rows = docs.select(*[F.col(c).alias(n) for c, n in names.items()], _key(source_col).alias("_source"))
    taken = join_groups(rows, chosen, ["_source"], "rows").withColumn("_times", _copies(F.col("_seed"), names[id_col], F.col("_rate")))
    return (taken.where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
            .select(*[F.col(n).alias(c) for c, n in names.items()]))
