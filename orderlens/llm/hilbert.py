"""Sharding along a Hilbert curve over quantised metadata, cut into runs of equal row counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import cut
from orderlens.plans.ranking import with_global_row_number

#: Bits of each dimension; three dimensions give 2 ** 12 cells.
BITS = 4


def curve(bits: int, dims: int) -> list[int]:
    """Position on the Hilbert curve of each cell of a ``dims``-dimensional grid with 2**bits steps
    a side; cells count with the first coordinate slowest.  The curve is walked from its start: each
    step of the Gray code gives the next sub-cube, entered at a corner and along an axis that the
    sub-cube's number decides, down to single cells."""
    n, mask = dims, (1 << dims) - 1
    turn = lambda x, k: ((x << (k % n)) | (x >> (n - k % n))) & mask
    gray = lambda i: i ^ (i >> 1)
    entry = lambda i: 0 if i == 0 else gray(2 * ((i - 1) // 2))

    def axis(i: int) -> int:
        if i == 0:
            return 0
        x = i - 1 if i % 2 == 0 else i
        return ((~x & (x + 1)).bit_length() - 1) % n

    out = [0] * (1 << (bits * dims))
    for h in range(len(out)):
        corner, along, at = 0, 0, [0] * dims
        for level in range(bits - 1, -1, -1):
            w = (h >> (level * n)) & mask
            cube = turn(gray(w), along + 1) ^ corner
            for d in range(dims):
                at[d] = (at[d] << 1) | ((cube >> d) & 1)
            corner ^= turn(entry(w), along + 1)
            along = (along + axis(w) + 1) % n
        cell = 0
        for x in at:
            cell = (cell << bits) | x
        out[cell] = h
    return out


def size_step(size: Column) -> Column:
    """A size on a scale of 16 steps, two to each doubling, from 64 up to 12,288."""
    k = F.length(F.bin(size)) - 1
    power = F.call_function("shiftleft", F.lit(1).cast("long"), k)
    half = (size >= power + F.shiftright(power, 1)).cast("int")
    return F.least(F.greatest(2 * k + half - 12, F.lit(0)), F.lit((1 << BITS) - 1)).cast("int")


def value_steps(rows: DataFrame, col: str) -> Column:
    """A text column on a scale of 16 steps of equally many distinct values, in code-point order; null
    is step 0 with the smallest.  The driver gets at most 15 values, the steps' first ones."""
    steps = 1 << BITS
    ranked = with_global_row_number(rows.select(col).where(F.col(col).isNotNull()).distinct(), [F.col(col)], "_rank", total_name="_all")
    step = F.call_function("div", (F.col("_rank") - 1) * steps, F.col("_all"))
    firsts = sorted((r for r in ranked.groupBy(step.alias("step")).agg(F.min(col).alias("first")).collect() if r["step"]), key=lambda r: r["step"])
    out = F.lit(0)
    for r in firsts:
        out = F.when(F.col(col) >= F.lit(r["first"]), F.lit(int(r["step"]))).otherwise(out)
    return out


def hilbert_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
                   dims: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """Each row of ``docs`` with its shard: id, size, text_crc32, law, hilbert, shard, slot, grown_shard.

    The cells of (two text columns, size), each quantised to 16 steps, are numbered along the
    Hilbert curve; rows sorted by that number, then by the columns, size and id are cut into runs
    whose row counts differ by one at most (law ``rows``).  A shard thus holds few languages, sources and
    size steps, and readers that filter by any of them skip most files.  ``slot`` counts a shard's
    rows from 0.  Size: UTF-8 bytes plus 1; null texts have none, and the checksum of an empty one.
    Only ids and these figures are shuffled, never texts; rows are ranked by range partitions, so a
    cell, source or text with a third of all rows is dealt to many tasks.  Equal texts of one
    source lie side by side.  Null values sort first; repeated rows take places of their own; an
    empty table gives no rows.  ``grown_shard`` is null: only key laws have it.
    """
    a, b = dims
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = cut(docs.select(F.col(id_col).alias("_id"), F.col(a).alias("_a"), F.col(b).alias("_b"),
                           (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")))
    cell = (value_steps(rows, "_a") * (1 << 2 * BITS) + value_steps(rows, "_b") * (1 << BITS) + size_step(F.col("size"))).cast("int")
    table = F.from_json(F.lit(str(curve(BITS, 3))), "array<int>")
    placed = rows.select("_id", "size", "text_crc32", "_a", "_b", F.element_at(table, cell + 1).alias("hilbert"))
    order = [F.col("hilbert"), F.col("_a").asc_nulls_first(), F.col("_b").asc_nulls_first(), F.col("size"),
             F.col("text_crc32"), F.col("_id").asc_nulls_first()]
    ranked = with_global_row_number(placed, order, "_rank", total_name="_all")
    zero, base, more = F.col("_rank") - 1, F.call_function("div", F.col("_all"), F.lit(shards)), F.col("_all") % shards
    big = more * (base + 1)  # rows of the first shards, which hold one row more
    small = F.nullif(base, F.lit(0))
    shard = F.when(zero < big, F.call_function("div", zero, base + 1)).otherwise(more + F.call_function("div", zero - big, small))
    slot = F.when(zero < big, zero % (base + 1)).otherwise((zero - big) % small)
    return ranked.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "hilbert",
                         shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
