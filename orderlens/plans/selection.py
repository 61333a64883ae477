"""Rows at given ranks of a global order, without sorting the table.

A sorted sample gives a bracket of keys around each wanted rank.  One aggregate counts the rows
below each bracket, so its rank is known exactly; the rows inside are selected from again, until they are few
enough to number.  Rows then compare their own key with the selected ones.  Only key columns are read, and nothing
but a bounded sample and the selected keys come to the driver.
"""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sort columns: name and whether it ascends.  NULLs come first when ascending, last when descending, as in Spark.
Sort = list[tuple[str, bool]]

#: Keys in a sample; rows that are numbered directly.
SAMPLE, FEW = 20_000, 200_000


def ordering(sort: Sort) -> list[Column]:
    return [F.col(c).asc() if up else F.col(c).desc() for c, up in sort]


def after(sort: Sort, key: Any, types: dict[str, str]) -> Column:
    """Whether a row comes after ``key`` (values by column name): the seek predicate of keyset paging."""
    out, equal = F.lit(False), F.lit(True)
    for c, up in sort:
        col, value = F.col(c), F.lit(key[c]).cast(types[c])
        if key[c] is None:
            beyond = col.isNotNull() if up else F.lit(False)
        else:
            beyond = col > value if up else (col < value) | col.isNull()
        out = out | (equal & F.coalesce(beyond, F.lit(False)))
        equal = equal & col.eqNullSafe(value)
    return out


def keys_at(df: DataFrame, sort: Sort, ranks: list[int], total: int | None = None) -> list[dict]:
    """The sort columns' values of the rows at ``ranks`` (from 1) in ``sort``, which must be a total order (a unique column
    last).  ``df`` is read once per round: twice for up to FEW rows, with a round more for every factor of about 50."""
    if not ranks:
        return []
    names = [c for c, _ in sort]
    types = {f.name: f.dataType.simpleString() for f in df.select(*names).schema}
    keys = df.select(*names)
    total = keys.count() if total is None else total
    within, counts, below = {i: F.lit(True) for i in range(len(ranks))}, {i: total for i in range(len(ranks))}, {i: 0 for i in range(len(ranks))}
    while wide := [i for i in within if counts[i] > FEW]:
        brackets = {}
        for i in wide:
            part = keys.where(within[i])
            sample = part.sample(fraction=min(1.0, SAMPLE / counts[i]), seed=i).orderBy(*ordering(sort)).limit(2 * SAMPLE).collect()
            place, margin = (ranks[i] - below[i]) / counts[i] * len(sample), 4 * math.sqrt(len(sample)) / 2 + 1
            low, high = int(place - margin), int(place + margin) + 1
            brackets[i] = (sample[low] if 0 <= low < len(sample) else None, sample[high] if 0 <= high < len(sample) else None)
        sides = []
        for i, (low, high) in brackets.items():
            under = within[i] & (~after(sort, low, types) if low is not None else F.lit(False))
            upto = within[i] & (~after(sort, high, types) if high is not None else F.lit(True))
            sides += [F.count_if(under).alias(f"u{i}"), F.count_if(upto).alias(f"h{i}")]
        row = keys.agg(*sides).first()
        for i, (low, high) in brackets.items():
            rank = ranks[i] - below[i]
            under, upto = row[f"u{i}"], row[f"h{i}"]
            if under < rank <= upto:  # the usual case; else the rank lies on one side of the bracket
                piece, counts[i], more = _between(sort, low, high, types), upto - under, under
            elif rank <= under:
                piece, counts[i], more = _between(sort, None, low, types), under, 0
            else:
                piece, counts[i], more = _between(sort, high, None, types), counts[i] - upto, upto
            within[i], below[i] = within[i] & piece, below[i] + more
    picked = None
    for i in within:
        part = keys.where(within[i]).withColumn("_bracket", F.lit(i))
        picked = part if picked is None else picked.unionByName(part)
    number = F.row_number().over(Window.partitionBy("_bracket").orderBy(*ordering(sort)))  # FEW rows a bracket at most
    wanted = F.create_map(*[F.lit(x) for i, r in enumerate(ranks) for x in (i, r - below[i])])
    rows = picked.withColumn("_number", number).where(F.col("_number") == wanted[F.col("_bracket")]).collect()
    found = {r["_bracket"]: {c: r[c] for c in names} for r in rows}
    return [found[i] for i in range(len(ranks))]


def _between(sort: Sort, low: Any, high: Any, types: dict[str, str]) -> Column:
    above = F.lit(True) if low is None else after(sort, low, types)
    return above if high is None else above & ~after(sort, high, types)


def tile_column(df: DataFrame, sort: Sort, k: int, total: int) -> Column:
    """NTILE(k) over ``sort`` as a comparison with the last key of each tile but the last; the first ``total mod k`` tiles
    hold one row more, and with fewer rows than tiles each row is its own."""
    ends, end = [], 0
    for tile in range(1, k):
        end += total // k + (tile <= total % k)
        if 0 < end < total and (not ends or end > ends[-1]):
            ends.append(end)
    types = {f.name: f.dataType.simpleString() for f in df.select(*[c for c, _ in sort]).schema}
    tile = F.lit(1)
    for key in keys_at(df, sort, ends, total):
        tile = tile + after(sort, key, types).cast("int")
    return tile.cast("long")


def first_fraction(df: DataFrame, sort: Sort, fraction: float, minimum: int = 1) -> DataFrame:
    """T4: the first max(``minimum``, floor(rows * ``fraction``)) rows of ``sort``, as a filter on the last one's key."""
    total = df.count()
    take = max(minimum, math.floor(total * fraction))
    if take >= total:
        return df
    types = {f.name: f.dataType.simpleString() for f in df.select(*[c for c, _ in sort]).schema}
    return df.where(~after(sort, keys_at(df, sort, [take], total)[0], types))
