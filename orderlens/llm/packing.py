"""Best-fit packing of token pieces into sequences: best-two-fit."""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orderlens.llm.common import cut, forget, python_ready
from orderlens.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Pieces that one task packs; groups are dealt evenly, whatever the keys.
GROUP = 50_000


def token_pieces(docs: DataFrame, tokenizer: str, spaces: str | None = None, limit: int = 2048, end_id: int = 0,
                 id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of each row of ``docs``: doc_id, piece, start, length, ids_crc32 (and the ids as
    little-endian 32-bit bytes on demand).

    A document is its text's ids and ``end_id``; only one of more than ``limit`` ids is cut, into
    pieces of ``limit`` and a last one.  Null texts count as empty (one piece: ``end_id``).  Repeated
    rows give repeated pieces; null ids stay null; other columns are ignored.
    """
    python_ready(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def pieces(batches):
        of = encoder(tokenizer, spaces).ids
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = of(text.as_py() or "") + end
                for k in range(0, len(data) // 4, limit):
                    part = data[4 * k:4 * (k + limit)]
                    for column, value in zip(out, (doc, k // limit, k, len(part) // 4, zlib.crc32(part), part)):
                        column.append(value)
            columns = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(columns[:5 + with_ids], names[:5 + with_ids])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(pieces, PIECES + (", ids binary" if with_ids else "")))


def best_two_fit(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length.  A bin takes the longest unpacked piece, then the longest that
    fits its gap, until none does; then its shortest piece gives way to the two unpacked ones that
    together fill the gap it leaves best, if they are longer than it."""
    stock: dict[int, list[int]] = {}
    for i, n in enumerate(lengths.tolist()):
        stock.setdefault(n, []).append(i)
    sizes = sorted(stock)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)

    def take(n: int) -> int:
        i = stock[n].pop()
        if not stock[n]:
            del sizes[bisect_right(sizes, n) - 1]
        return i

    def put_back(n: int, i: int) -> None:
        if not stock[n]:
            sizes.insert(bisect_right(sizes, n), n)
        stock[n].append(i)

    number = 0
    while sizes:
        held: list[tuple[int, int]] = []
        gap = limit
        while gap and (at := bisect_right(sizes, gap)):
            n = sizes[at - 1]
            held.append((n, take(n)))
            gap -= n
        if gap and len(held) > 1:
            least, piece = held[-1]
            room = gap + least
            if (pair := _best_pair(sizes, stock, room)) and sum(pair) > least:
                held.pop()
                a = take(pair[0])
                b = take(pair[1])
                held += [(pair[0], a), (pair[1], b)]
                put_back(least, piece)
        at = 0
        for n, i in held:
            bins[i], offsets[i] = number, at
            at += n
        number += 1
    return bins, offsets


def _best_pair(sizes: list[int], stock: dict[int, list[int]], room: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum up to ``room``."""
    here = np.array(sizes[:bisect_right(sizes, room - 1)], np.int64)
    if not len(here):
        return None
    mate = np.searchsorted(here, room - here, "right") - 1
    single = np.array([len(stock[n]) == 1 for n in here.tolist()])
    mate = np.where((mate == np.arange(len(here))) & single, mate - 1, mate)
    total = np.where(mate >= 0, here + here[mate], 0)
    best = int(total.argmax())
    return (int(here[best]), int(here[mate[best]])) if total[best] else None


def pack(pieces: DataFrame, limit: int = 2048, group: int = GROUP) -> DataFrame:
    """``pieces`` (at least ``length``) with sequence_id and offset, as few sequences as best-two-fit
    finds among each group of about ``group`` pieces.

    Pieces are dealt to groups by their place in the written table, not by a key, so no group grows
    with repeated rows, sources or lengths; a group wastes part of its last sequences only, a few in
    thousands.  Sequence ids are unique, not gapless; offsets run from 0 without gaps.  An empty
    table gives no rows; other columns are kept, and clashing ones (sequence_id, offset) replaced.
    """
    python_ready(pieces.sparkSession)
    pieces = cut(pieces.drop("sequence_id", "offset"))
    groups = max(1, math.ceil(pieces.count() / group))
    schema = StructType(pieces.schema.fields).add("sequence_id", "long").add("offset", "long")

    def fill(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        forget()
        rows = rows.drop_columns(["_group"])
        bins, offsets = best_two_fit(rows["length"].to_numpy(), limit)
        bins += key[0].as_py() << 32
        return rows.append_column("sequence_id", pa.array(bins)).append_column("offset", pa.array(offsets))

    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(fill, schema)
