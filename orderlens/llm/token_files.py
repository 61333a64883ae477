"""Token-id files: fixed-width bit packing in blocks with offsets."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderlens.llm.common import forget, python_ready
from orderlens.llm.tokens import encoder

# A row of <path>/blocks: whole documents of one part in order.  ``first`` counts the part's ids before it.
BLOCK = "part int, block int, first long, n_ids long, width int, doc_ids array<long>, lengths array<long>, packed binary"
# A row of <path>/parts: ``before`` counts the ids of all earlier parts.
PART = "part int, before long"


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """Ids as ``width`` bits each, lowest bit first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(packed: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a packed block; only their bytes are touched."""
    if width in (8, 16, 32):
        return np.frombuffer(packed, f"<u{width // 8}", stop - start, start * width // 8).astype("<u4")
    lead = start * width % 8
    raw = np.frombuffer(packed, np.uint8, (stop * width + 7) // 8 - start * width // 8, start * width // 8)
    bits = np.unpackbits(raw, bitorder="little")[lead:lead + (stop - start) * width].reshape(-1, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


def write_token_files(docs: DataFrame, path: str, tokenizer: str, spaces: str | None = None, end_id: int = 0,
                      block_ids: int = 65_536, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of each row's text, and ``end_id`` after it, in ascending id order under ``path``.

    Rows are range-partitioned by id (and a hash of the text, so that one id's many rows part),
    encoded in order, and packed with the fewest bits that hold the vocabulary.  A block closes
    after the document that brings it to ``block_ids`` ids.  Files are Spark's Parquet files, so any
    store that Spark can write does.  Null texts count as empty; null ids come first; rows of one id
    come in the order of the text's hash; other columns are ignored; an empty table gives no blocks.
    """
    spark = docs.sparkSession
    python_ready(spark)
    end = int(end_id).to_bytes(4, "little")

    def blocks(batches):
        enc, part = encoder(tokenizer, spaces), TaskContext.get().partitionId()
        width = max(1, (enc.vocabulary() - 1).bit_length())
        state = {"block": 0, "first": 0, "n": 0, "docs": [], "lengths": [], "data": []}

        def close():
            ids = np.frombuffer(b"".join(state["data"]), "<u4")
            row = {"part": [part], "block": [state["block"]], "first": [state["first"]], "n_ids": [len(ids)], "width": [width],
                   "doc_ids": [state["docs"]], "lengths": [state["lengths"]], "packed": [pack_bits(ids, width)]}
            state.update(block=state["block"] + 1, first=state["first"] + len(ids), n=0, docs=[], lengths=[], data=[])
            return pa.RecordBatch.from_pydict(row, schema)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = enc.ids(text.as_py() or "") + end
                state["docs"].append(doc)
                state["lengths"].append(len(data) // 4)
                state["data"].append(data)
                state["n"] += len(data) // 4
                if state["n"] >= block_ids:
                    yield close()
        if state["docs"]:
            yield close()

    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()),
                        ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("packed", pa.binary())])
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
     .repartitionByRange(*order).sortWithinPartitions(*order)
     .mapInArrow(blocks, BLOCK).write.parquet(f"{path}/blocks"))
    counts = spark.read.schema(BLOCK).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task that wrote
    counts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")).write.parquet(f"{path}/parts")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with ``offset``, the number of ids of all files before them."""
    parts = spark.read.schema(PART).parquet(f"{path}/parts")
    return (spark.read.schema(BLOCK).parquet(f"{path}/blocks").join(F.broadcast(parts), "part")
            .withColumn("offset", F.col("before") + F.col("first")))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Each document in the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32
    (of its ids as little-endian 32-bit integers)."""
    python_ready(spark, 16)

    def documents(batches):
        forget()
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack_bits(r["packed"], r["width"], 0, r["n_ids"])
                stops = np.cumsum(r["lengths"])
                starts = stops - r["lengths"]
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, stops)]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(starts + r["offset"], pa.int64()),
                                                  pa.array(r["lengths"], pa.int64()), pa.array(crcs, pa.int64())],
                                                 ["doc_id", "start", "n_tokens", "ids_crc32"])

    return (_blocks(spark, path).select("offset", "n_ids", "width", "doc_ids", "lengths", "packed")
            .mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def read_ids(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """Random access: (position, id) of the ids from ``start`` up to ``stop``; blocks outside aren't read."""
    python_ready(spark, 16)

    def ids(batches):
        for batch in batches:
            for r in batch.to_pylist():
                a, b = max(0, start - r["offset"]), min(r["n_ids"], stop - r["offset"])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b) + r["offset"], pa.int64()),
                                                  pa.array(unpack_bits(r["packed"], r["width"], a, b).astype(np.int64))], ["position", "id"])

    return (_blocks(spark, path).where((F.col("offset") < stop) & (F.col("offset") + F.col("n_ids") > start))
            .select("offset", "n_ids", "width", "packed").mapInArrow(ids, "position long, id long"))
