"""Exact dedup: rows grouped by a 128-bit content hash, bytes compared inside the groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import cut, join_groups, by_keys


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty.  The row with the smallest (or
    ``keep="largest"``) id of a group stays.  Texts whose MD5 occurs once need no comparison; the
    others are grouped by the text itself, so that equal hashes of unlike texts part, and copies
    merge inside each map task before the shuffle: a group with a third of all rows sends one row
    per task.

    Null ids never stay beside others; in a group of null ids only, keep_id is null and one row
    stays.  Of repeated rows (same id and text) one is kept.  Other columns are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be smallest or largest")
    best = F.min if keep == "smallest" else F.max
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    read = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.unhex(F.md5(text)).alias("_md5"))
    rows = cut(read.select("_id", "_md5", F.unhex(F.sha2("_text", 256)).alias("_sha"))
               .groupBy("_id", "_md5", "_sha").agg(F.count(F.lit(1)).alias("_n")))
    hashes = rows.groupBy("_md5").agg(F.sum("_n").alias("_n"), F.first("_id").alias("_id"), F.first("_sha").alias("_sha"))
    shared = hashes.where("_n > 1").select("_md5")
    texts = (by_keys(read, shared, ["_md5"])
             .groupBy("_md5", "_text").agg(best("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    equal = cut(texts.groupBy("_md5", F.unhex(F.sha2("_text", 256)).alias("_sha"))
                .agg(F.count(F.lit(1)).alias("_texts"), F.first("keep_id").alias("keep_id"),
                     F.first("group_size").alias("group_size"))
                # unlike bytes with one MD5 and one SHA-256 would be merged below: stop instead
                .withColumn("group_size", F.when(F.col("_texts") == 1, F.col("group_size"))
                            .otherwise(F.raise_error(F.lit("two texts share MD5 and SHA-256")).cast("long")))
                .drop("_texts"))
    grouped = join_groups(rows, equal, ["_md5", "_sha"], "group_size")
    single = hashes.where("_n = 1").withColumn("keep_id", F.col("_id")).withColumn("group_size", F.lit(1).cast("long"))
    return (grouped.unionByName(single)
            .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
            .select(F.col("_id").alias(id_col), "keep_id", "group_size",
                    (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
                    F.lower(F.hex("_sha")).alias("text_sha256")))
