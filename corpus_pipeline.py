"""From documents to packed training sequences, in five stages of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each one's result
as Parquet into the shared folder and reads it again for the next.  All but the last return the columns of
their input.  Language ID has no SQL form, so the pipeline is tested against a plain version instead.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm import jaccard, langid, line_dedup, mixing, packing
from orderlens.llm.common import by_keys, cut, join_groups, shared_folder, table, words

#: Least probability of the predicted language.
MIN_SCORE = 0.5

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without letters, or unsure of one by MIN_SCORE, go.  The
    model learns from all texts with a language label; predictions take the text only.  Where no
    row has a label there is no model to reject by, and texts with a letter stay."""
    names = docs.columns
    model = langid.train(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows = docs.select(F.struct(*names).alias("_row"), F.col("text").alias("_text"))
    kept = langid.predict(rows, model, "_text").where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in names])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that recur from documents before them; n_chars follows the text, and
    documents that lose all their words go."""
    names = docs.columns
    out = line_dedup.line_dedup(docs).where((F.col("n_dropped") == 0) | (words(F.col("text")) > 0))
    chars = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return out.select(*[chars.alias(c) if c == "n_chars" else F.col(c) for c in names])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by a Jaccard similarity of 0.8 of 5-word shingles: the one with the
    smallest id (null ids last), then the smallest hash of id and text, then of all columns.  Rows of one
    id with unlike texts are apart; rows with a null id are members too.  Rows without words stay."""
    rows = docs.withColumn("_row_hash", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))
    groups = cut(jaccard.jaccard_components(rows.select("_row_hash", "text"), k=5, percent=80, id_col="_row_hash").where("n_shingles > 0"))
    linked = cut(groups.groupBy(F.col("component_id").alias("_component")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    members = cut(join_groups(groups.select("_row_hash", F.col("component_id").alias("_component")), linked, ["_component"], "_n")
                  .select("_row_hash", "_component").distinct())
    ids = by_keys(rows.select("_row_hash", "doc_id"), members.select("_row_hash"), ["_row_hash"]).distinct()
    first = (members.join(ids, "_row_hash").groupBy("_component")
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "_row_hash")).alias("_first")).select("_first._row_hash"))
    out = by_keys(rows, cut(members.join(first, "_row_hash", "left_anti").select("_row_hash")), ["_row_hash"], "left_anti")
    repeated = cut(groups.groupBy("_row_hash").count().where("count > 1").select("_row_hash"))
    if repeated.limit(1).count():
        order = F.struct(F.xxhash64(*docs.columns).alias("_all"), F.struct(*docs.columns).alias("_kept"))
        once = by_keys(out, repeated, ["_row_hash"]).groupBy("_row_hash").agg(F.min(order).alias("_one")).select("_one._kept.*")
        out = by_keys(out, repeated, ["_row_hash"], "left_anti").select(*docs.columns).unionByName(once)
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources by code point weigh 3, 1, 2, repeating, share
    150 % of all words and give each document twice at most."""
    return mixing.emit(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, each with its sequence of at most 2048 ids and its offset there."""
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), "dropped")
    return packing.pack(pieces)


STAGES = [("language_id", language_id), ("line_dedup", drop_lines), ("ngram_jaccard", near_copies),
          ("source_mixing", mix_sources), ("best_fit_packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the whole of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = shared_folder(spark, name)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
