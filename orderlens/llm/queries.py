"""The subpackage's registered queries: name -> (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm.common import shared_folder, table
from orderlens.llm.exact_dedup import exact_dedup
from orderlens.llm.hilbert import hilbert_shards
from orderlens.llm.html_text import extract
from orderlens.llm.jaccard import jaccard_components
from orderlens.llm.langid import identify
from orderlens.llm.line_dedup import line_dedup
from orderlens.llm.merkle import folded, leaf_digest, merkle_manifest, proof
from orderlens.llm.mixing import mix
from orderlens.llm.packing import pack, token_pieces
from orderlens.llm.phrases import collocations
from orderlens.llm.token_files import read_documents, write_token_files
from orderlens.llm.topk import top_k
from orderlens.llm.url_filter import url_filter

#: The rules of op3, as its contract states them.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
             ("net/es/", "block"), ("net/fr/", "block")]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that recur, or whose template does, from documents before it."""
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best matches of each 50th embedding among all others, of any finite components."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url under the fixed rules; urls without a rule are allowed."""
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return url_filter(table(spark, sf_dir, "pages"), rules)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document when sources weigh 3, 1, 2 and share 150 % of all words."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under a Jaccard similarity of 0.9 of 3-word shingles."""
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and offset of every document's token pieces in sequences of 2048."""
    pieces = token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), "dropped")
    return pack(pieces)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return identify(table(spark, sf_dir, "documents"))


def op8_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document in 16 shards along a Hilbert curve."""
    return hilbert_shards(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over every document; the largest doc_id stays."""
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, length and checksum of every document's ids, read back from the packed files."""
    path = shared_folder(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), "kept")
    return read_documents(spark, path)


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of two and three words of each language."""
    return collocations(table(spark, sf_dir, "documents"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article text of every page."""
    return extract(table(spark, sf_dir, "pages"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document; documents whose id has an even crc32 lose their line ends
    before the proof is checked."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = leaf_digest([F.translate("text", "\n", "") if c == "text" else F.col(c) for c in fields])
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    out = merkle_manifest(table(spark, sf_dir, "documents"), fields, "source", "doc_id", {"tampered": F.when(even, tampered)})
    root = folded(F.col("path"), F.coalesce("tampered", "leaf"))
    return (out.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), root.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_exact_topk, op3_url_filters, op4_source_mixing, op5_ngram_jaccard, op6_best_fit_packing, op7_language_id,
                                 op8_hilbert_sharding, op9_exact_dedup, op10_token_files, op11_phrase_mining, op12_html_extraction, op13_merkle_manifest)}
