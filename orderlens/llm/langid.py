"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm.common import cut, forget, python_ready

#: n-gram lengths and the number of hashed features (a power of two).
ORDERS, FEATURES = (1, 2, 3), 1 << 16

#: Languages of a block of the model at most, so that a matrix has 64 MB at most.
MAX_LANGS = 256

#: n-grams whose evidence counts in full; of longer texts the mean evidence of so many.
EVIDENCE = 64

#: Characters of a text that are hashed at a time.
STRETCH = 1 << 20

#: n-grams whose evidence is looked up at a time: 16 MB with MAX_LANGS languages.
LOOKUP = 1 << 14


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _features(text: str):
    """Hashed n-grams of the lower-cased letters, runs of other characters as one space; a stretch at a time."""
    tail = np.empty(0, np.uint64)
    for at in range(0, len(text), STRETCH):
        codes = np.frombuffer(text[at:at + STRETCH].lower().encode("utf-32-le"), "<u4")
        is_letter = _letters()[codes]
        if at == 0 and not is_letter.any() and len(text) <= STRETCH:
            return
        codes = np.where(is_letter, codes, 32).astype(np.uint64)
        codes = np.concatenate([tail if len(tail) else np.array([32], np.uint64), codes, *([np.array([32], np.uint64)] if at + STRETCH >= len(text) else [])])
        codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
        for n in ORDERS:
            if len(codes) < n:
                continue
            h = np.full(len(codes) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ codes[k:len(codes) - n + 1 + k]
            h *= np.uint64(0xD6E8FEB86659FD93)
            yield (h >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.int64)
        tail = codes[-(max(ORDERS) - 1):]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Model:
    """``langs``, sorted, a prior each, and their log probabilities: (feature, language) matrices of up to
    MAX_LANGS languages in turn, each made from the ``counts`` when asked for."""

    def __init__(self, langs: list[str], counts: DataFrame | None, smoothing: float):
        self.langs, self.counts, self.smoothing = langs, counts, smoothing
        self.prior = -np.log(max(len(langs), 1))

    def blocks(self):
        """(languages, matrix) of each block in turn; one of no languages when there are none."""
        for at in range(0, max(len(self.langs), 1), MAX_LANGS):
            langs = self.langs[at:at + MAX_LANGS]
            if not langs:
                yield [], np.empty((FEATURES, 0), np.float32)
                continue
            got = self.counts.where(F.col("lang").between(langs[0], langs[-1])).toArrow()
            table = np.full((FEATURES, len(langs)), self.smoothing)
            place = {x: i for i, x in enumerate(langs)}
            np.add.at(table, (got["feature"].to_numpy(), np.array([place[x] for x in got["lang"].to_pylist()])), got["n"].to_numpy())
            yield langs, np.log(table / table.sum(axis=0)).astype(np.float32)


def _best(text: str | None, langs: list[str], prior: float, matrix: np.ndarray) -> tuple[str, float, float]:
    """(language, its score, log of the summed exponentials of all scores); ("und", 0, inf) for a text without
    letters or no languages."""
    if not langs or not has_letter(text):
        return "und", 0.0, np.inf
    total, n = np.zeros(len(langs)), 0
    for h in _features(text):
        for at in range(0, len(h), LOOKUP):
            total += matrix[h[at:at + LOOKUP]].sum(axis=0, dtype=np.float64)
        n += len(h)
    score = prior + total * min(1.0, EVIDENCE / max(n, 1))
    best = int(score.argmax())
    return langs[best], float(score[best]), float(score[best] + np.log(np.exp(score - score[best]).sum()))


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> Model:
    """A model of all rows with a text and a language.  Each task sums its n-grams by language and
    feature before the shuffle; the driver gets one count per language and feature."""
    spark = rows.sparkSession
    python_ready(spark)

    def count(batches):
        forget()
        sums: dict[str, np.ndarray] = {}

        def flush():
            for lang, c in sums.items():
                f = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(f)), pa.array(f, pa.int64()), pa.array(c[f], pa.int64())], ["lang", "feature", "n"])
            sums.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                text = text.as_py()
                if not has_letter(text):
                    continue
                if lang not in sums:
                    if len(sums) >= MAX_LANGS:  # bounded memory whatever the labels are
                        yield from flush()
                    sums[lang] = np.zeros(FEATURES, np.int64)
                for h in _features(text):
                    sums[lang] += np.bincount(h, minlength=FEATURES)
        yield from flush()

    counts = (rows.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
              .where("text is not null and lang is not null").mapInArrow(count, "lang string, feature long, n long")
              .groupBy("lang", "feature").agg(F.sum("n").alias("n")))
    counts = cut(counts)
    langs = sorted(r.lang for r in counts.select("lang").distinct().toLocalIterator())
    return Model(langs, counts, smoothing)


def predict(rows: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``rows`` with lang_pred and score (0 to 1), from the text alone; clashing columns are replaced.
    A broadcast matrix has FEATURES * MAX_LANGS * 4 bytes at most.  With more languages, the rows pass the
    blocks in turn, written in between, and keep the best language and the sum so far."""
    spark: SparkSession = rows.sparkSession
    python_ready(spark)
    rows = rows.drop("lang_pred", "score")
    now = None
    for langs, matrix in model.blocks():
        shared = spark.sparkContext.broadcast((langs, model.prior, matrix))
        now = cut(now) if now is not None else rows.withColumns({"lang_pred": F.lit(None).cast("string"), "score": F.lit(None).cast("double"), "_sum": F.lit(None).cast("double")})
        names = now.columns

        def score(batches, shared=shared, names=names):
            forget()
            for batch in batches:
                old = zip(*(batch.column(names.index(c)).to_pylist() for c in ("lang_pred", "score", "_sum")))
                found = []
                for x, (lang, top, whole) in zip(batch.column(names.index(text_col)), old):
                    here = _best(x.as_py(), *shared.value)
                    if lang is not None and here[0] != "und":
                        here = (*(here[:2] if here[1] > top else (lang, top)), float(np.logaddexp(whole, here[2])))
                    found.append(here)
                columns = [batch.column(i) for i in range(len(names) - 3)]
                columns += [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names)

        now = now.mapInArrow(score, now.schema)
    return now.withColumn("score", F.exp(F.col("score") - F.col("_sum"))).drop("_sum")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The predicted language of each row of ``docs``: doc_id, held_out, lang_pred, score.

    Rows whose crc32(id as text) mod 3 is 1 are held out; the model learns from the text and non-null
    language of the others.  Predictions take the text only.  Null texts and texts without a letter
    are ``und`` with score 0, as are all when there is nothing to learn from.  Rows with a null id are
    neither held out nor learned from; repeated rows are predicted alike; other columns are ignored.
    """
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % 3
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold == 1, F.lit(False)).alias("held_out"), fold.alias("_fold"),
                       F.col(text_col).alias("text"), F.col(lang_col).alias("_lang"))
    model = train(rows.where(F.col("_fold") != 1), "text", "_lang")
    return predict(rows.select("doc_id", "held_out", "text"), model).drop("text")
