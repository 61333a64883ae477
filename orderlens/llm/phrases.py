"""Phrase collocation mining: which word sequences occur together more often than their parts do.

Each task counts its texts in a HAT-trie, a shallow trie of word ids over burstable hash containers, and spills whole
subtrees as sorted runs, compressed, once it holds too many paths.  Runs meet by prefix partition, where the counts of equal phrases
are summed, one part of about PART_BYTES of text at a time; what recurs less than the threshold goes there.  Scores and containment then work on the
phrases left, whose parts occur at least as often and so are all there.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import cut, join_groups
from orderlens.llm.hat_trie import AHEAD, END, PART_BYTES, HatTrie, merged
from orderlens.session import ship_package

#: ASCII capitals become small letters, the marks that part pieces line ends, tabs spaces.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c for c in range(256))

#: Ways in which a language's phrases are dealt before its first ones are chosen.
_DEALT = 64


#: Bytes of text that a task adds at once, about.
_CHUNK = 1 << 18


_BREAK = re.compile(rb"[ \n]")


def _stretches(text: bytes, depth: int):
    """Stretches of the text with ends between pieces; where a piece is cut, the next words follow, marked as ahead, and come again."""
    text, at, ends = text.translate(_NORMAL), 0, b" " + (END + b" ") * (depth - 1)
    following = re.compile(rb"(?: ++[^ \n]++){0,%d}+" % (depth - 1))
    while at < len(text):
        cut = _BREAK.search(text, at + _CHUNK)
        end = cut.start() if cut else len(text)
        stretch = text[at:end].replace(b"\n", ends)
        ahead = following.match(text, end).group().split()
        if ahead:
            stretch += b" ".join([b"", *ahead, *[END] * (depth - 1 - len(ahead)), AHEAD])
        else:
            stretch += ends
        yield stretch
        at = end


def _runs(depth: int, parts: int):
    def count(batches):
        trie = HatTrie(depth, parts)
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text")):
                for stretch in _stretches((text.as_py() or "").encode("utf-8", "replace"), depth):
                    trie.add(lang.as_py(), stretch)
                    if trie.full():
                        yield from trie.spill()
        yield from trie.spill()
    return count


def phrase_counts(docs: DataFrame, max_words: int, min_count: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, phrase (words joined by a space; empty: all words of the language) and its occurrences f, at least ``min_count``
    for phrases of words."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    runs = rows.mapInArrow(_runs(max_words, size // PART_BYTES + 16), "part long, lang string, phrases binary, counts binary")
    dealt = runs.repartition("part").sortWithinPartitions("part", "lang")
    return dealt.mapInArrow(lambda batches: merged(batches, min_count), "lang string, phrase string, f long")


def _wide(c: Column) -> Column:
    return c.cast("decimal(15,0)")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact in 38 digits."""
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * _wide(a) * _wide(a), _wide(left) * _wide(right))


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, inside_percent: int = 50, top: int = 2000,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per language the first ``top`` phrases of 2 to ``max_words`` words: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased in A-Z, parted into pieces at ``. , ; : ! ?`` and line ends, and those into
    words at spaces and tabs.  a counts the phrase, n all words of the language.  A phrase is scored by its
    weakest cut into two parts of l and r occurrences, floor(10**6 * a * a / (l * r)), ties to the
    shortest first part.  Phrases inside a longer one with ``inside_percent`` % of their occurrences
    go.  Rank is by score and a descending, then phrase in byte order.

    Null languages are ``und``, null and empty texts have no words.  Copies and repeated rows count each.
    Very long texts and pieces are counted whole, in bounded memory.  An empty table gives no rows; other columns
    are ignored.  Counts up to 10**15 are exact.
    """
    counts = cut(phrase_counts(docs, max_words, min_count, text_col, lang_col))
    words = F.split("phrase", " ")
    phrases = counts.where("phrase <> ''")
    found = phrases.withColumn("w", words).where(F.size("w") > 1)
    found = found.select("lang", "phrase", "w", F.col("f").alias("a"))

    ends = F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.array(
        F.struct(k.alias("k"), F.lit(0).alias("side"), F.array_join(F.slice("w", 1, k), " ").alias("part")),
        F.struct(k.alias("k"), F.lit(1).alias("side"), F.array_join(F.slice("w", k + 1, F.size("w")), " ").alias("part"))))))
    parts = found.select("lang", F.col("phrase").alias("of"), "a", ends.alias("e")).select("lang", "of", "a", "e.*")
    uses = parts.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("uses"))
    sizes = cut(uses.join(phrases.withColumnRenamed("phrase", "part"), ["lang", "part"]))
    met = join_groups(parts, sizes, ["lang", "part"], "uses")
    sides = met.groupBy("lang", "of", "a").agg(F.sort_array(F.collect_list(F.struct("k", "side", "f"))).alias("s"))
    cuts = F.transform(F.sequence(F.lit(0), F.size("s") - 1, F.lit(2)), lambda i: F.struct(
        _score(F.col("a"), F.col("s")[i]["f"], F.col("s")[i + 1]["f"]).alias("score"), F.col("s")[i]["k"].alias("k"),
        F.col("s")[i]["f"].alias("l"), F.col("s")[i + 1]["f"].alias("r")))
    scored = sides.select("lang", F.col("of").alias("phrase"), "a", F.array_min(cuts).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")

    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " ")))))
    around = (found.where(F.size("w") > 2).select("lang", inner.alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    kept = scored.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a")))

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    some = (kept.withColumn("dealt", F.pmod(F.xxhash64("phrase"), F.lit(_DEALT)))
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "dealt").orderBy(*order))).where(F.col("rank") <= top))
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
