"""URL filters: a Bloom filter cascade holds the listed keys exactly over the corpus's key universe."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Listed keys of one cascade, at most; its filters then hold a few MB.
MAX_LISTED = 500_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url: the host follows the first ``://`` up to ``/``, ``?``, ``#`` or the
    end, A-Z lower-cased; the path goes on from there up to ``?``, ``#`` or the end.  Null, or no
    ``://``: both empty."""
    after = F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(after, r"^[^/?#]*(/[^?#]*)?", 1)
    return host, path


@dataclass
class Cascade:
    """``levels``: (bits, hashes, array of 64-bit words) of each Bloom filter, the first for the listed keys."""

    levels: list[tuple[int, int, list[int]]]

    def contains(self, key: Column) -> Column:
        """Whether ``key`` is listed; exact for each key of the universe it was built on.  A key that
        first fails an odd level is not listed, an even one is; a key that passes all is listed when
        their number is odd."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(_may_contain(key, i, self.levels[i]), out).otherwise(F.lit(i % 2 == 1))
        return out


def _positions(key: Column, level: int, bits: int, hashes: int) -> Column:
    """Bit positions of a key by double hashing, other ones on each level."""
    a, b = F.xxhash64(F.lit(2 * level), key), F.xxhash64(F.lit(2 * level + 1), key)
    return F.array(*[F.pmod(F.pmod(a, F.lit(bits)) + F.lit(i) * F.pmod(b, F.lit(bits)), F.lit(bits)) for i in range(hashes)])


def _may_contain(key: Column, level: int, f: tuple[int, int, list[int]]) -> Column:
    bits, hashes, words = f
    held = F.array(*[F.lit(w) for w in words]) if len(words) <= 64 else F.from_json(F.lit(str(words)), "array<bigint>")
    return F.forall(_positions(key, level, bits, hashes),
                    lambda p: F.getbit(F.element_at(held, (F.shiftright(p, 6) + 1).cast("int")), (p % 64).cast("int")) == 1)


def _bloom(keys: DataFrame, n: int, rate: float, level: int) -> tuple[int, int, list[int]]:
    """A filter of the n ``key`` rows whose false-positive rate is about ``rate``.  Its words are made
    by Spark; the driver gets bits / 64 numbers."""
    bits = max(64, 64 * math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64))
    hashes = min(24, max(1, round(bits / n * math.log(2))))
    found = (keys.select(F.explode(_positions(F.col("key"), level, bits, hashes)).alias("p"))
             .groupBy(F.shiftright("p", 6).alias("word"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("bits")).collect())
    words = [0] * (bits // 64)
    for r in found:
        words[r["word"]] = r["bits"]
    return bits, hashes, words


def build_cascade(listed: DataFrame, universe: DataFrame, max_listed: int = MAX_LISTED) -> Cascade:
    """The cascade of the ``key`` column of ``listed``, exact for every key of ``universe``.

    The first filter's rate is |listed| / |universe|, so that about as many false positives as
    listed keys are left for the second level, and half of each level passes to the next: bits
    grow with |listed| * log(|universe|) only.  The universe is scanned twice and never shuffled;
    only the first filter's false positives are.
    """
    listed = cut(listed.select("key").where("key is not null").distinct())
    n = listed.count()
    if n > max_listed:
        raise ValueError(f"{n} listed keys are more than max_listed={max_listed}, the bound on what the driver and each task hold")
    if n == 0:
        return Cascade([])
    # an estimate: it sets a size only, exactness doesn't hang on it
    around = universe.agg(F.approx_count_distinct("key", 0.05)).first()[0]
    levels = [_bloom(listed, n, min(0.5, n / max(around, 1)), 0)]
    # a listed key may stand on a third of all pages: it is merged in each task before it is dealt out
    wrong = cut(universe.select("key").where(_may_contain(F.col("key"), 0, levels[0]))
                .distinct().join(listed, "key", "left_anti"))
    held, other = listed, wrong
    while (m := other.count()) > 0:
        k = len(levels)
        levels.append(_bloom(other, m, 0.5, k))
        held, other = other, cut(held.where(_may_contain(F.col("key"), k, levels[k])))
    return Cascade(levels)


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow", max_listed: int = MAX_LISTED) -> DataFrame:
    """A verdict for each row of ``pages`` (page_id, url): page_id, host, path, rule, verdict.

    ``rules`` (rule, verdict): a rule is ``host/`` or ``host/dir/.../`` with a lower-case host; it fits
    its host and all subdomains when the url's path starts with the rule's; the longest that fits
    wins, and urls that none fits get ``default``.  The keys of a url are its host's suffixes by
    label with its path's directories; those of all pages are the universe.  One cascade holds
    the rules that allow, one those that block, so no table is joined with the pages.  A url is
    cut into no more labels and directories than the longest rule has, which loses no match.

    Null urls, and those without ``://``, have empty host and path, no rule and ``default``.  Repeated
    rows are judged alike; other columns are ignored; no rules: ``default`` for all.  Very long urls are judged whole.
    More than ``max_listed`` rules of one verdict are an error: a cascade's bits, about 20 a listed key, pass through the
    driver to every task, so the caller states how many that may be.
    """
    both = cut(rules.select("rule", "verdict").where("rule is not null").distinct())
    bad = both.where(~F.endswith("rule", F.lit("/")) | ~F.col("verdict").isin("allow", "block")).count()
    twice = both.groupBy("rule").count().where("count > 1").count()
    if bad or twice:
        raise ValueError("a rule ends with /, allows or blocks, and stands once")
    labels, depth = both.agg(F.max(F.size(F.split(F.substring_index("rule", "/", 1), r"\."))),
                             F.max(F.size(F.split("rule", "/")) - 1)).first()
    host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    keys = urls.withColumn("_keys", _keys("host", "path", labels or 0, depth or 0))
    universe = keys.select(F.explode("_keys").alias("key"))
    made = {v: build_cascade(both.where(F.col("verdict") == v).select(F.col("rule").alias("key")), universe, max_listed)
            for v in ("allow", "block")}
    fits = F.transform("_keys", lambda k: F.when(made["allow"].contains(k), F.struct(F.length(k).alias("n"), k.alias("rule"), F.lit("allow").alias("verdict")))
                       .when(made["block"].contains(k), F.struct(F.length(k).alias("n"), k.alias("rule"), F.lit("block").alias("verdict"))))
    return (keys.withColumn("_best", F.array_max(fits))
            .select("page_id", "host", "path", F.col("_best.rule").alias("rule"),
                    F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict")))


def _keys(host: str, path: str, labels: int, depth: int) -> Column:
    """Host suffixes of at most ``labels`` labels, each with the path's directories of at most ``depth`` slashes."""
    suffixes = F.transform(F.sequence(F.lit(1), F.lit(max(labels, 1))), lambda i: F.call_function("substring_index", F.col(host), F.lit("."), -i))
    dirs = F.filter(F.transform(F.sequence(F.lit(1), F.lit(max(depth, 1))),
                                lambda i: F.concat(F.call_function("substring_index", F.col(path), F.lit("/"), i), F.lit("/"))),
                    lambda d: F.startswith(F.col(path), d))
    all_of = F.flatten(F.transform(F.array_distinct(suffixes), lambda s: F.transform(F.array_distinct(dirs), lambda d: F.concat(s, d))))
    return F.when((F.length(host) > 0) & (F.length(path) > 0), F.array_distinct(all_of)).otherwise(F.array().cast("array<string>"))
