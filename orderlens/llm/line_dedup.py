"""Line dedup by a log-template tree of fixed depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import BROADCAST_ROWS, by_keys, cut, join_groups, shared_folder

#: Leading tokens that lead to a leaf, below the token count.
DEPTH = 3

#: Least share of a template's places that hold a fixed token, in percent.
SIMILARITY = 80

# Token separators inside a line, and a field: a token that holds a digit.
BLANKS, FIELD = r"[ \t\x0B\f\r]+", r"[^ \t\x0B\f\r]*[0-9][^ \t\x0B\f\r]*"
TOKEN = r"[^ \t\x0B\f\r]+"


def _normal(line: Column) -> Column:
    """A line's tokens, fields masked, one space apart.  Most lines are so already.  Lines with too few other tokens
    for a template keep their fields, behind a line break."""
    odd = F.rlike(line, F.lit(r"[0-9\t\x0B\f\r]")) | F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    masked = F.when(odd, F.trim(F.regexp_replace(F.regexp_replace(line, FIELD, "<*>"), BLANKS, " "))).otherwise(line)
    few = F.rlike(line, F.lit("[0-9]")) & (100 * F.regexp_count(line, F.lit(FIELD)) > (100 - SIMILARITY) * F.regexp_count(line, F.lit(TOKEN)))
    return F.when(few, F.concat(F.lit("\n"), F.trim(F.regexp_replace(line, BLANKS, " ")))).otherwise(masked)


def _lines(docs: DataFrame) -> DataFrame:
    """One row per line with a token: _id, _text (a hash), no (from 1), normal, leaf, line (hashes), tokens.
    Lines are made normal inside the exploded array, so once each.  Lines with too few tokens but fields are
    leaves of their own."""
    normal = F.transform(F.split("text", "\n"), _normal)
    lead = F.when(F.startswith("normal", F.lit("\n")), F.col("normal")).otherwise(F.substring_index("normal", " ", DEPTH))
    count = F.length("normal") - F.length(F.replace(F.col("normal"), F.lit(" "), F.lit(""))) + 1
    return (docs.select("_id", F.xxhash64("text").alias("_text"), F.posexplode(normal).alias("no", "normal"))
            .select("_id", "_text", (F.col("no") + 1).alias("no"), "normal", count.alias("tokens"))
            .where(F.col("normal") != "")
            .select("_id", "_text", "no", "normal", F.xxhash64("tokens", lead).alias("leaf"),
                    F.xxhash64("normal").alias("line"), "tokens"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its lines deduplicated across documents, and n_lines, n_dropped.

    A tree of fixed depth sorts the lines: by token count, then by the first DEPTH tokens, where a
    token that holds a digit is the variable field ``<*>``.  In a leaf, each other place of a line may be a variable
    field too: a template is the line with its fields and one more place masked, if at least SIMILARITY of the places
    stay fixed.  A line goes if a document with a smaller id has an equal line, fields masked, or one of a
    common template.  So the first document with a template keeps its lines, and documents that are added,
    copies or others, never bring a dropped line back.  Order and line breaks of what stays are untouched.

    Lines of which fewer than SIMILARITY of the tokens are without a digit, such as rows of numbers, must be
    equal in all tokens, digits too, and take no part in the tree.  Short lines (a template needs
    five tokens) go by equal tokens, whatever their length in characters.  Blank lines stay.  Null texts stay null,
    with no lines.  Documents with
    a null id neither lose lines nor make others lose them.  Rows of one id are one document: repeats
    of the same row lose the same lines.  An empty table gives no rows; other columns are kept, but
    for clashing ones (n_lines, n_dropped), which are replaced.

    Hashes of lines are shuffled, not lines; a line itself only where its leaf holds unlike lines of
    several documents, once for each unlike line, and then hashes of its templates.  Hot lines are
    summed inside map tasks and joined apart.
    """
    read = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    lines = cut(_lines(read).drop("normal"))
    unlike = cut(lines.groupBy("leaf", "line").agg(F.min("_id").alias("first"), F.max("_id").alias("last"), F.count(F.lit(1)).alias("n"), F.first("tokens").alias("tokens")))
    leaves = (unlike.groupBy("leaf").agg(F.count(F.lit(1)).alias("_n"), F.min("first").alias("_a"), F.max("last").alias("_z"))
              .where("_n > 1 and _a < _z").select("leaf"))
    mixed = cut(unlike.where((100 - SIMILARITY) * F.col("tokens") >= 100).join(leaves, "leaf", "left_semi").select("leaf", "line", "first"))
    stays = F.least("first", "earliest")  # a null is passed over
    repeated = cut(unlike.join(_earliest(read, mixed), ["leaf", "line"], "left").withColumn("stays", stays).where("stays < last")
                   .select("leaf", "line", "stays", "n"))
    drops = (join_groups(lines, repeated, ["leaf", "line"], "n").where(F.col("_id") > F.col("stays"))
             .groupBy("_id", "_text").agg(F.array_sort(F.collect_set("no")).alias("_drops")))
    drops = cut(drops)
    kept = docs.drop("n_lines", "n_dropped")
    many, dropped = drops.agg(F.count(F.lit(1)), F.sum(F.size("_drops"))).first()
    small = many <= BROADCAST_ROWS and (dropped or 0) <= 10 * BROADCAST_ROWS  # else both sides are shuffled
    out = kept.join(F.broadcast(drops) if small else drops, (kept[id_col] == drops["_id"]) & (F.xxhash64(kept[text_col]) == drops["_text"]), "left")
    all_lines = F.split(kept[text_col], "\n")
    return out.select(*[F.when(F.col("_drops").isNull(), kept[c]).otherwise(_without(all_lines, F.col("_drops"))).alias(c) if c == text_col else kept[c]
                        for c in kept.columns],
                      F.when(kept[text_col].isNull(), 0).otherwise(F.size(all_lines)).cast("long").alias("n_lines"),
                      F.coalesce(F.size("_drops"), F.lit(0)).cast("long").alias("n_dropped"))


def _earliest(read: DataFrame, mixed: DataFrame) -> DataFrame:
    """(leaf, line, earliest) of the ``mixed`` lines that share a template with another: the smallest id that has it.

    Lines that differ in one place are alike in one half, before or after it, so only lines that share a half
    with another line of their leaf make templates.  A template is known by its place and the XOR of the other
    places' token hashes, which takes one pass over a line for all its templates."""
    spark, path = read.sparkSession, shared_folder(read.sparkSession, "line-places")
    texts = by_keys(_lines(read).select("leaf", "line", "normal"), mixed.select("leaf", "line"), ["leaf", "line"])
    tokens = F.split("normal", " ")
    fixed = F.size(F.filter("tokens", lambda t: t != "<*>"))
    (texts.groupBy("leaf", "line").agg(F.first("normal").alias("normal")).join(mixed, ["leaf", "line"])
     .withColumn("tokens", tokens).where(100 * (fixed - 1) >= SIMILARITY * F.size("tokens"))
     .select("leaf", "line", "first", F.transform("tokens", lambda t, i: F.when(t != "<*>", F.xxhash64(i, t))).alias("places")).write.parquet(path))
    lines = spark.read.schema("leaf long, line long, first long, places array<long>").parquet(path)

    size, middle = F.size("places"), F.call_function("div", F.size("places") + DEPTH, F.lit(2)).cast("int")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.xxhash64(F.slice("places", DEPTH + 1, middle - DEPTH)).alias("hash")),
                    F.struct(F.lit(1).alias("side"), F.xxhash64(F.slice("places", middle + 1, size - middle)).alias("hash")))
    halves = lines.select("leaf", "line", F.explode(sides).alias("s")).select("leaf", "line", "s.side", "s.hash")
    common = cut(halves.groupBy("leaf", "side", "hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    near = cut(join_groups(halves, common, ["leaf", "side", "hash"], "_n").select("leaf", "line").distinct())

    none = F.lit(0).cast("long")
    rest = F.aggregate("places", none, lambda x, h: x.bitwiseXOR(F.coalesce(h, none)))
    other = F.filter(F.transform(F.slice("places", DEPTH + 1, size), lambda h, i: F.when(h.isNotNull(), F.xxhash64(i, F.col("rest").bitwiseXOR(h)))),
                     lambda v: v.isNotNull())
    made = cut(by_keys(lines, near, ["leaf", "line"]).withColumn("rest", rest).select("leaf", "line", "first", F.explode(other).alias("template")))
    shared = cut(made.groupBy("leaf", "template").agg(F.min("first").alias("earliest"), F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    return join_groups(made.drop("first"), shared, ["leaf", "template"], "_n").groupBy("leaf", "line").agg(F.min("earliest").alias("earliest"))


def _without(lines: Column, drops: Column) -> Column:
    """The lines but those numbered in ``drops`` (sorted, from 1), joined again: the runs between them in turn."""
    ends = F.concat(F.array(F.lit(0)), drops, F.array(F.size(lines) + 1))
    runs = F.transform(F.slice(ends, 1, F.size(ends) - 1),
                       lambda at, i: F.slice(lines, at + 1, F.element_at(ends, i + 2) - at - 1))
    return F.array_join(F.flatten(runs), "\n")
