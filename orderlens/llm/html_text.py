"""HTML extraction: the article's text of every page, without the parts that a site repeats.

A site's template shows in what its pages share.  Each page gives 64-bit hashes of its element
subtrees (tags, texts and children, from the leaves up); Spark counts per host on how many unlike
pages each occurs, and subtrees that recur are deleted.  What a page's own marks (elements, roles, names of classes
and ids) set apart from its article goes too, so that menus or adverts of one page only are found as well.
"""

from __future__ import annotations

from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import BROADCAST_BYTES, BROADCAST_ROWS, by_keys, cut, join_groups
from orderlens.llm.page_parts import Page
from orderlens.session import ship_package

#: Unlike pages of a host that a subtree must occur on to count as template, and their least share: of
#: what lies outside an article, and of what may be in one.
MIN_PAGES, OFTEN, MOSTLY = 5, 0.01, 0.5


def host_of(url: Column) -> Column:
    """Lower-case host: between ``://`` and the next ``/``, ``?``, ``#`` or end; empty where there is none."""
    after = F.regexp_extract(url, r"^[^:]*(?::(?!//)[^:]*)*://([^/?#]*)", 1)
    return F.lower(F.coalesce(after, F.lit("")))


def _digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _subtrees(batches):
    for batch in batches:
        pages, subtrees = [], []
        for html in batch.column("html"):
            page = Page(html.as_py() or "")
            pages.append(_digest("\n".join(page.blocks())))
            subtrees.append(sorted(set(page.subtrees())))
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(pages, pa.int64()), pa.array(subtrees, pa.list_(pa.int64()))],
                                         ["host", "page", "subtrees"])


def _texts(batches):
    for batch in batches:
        out, removed = [], []
        for html, often, mostly in zip(*(batch.column(c) for c in ("html", "often", "mostly"))):
            page, often, mostly = Page(html.as_py() or ""), frozenset(often.as_py() or ()), frozenset(mostly.as_py() or ())
            out.append("\n".join(page.blocks(often, mostly)).encode("utf-8", "replace").decode())
            removed.append(sum(d in often for d in page.subtrees()))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64()),
                                          pa.array(removed, pa.int64())], ["key", "text", "n_chars", "n_template"])


def site_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per host: n (its unlike pages), often and mostly (digests of subtrees on OFTEN and MOSTLY of them, MIN_PAGES at least).

    Pages of one article text count once, so copies of a page make no template.  Rows are one per page and
    subtree, merged before each shuffle; the counts of (host, subtree, page) lie at their own keys, so that a
    host with a third of all pages is spread.  A host's lists hold at most 1 / OFTEN times a page's mean
    number of subtrees.  Pages without a host have no template.
    """
    ship_package(pages.sparkSession)
    read = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).where("host <> '' AND html IS NOT NULL")
    found = cut(read.mapInArrow(_subtrees, "host string, page long, subtrees array<long>").distinct())
    hosts = found.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_PAGES)
    counts = (found.select("host", "page", F.explode("subtrees").alias("subtree")).distinct()
              .groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= MIN_PAGES))
    shared = join_groups(cut(counts), cut(hosts), ["host"], "n").where(F.col("pages") >= F.col("n") * OFTEN)
    return (shared.groupBy("host", "n")
            .agg(F.collect_list("subtree").alias("often"), F.collect_list(F.when(F.col("pages") >= F.col("n") * MOSTLY, F.col("subtree"))).alias("mostly")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, text (the article's blocks joined by newlines), n_chars (its
    code points) and n_template (subtrees of the page that are the host's template).

    The article is the page's ``article`` elements (else ``main``, else what is named as one, else the
    body).  Subtrees on 1 % of a host's unlike pages (5 at least) go if they lie outside it, those on half
    of them go inside too, but prose of a declared article stays: paragraphs shared by many articles are text.

    Null and empty html give an empty text, so does a page without an article's text.  Null urls are
    kept and have no template.  Repeated rows are extracted each.  Whole pages are read, however long; unclosed and
    wrongly nested elements end where a browser ends them.  An empty table gives no rows; other columns are ignored.
    """
    ship_package(pages.sparkSession)
    templates = cut(site_templates(pages, url_col, html_col))
    rows = pages.select(F.struct(F.col(id_col).alias("id"), F.col(url_col).alias("url")).alias("key"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    held = templates.agg(F.sum(F.size("often") * 16 + F.octet_length("host") + 64).alias("bytes"), F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("pages")).first()
    if (held.bytes or 0) <= BROADCAST_BYTES:
        met = rows.join(F.broadcast(templates.drop("n")), "host", "left")
    else:  # hosts with most pages by broadcast, the others by shuffle
        limit = max(held.pages // (BROADCAST_ROWS // 100), MIN_PAGES)
        hot, cold = templates.where(F.col("n") > limit).drop("n"), templates.where(F.col("n") <= limit).drop("n")
        met = (rows.join(F.broadcast(hot), "host")
               .unionByName(by_keys(rows, hot.select("host"), ["host"], "left_anti").join(cold, "host", "left")))
    kinds = {f.name: f.dataType.simpleString() for f in pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).schema}
    out = met.select("key", "html", "often", "mostly").mapInArrow(
        _texts, f"key struct<id: {kinds['id']}, url: {kinds['url']}>, text string, n_chars long, n_template long")
    return out.select(F.col("key.id").alias(id_col), F.col("key.url").alias(url_col), "text", "n_chars", "n_template")
