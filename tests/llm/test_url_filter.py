import random

import pytest
from pyspark.sql import functions as F

from orderlens.llm.queries import URL_RULES
from orderlens.llm.url_filter import build_cascade, url_filter
from tests.llm import brute

URLS = [None, "", "no scheme", "http://", "://x.com/", "HTTP://WWW.Example.COM/en/a?b#c", "http://example.com", "http://example.com?x=/en/",
        "http://example.com/EN/a", "http://example.com/en", "http://example.com/en/", "http://a.b.c.example.com/en/x://y", "http://com/", "http://x.com.net/es/1",
        "http://net/es/", "http://net/es", "http://examplenet/es/", "http://ex.net/fr/\nline", "http://.com/x", "http://example.com:80/en/", "http://É.com/é",
        "http://www.example.com/en/7", "http://m.www.example.com/en/7", "http://" + "a." * 3000 + "com/" + "d/" * 3000, "http://x.com#/en/", "a://b://c.com/x"]


def test_against_plain_version(spark):
    r = random.Random(3)
    urls = URLS + ["http{}://{}{}/{}/{}".format(r.choice(["", "s"]), r.choice(["", "www.", "a.b.", "m."]), r.choice(["example.com", "x.net", "net", "example.org"]),
                                               r.choice(["en", "es", "fr"]), r.randint(1, 99)) for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash")).withColumn("key", F.lit(1))
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter(pages, rules).collect()}
    assert got == {i: brute.verdict(u, URL_RULES) for i, u in enumerate(urls)}


def test_cascade_is_exact(spark):
    """Several levels: a fifth of 20,000 keys is listed, and the first filter errs on many of the rest."""
    keys = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), (F.col("id") % 5 == 0).alias("is"))
    cascade = build_cascade(keys.where("is"), keys)
    assert len(cascade.levels) > 2
    assert keys.where(cascade.contains(F.col("key")) != F.col("is")).count() == 0
    assert sum(bits for bits, _, _ in cascade.levels) < 20_000 * 3


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    assert url_filter(pages, rules).count() == 0
    one = spark.createDataFrame([(1, "http://x.com/"), (1, "http://x.com/"), (None, "http://x.com/")], "page_id long, url string")
    assert [r.verdict for r in url_filter(one, rules.limit(0)).collect()] == ["allow"] * 3
    assert [r.rule for r in url_filter(one, rules).collect()] == ["com/"] * 3


def test_rules_are_checked(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    for bad in ([("com", "allow")], [("com/", "maybe")], [("com/", "allow"), ("com/", "block")]):
        with pytest.raises(ValueError):
            url_filter(pages, spark.createDataFrame(bad, "rule string, verdict string"))
