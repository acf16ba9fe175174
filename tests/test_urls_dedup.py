import random

import pytest
from helpers import one
from pyspark.sql import functions as F

import model
from trawl.functions import urls as U
from trawl.operators import dedup as D

NORMALIZE = [
    ("shop.test", None, "http://shop.test/"),
    ("//cdn.test/lib", "https://shop.test/x", "https://cdn.test/lib"),
    ("//cdn.test/lib", "http://shop.test/x", "http://cdn.test/lib"),
    ("item", "http://shop.test/list/", "http://shop.test/list/item"),
    ("../up", "http://shop.test/one/two/", "http://shop.test/one/up"),
    ("./same#part", "http://shop.test/one/two", "http://shop.test/one/same"),
    ("?q=9", "http://shop.test/one/two", "http://shop.test/one/?q=9"),
    ("#part", "http://shop.test/one?k=v", "http://shop.test/one?k=v"),
    ("HTTP://SHOP.Test:80//x//y", None, "http://shop.test/x/y"),
    ("https://pay.shop.test:443", None, "https://pay.shop.test/"),
    ("http://shop.test:8081/p?a#b", None, "http://shop.test:8081/p?a"),
    ("gopher://shop.test/f", None, ""),
    ("file:///srv/data", None, ""),
    ("javascript:go()", "http://shop.test/", ""),
    ("data:text/plain,x", None, ""),
    ("mailto:me@shop.test", "http://shop.test/", ""),
    ("shop.test:8081/p", None, ""),
    ("", "http://shop.test/", ""),
    ("http://:81/p", None, ""),
]


@pytest.mark.parametrize("u,base,expected", NORMALIZE)
def test_normalize_url(spark, u, base, expected):
    b = F.lit(base) if base else None
    assert one(spark, U.normalize_url(F.col("u"), b), u=u) == expected


def test_query_fix_keeps_base_path(spark):
    assert one(spark, U.normalize_url(F.col("u"), F.lit("http://a.com/d/p"), query_fix=True), u="?x=1") == "http://a.com/d/p?x=1"


@pytest.mark.parametrize("u", ["http://a.com/s.css", "http://a.com/I.PNG", "http://a.com/app.js?v=2", "http://a.com/v.mp4",
                               "http://a.com/f.zip", "http://a.com/f.woff2", "https://facebook.com/sharer/x",
                               "http://a.com/author/bob", "http://a.com/tag/x"])
def test_ignored_links(spark, u):
    assert one(spark, U.is_ignored_link(F.col("u")), u=u) is True


@pytest.mark.parametrize("u", ["http://a.com/r.pdf", "http://a.com/r.docx", "http://a.com/r.txt", "http://a.com/page",
                               "http://a.com/search?q=/tag/x"])
def test_not_ignored_links(spark, u):
    assert one(spark, U.is_ignored_link(F.col("u")), u=u) is False


def test_document_links(spark):
    assert one(spark, U.is_document_link(F.col("u")), u="http://a.com/R.PDF#p2") is True
    assert one(spark, U.is_document_link(F.col("u")), u="http://a.com/r.pdf.html") is False


def test_scope(spark):
    assert one(spark, U.in_scope(F.col("h"), F.lit("www.wiki.org")), h="en.wiki.org") is True
    assert one(spark, U.in_scope(F.col("h"), F.lit("wiki.org")), h="en.wiki.org") is False
    assert one(spark, U.in_scope(F.col("h"), F.lit("wiki.org")), h="www.wiki.org") is True


DEDUP_STREAMS = [
    ["https://a.com/p?sort=asc&id=1", "https://a.com/p?id=1&sort=asc"],
    ["https://a.com/p?id=1", "https://a.com/p?id=1&sort=asc", "https://a.com/p?id=2"],
    ["https://a.com/p?page=1", "https://a.com/p?page=2", "https://a.com/p?page=1&ref=x"],
    ["https://a.com/p", "https://a.com/p?id=5", "https://a.com/p"],
    ["https://a.com/p?id=5", "https://a.com/p"],
    ["https://a.com/p?", "https://a.com/p?x=1", "https://a.com/p?"],
    ["https://a.com/p?&", "https://a.com/p?x=1", "https://a.com/p"],
    ["https://a.com/p?flag", "https://a.com/p?flag&x=2", "https://a.com/p?x=2"],
    ["http://a.com/p", "https://a.com/p", "http://a.com/q?x=1", "https://a.com/q?x=1&y=2"],
]


def _run_spark(spark, urls, all_urls):
    df = spark.createDataFrame(list(enumerate(urls)), "seq long, url string")
    flags = {r.seq: r.duplicate for r in D.dedup_flags(df, all_urls=all_urls).collect()}
    return [not flags[i] for i in range(len(urls))]


@pytest.mark.parametrize("urls", DEDUP_STREAMS)
@pytest.mark.parametrize("all_urls", [False, True])
def test_dedup_equals_sequential_model(spark, urls, all_urls):
    assert _run_spark(spark, urls, all_urls) == model.accepted(urls, all_urls)


def test_dedup_random_streams(spark):
    rng = random.Random(7)
    bases = ["http://a.com/p", "https://a.com/p", "https://a.com/q", "http://b.org/"]
    qs = ["", "?", "?&", "?id=1", "?id=2", "?id=1&s=a", "?s=a&id=1", "?s=a", "?id=1&", "?&id=1"]
    rows, expected = [], []
    for sid in range(300):
        urls = [rng.choice(bases) + rng.choice(qs) for _ in range(rng.randint(1, 8))]
        urls = [u.replace("a.com", f"a{sid}.com").replace("b.org", f"b{sid}.org") for u in urls]
        rows.extend((sid * 100 + i, u) for i, u in enumerate(urls))
        expected.extend(model.accepted(urls))
    df = spark.createDataFrame(rows, "seq long, url string")
    flags = {r.seq: not r.duplicate for r in D.dedup_flags(df).collect()}
    assert [flags[s] for s, _ in rows] == expected
