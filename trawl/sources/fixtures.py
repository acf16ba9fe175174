"""Derived views over the driver tables, for shapes the tables lack (URL variants, link
classes, fetch outcomes, paged and CR/LF texts, detector markup, JSON payloads).

Every view is a deterministic function of a given table, so it grows with it; the same
definitions exist as DuckDB SQL in :mod:`trawl.oracle_sql`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions import html as H
from trawl.sources import tables

# Fixed fixture parameters (mirrored in the SQL definitions).
URL_VARIANTS = ("?id=1", "?id=1&sort=asc", "?sort=asc&id=1", "?id=2", "", "SWAP?id=1", "?", "?&")
LINK_SUFFIXES = ("", ".pdf", ".css", ".docx?v=2", ".PNG", "/tag/x", "#top", "?q=/tag/")
TEST_HREFS = (
    "/a/../b", "//cdn.example.org/x", "b", "?x=1", "HTTP://EX.example.com:80//a//b", "https://e.example.com:443",
    "javascript:void(0)", "mailto:a@b.c", "host.example.com:8080/x", "./c#f",
)
FETCH_SIZE_LIMIT = 8192
KEYWORDS = (("elle", "default"), ("ete", "default"), ("that the", "exact"), ("hten", "fuzzy"), ("C++", "default"))


def _base(url):
    return F.regexp_replace(url, "[?#].*$", "")


def _swap_scheme(u):
    return (
        F.when(u.startswith("https://"), F.concat(F.lit("http://"), F.expr("substring(_b, 9)")))
        .when(u.startswith("http://"), F.concat(F.lit("https://"), F.expr("substring(_b, 8)")))
        .otherwise(u)
    )


def fx_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.pages(spark, sf_dir).select("page_id", _base(F.col("url")).alias("_b"))
    p = p.withColumn("_sw", _swap_scheme(F.col("_b")))
    variants = F.array(
        *[
            F.struct(
                F.lit(v).alias("v"),
                (F.concat(F.col("_sw"), F.lit(s[4:])) if s.startswith("SWAP") else F.concat(F.col("_b"), F.lit(s))).alias("u"),
            )
            for v, s in enumerate(URL_VARIANTS)
        ]
    )
    x = p.select("page_id", F.inline(variants))
    return x.select(
        (F.col("page_id") * 8 + (F.col("v") * 5 + F.col("page_id")) % 8).alias("seq"), F.col("u").alias("url")
    )


def raw_hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.pages(spark, sf_dir)
    return p.select("page_id", F.posexplode(H.anchor_hrefs("html")).alias("pos", "href"))


def fx_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffixes = F.array(*[F.lit(s) for s in LINK_SUFFIXES])
    h = raw_hrefs(spark, sf_dir)
    return h.select(
        "page_id",
        F.col("pos").cast("int").alias("pos"),
        F.concat(F.col("href"), F.element_at(suffixes, ((F.col("page_id") + F.col("pos")) % 8 + 1).cast("int"))).alias(
            "href"
        ),
    )


def fx_hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    hrefs = F.array(*[F.lit(s) for s in TEST_HREFS])
    p = tables.pages(spark, sf_dir)
    return p.select("page_id", "url", F.element_at(hrefs, (F.col("page_id") % 10 + 1).cast("int")).alias("href"))


def fx_fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fetch per page, row-local: redirects to a landing page that pages of a host share, to the other
    scheme and to a fragment of the same page; blocked fetches that end on a foreign host; failures
    with and without a message; HTML fetches whose body was lost."""
    p = tables.pages(spark, sf_dir)
    i = F.col("page_id")
    m20, m10 = i % 20, i % 10
    base = p.withColumn("_b", _base(F.col("url")))
    origin = F.regexp_extract("_b", "^([a-zA-Z]+://[^/]*)", 1)
    final = (
        F.when(m20 == 0, F.concat(F.lit("https://blocked.example.org/"), i.cast("string")))
        .when(m10 == 4, F.concat(origin, F.lit("/landing")))
        .when(m10 == 6, _swap_scheme(F.col("_b")))
        .when(m10 == 8, F.concat("url", F.lit("#top")))
        .otherwise(F.col("url"))
    )
    status = (
        F.when(m20.isin(0, 3), 403).when(m20 == 7, 429).when(m20 == 11, 404).when(m20 == 13, 500)
        .when(m20.isin(15, 17, 19), None).otherwise(200)
    )
    html = F.when(
        i % 25 == 2, F.regexp_replace("html", "(?s)<title>.*?</title>", "<title>Just a moment...</title>")
    ).otherwise(F.col("html"))
    body = F.when(m20 == 9, F.lit(None)).otherwise(html)
    return base.select(
        "page_id", "url", final.alias("final_url"), status.cast("int").alias("status"),
        F.when(m20 == 17, F.lit("SocketTimeoutException")).when(m20 == 15, F.lit("EOFException")).when(m20 == 19, F.lit("IOException"))
        .alias("error_class"),
        F.when(m20 == 19, F.lit("stream closed\nat byte 7")).alias("error_message"),
        F.when(i % 6 == 5, F.lit("application/pdf")).otherwise(F.lit("text/html; charset=utf-8")).alias("content_type"),
        F.when(i % 9 == 0, F.lit(None)).otherwise(F.octet_length(body).cast("string")).alias("content_length"),
        body.alias("body"),
    )


def fx_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.documents(spark, sf_dir).select((F.col("doc_id") / 3).cast("long").alias("doc_group"), "doc_id", "text")
    g = d.groupBy("doc_group").agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("_t"))
    return g.select("doc_group", F.array_join(F.col("_t.text"), "\f").alias("text"))


def fx_crlf(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.documents(spark, sf_dir)
    m = F.col("doc_id") % 3
    text = F.when(m == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).when(m == 1, F.replace("text", F.lit("\n"), F.lit("\r"))).otherwise(
        F.col("text")
    )
    return d.select("doc_id", text.alias("text"))


HTML_INJECT = (
    ("<html", '<html ng-version="17.3.0"'),
    ("<body>", '<body><div id="root"></div>'),
    ("<body>", '<body><div data-reactroot="">Loading...</div>'),
    ("<body>", '<body><script id="__NEXT_DATA__" type="application/json">{}</script>'),
    ("</head>", '<script src="/static/app.js"></script></head>'),
    ("</head>", '<meta name="description" content="Notes &amp; reviews"><meta name="keywords" content="alpha, beta"></head>'),
    ("<body>", '<base href="/app/"><body><a download href="files/report.pdf">Report</a>'),
    (None, None),
    ("<body>", '<body><p title="a > b">caf&eacute; it&#8217;s &#x41;&amp;lt; &notin; &copy 2024 &unknown; 1 < 2</p>'),
    ("</article>", '</article><script type="a>b">var leaked = 1;'),
    ("<body>", '<body><a data-href="/wrong" href="/right">x</a><a title="q href=/no" href=\'/yes?a=1&amp;b\'>y</a>'),
    ("</head>", '<meta data-name="x" content="Second &mdash; order" name=description></head>'),
    ("<body>", '<body><p>open <!-- never closed <a href="/hidden">z</a>'),
    (None, None),
    ("<body>", '<body><div id="app"><div>one</div>two<div><div>three</div></div></div>'),
    ("<body>", '<body><DIV class="a" id=root><div><p>' + "nested words " * 12 + "</p></div><div>and more of them</div></DIV>"),
    ("<body>", '<body><main><main>inner</main>outer<mainly>x</mainly>'),
)


def fx_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.pages(spark, sf_dir)
    m = F.col("page_id") % len(HTML_INJECT)
    expr = F.col("html")
    out = None
    for i, (pat, rep) in enumerate(HTML_INJECT):
        if pat is None:
            continue
        rep_java = rep.replace("$", "\\$")
        branch = F.regexp_replace(expr, F.lit(pat), F.lit(rep_java))
        out = (F.when(m == i, branch) if out is None else out.when(m == i, branch))
    return p.select("page_id", "url", out.otherwise(expr).alias("html"))


def fx_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.pages(spark, sf_dir)
    i = F.col("page_id").cast("string")
    body = F.concat(
        F.lit('{"files":["/a/'), i, F.lit('.pdf","https://x.example.com/d/'), i, F.lit('/download","/p","//c.example.org/'), i,
        F.lit('.csv?v=1"]}'),
    )
    base = F.regexp_extract("url", r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    return p.select("page_id", "url", base.alias("url_base"), body.alias("body"))


def fx_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four edges a page, by arithmetic on its id: a well-connected graph on the pages."""
    p = tables.pages(spark, sf_dir)
    n = p.agg(F.count(F.lit(1))).scalar()
    ks = F.array(*[F.lit(k) for k in range(4)])
    e = p.select(F.col("page_id").alias("src"), F.posexplode(ks).alias("pos", "k"))
    dst = ((F.col("src") * 7 + F.col("k") * 13 + 1) % n).cast("long")
    return e.select("src", dst.alias("dst"), F.col("pos").cast("int").alias("pos"),
                    F.when(dst % 5 == 0, F.lit("doc")).otherwise(F.lit("nav")).alias("kind"))


def fx_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as one site whose links resolve: page n lies at ``/n`` and its HTML gains links to the pages
    that ``fx_edges`` names, as relative links, and to a document."""
    e = fx_edges(spark, sf_dir).groupBy("src").agg(
        F.array_sort(F.collect_list(F.struct("pos", "dst", "kind"))).alias("_e")
    )
    p = tables.pages(spark, sf_dir)
    links = F.transform("_e", lambda x: F.concat(F.lit('<a href="/'), x["dst"].cast("string"),
                                                 F.when(x["kind"] == "doc", F.lit(".pdf")).otherwise(F.lit("")), F.lit('">l</a>')))
    site = p.join(e, p["page_id"] == e["src"])
    return site.select("page_id", F.concat(F.lit("http://site.example.com/"), F.col("page_id").cast("string")).alias("url"),
                       F.replace("html", F.lit("<body>"), F.concat(F.lit("<body>"), F.array_join(links, ""))).alias("html"))


SITE = 32  # pages of a site in fx_crawl_log


def _site_url(t, scheme="http"):
    """URL of page ``t`` of a row's site.  Every third site has moved from its own host to another domain with subdomains;
    every fifth page of a site is a document."""
    at = F.col("site").cast("string")
    home = F.concat(F.lit("s"), at, F.lit(".example.com"))
    moved = F.concat(F.when(t % 2 == 1, F.lit("en.m")).otherwise(F.lit("www.m")), at, F.lit(".example.org"))
    host = F.when((F.col("site") % 3 == 1) & (t > 0), moved).otherwise(home)
    return F.concat(F.lit(f"{scheme}://"), host, F.lit("/"), t.cast("string"), F.when((t > 0) & (t % 5 == 0), F.lit(".pdf")).otherwise(F.lit("")))


def fx_crawl_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as fetches of sites of 32 pages, whose pages link to one another by arithmetic: with and without
    queries, over both schemes, to documents and out of the site.  Fetches fail, are blocked, end on another page of
    the site, on the other scheme or, for a moved site's first page, on another domain; bodies are lost or challenges."""
    p = tables.pages(spark, sf_dir).withColumn("site", F.floor(F.col("page_id") / SITE)).withColumn("j", F.col("page_id") % SITE)
    i, j = F.col("page_id"), F.col("j")

    def link(k):
        t = (j * 7 + k * 13 + 1) % SITE
        m = (j + k) % 4
        page = (t % 5 != 0) | (t == 0)
        suffix = F.when(page & (m == 1), F.lit("?id=1")).when(page & (m == 3), F.lit(f"?id=1&x={k}")).otherwise(F.lit(""))
        return F.concat(F.lit('<a href="'), F.when(m == 2, _site_url(t, "https")).otherwise(_site_url(t)), suffix, F.lit('">l</a>'))

    links = F.concat(*[link(k) for k in range(6)], F.lit('<a href="http://other.example.net/x">o</a>'))
    elsewhere = (j + 9) % SITE
    final = (
        F.when((j == 0) & (F.col("site") % 3 == 1), F.concat(F.lit("http://www.m"), F.col("site").cast("string"), F.lit(".example.org/home")))
        .when(j % 7 == 2, _site_url(elsewhere)).when(j % 19 == 4, _site_url(j, "https")).otherwise(_site_url(j))
    )
    html = F.replace("html", F.lit("<body>"), F.concat(F.lit("<body>"), links))
    html = F.when(i % 23 == 6, F.regexp_replace(html, "(?s)<title>.*?</title>", "<title>Just a moment...</title>")).otherwise(html)
    body = F.when(i % 29 != 9, html)
    timeout = i % 17 == 7
    return p.select(
        "page_id", "site", _site_url(j).alias("url"), final.alias("final_url"),
        F.when(i % 11 == 3, 404).when(i % 13 == 5, 403).when(~timeout, 200).cast("int").alias("status"),
        F.when(timeout, F.lit("SocketTimeoutException")).alias("error_class"), F.lit(None).cast("string").alias("error_message"),
        F.when((j > 0) & (j % 5 == 0), F.lit("application/pdf")).otherwise(F.lit("text/html")).alias("content_type"),
        F.octet_length(body).cast("string").alias("content_length"), body.alias("body"),
    )


def fx_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered snapshots of some of the client-rendered pages: text, navigation links and document links."""
    p = fx_html(spark, sf_dir).filter(H.is_spa("html") & (F.col("page_id") % 3 != 0))
    i = F.col("page_id").cast("string")
    return p.select("page_id", F.concat(F.lit("rendered text of "), i).alias("text"),
                    F.array(F.concat(F.lit("/r/"), i), F.lit("/s.css"), F.concat(F.lit("/r/"), i), F.lit("mailto:x@y.z")).alias("links"),
                    F.array(F.concat(F.lit("files/"), i, F.lit(".pdf"))).alias("doc_links"))


def fx_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyword table: the words of the benchmark items, one mode each, and two that only case folding makes equal."""
    words = tables.load(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"[\s.,]+")).alias("keyword"))
    distinct = words.filter(F.col("keyword") != "").union(spark.range(1).select(F.explode(F.array(F.lit("\u0130++"), F.lit("i++"))))).distinct()
    m = F.length("keyword") % 3
    return distinct.select("keyword", F.when(m == 0, F.lit("default")).when(m == 1, F.lit("exact")).otherwise(F.lit("fuzzy")).alias("mode"))


def fx_noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, some with a last line whose letter has a case form of its own."""
    m = F.col("doc_id") % 50
    note = F.when(m == 7, F.lit("\nan i++ loop")).when(m == 8, F.lit("\nan \u0130++ loop")).otherwise(F.lit(""))
    return tables.documents(spark, sf_dir).select("doc_id", F.concat("text", note).alias("text"))
