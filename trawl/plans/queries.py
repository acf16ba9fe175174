"""The registered query catalogue: one DataFrame job per operator key, each over whole tables
(or views Spark derives from them).  Keyword choices and limits are fixed per key so that the
same job can be re-run against its DuckDB statement in :mod:`trawl.oracle_sql`."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.functions import html as H
from trawl.functions import sql_functions as SF
from trawl.functions import text as T
from trawl.functions import urls as U
from trawl.operators import crawl as CR
from trawl.operators import dedup as D
from trawl.operators import fetch as FE
from trawl.operators import graph as GR
from trawl.operators import grep as G
from trawl.operators import rendered as RE
from trawl.operators import scope as SC
from trawl.operators import stats as S
from trawl.plans import report as R
from trawl.plans import search as P
from trawl.session import ROCKSDB, ensure_checkpoint_dir
from trawl.sources import files as FS
from trawl.sources import fixtures as FX
from trawl.sources import tables as TB
from trawl.streaming import jobs as ST

# Fixed query parameters shared with the oracle statements.
KW_CI = "elle"
KW_DEFAULT = "ete"
KW_EXACT = "That"
KW_FUZZY = "hten"
KW_FUZZY_WORDS = "elephnt"
KW_LINES_FUZZY = "thingtion"
KW_TOTALS = "that the"
KW_PAGES = "the"
KW_SNIPPETS_FUZZY = "thatthe"
KW_SNIPPET = "elle"
FETCH_LIMIT = FX.FETCH_SIZE_LIMIT
MAX_HITS = 100
FOLDER_MAX_BYTES = 20000
MAX_BYTES = 10 * 1024 * 1024
MAX_PAGES = 25
BFS_DEPTH = 3
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
STREAM_WINDOW = "1 hour"
CRAWL_DEPTH = 3
CRAWL_HITS = 250
CRAWL_BYTES = 16 * 1024
LIMITED_PAGES = 9
LIMITED_HITS = 120
SCOPE_HOST_REGEX = r"\.example\.(com|net)$"


def _docs(spark, sf):
    return TB.documents(spark, sf)


def _pages(spark, sf):
    return TB.pages(spark, sf)


def _long(*names):
    return [F.col(n).cast("long").alias(n) for n in names]


# --- text scalar functions -------------------------------------------------------------------

def count_exact(spark, sf):
    d = G.with_computed(_docs(spark, sf), ["doc_id"], count=T.count_exact("text", KW_EXACT))
    return d.filter("count > 0").select("doc_id", *_long("count"))


def count_ci(spark, sf):
    d = G.with_computed(_docs(spark, sf), ["doc_id"], count=T.count_ci("text", KW_CI))
    return d.filter("count > 0").select("doc_id", *_long("count"))


def count_default(spark, sf):
    d = G.with_computed(_docs(spark, sf), ["doc_id"], count=T.count_default("text", KW_DEFAULT))
    return d.filter("count > 0").select("doc_id", *_long("count"))


def count_fuzzy(spark, sf):
    d = G.with_computed(_docs(spark, sf), ["doc_id"], count=T.count_fuzzy("text", KW_FUZZY))
    return d.filter("count > 0").select("doc_id", *_long("count"))


def fuzzy_words(spark, sf):
    d = G.with_computed(_docs(spark, sf), ["doc_id"], count=T.fuzzy_word_hits("text", KW_FUZZY_WORDS))
    return d.filter("count > 0").select("doc_id", *_long("count"))


def fold_strict(spark, sf):
    return _docs(spark, sf).select("doc_id", T.fold_strict("text").alias("folded"))


def fold_spaces(spark, sf):
    return _docs(spark, sf).select("doc_id", T.fold_spaces("text").alias("folded"))


def format_duration(spark, sf):
    return _docs(spark, sf).select("doc_id", T.format_duration(F.col("n_chars")).alias("label"))


# --- line / page grep ------------------------------------------------------------------------

def _lines_out(df, ids):
    return df.select(*ids, *_long("page", "line", "count"), "snippet")


def grep_lines(spark, sf):
    return _lines_out(G.grep_lines(_docs(spark, sf), KW_CI, "default"), ["doc_id"])


def grep_lines_exact(spark, sf):
    return _lines_out(G.grep_lines(_docs(spark, sf), KW_EXACT, "exact"), ["doc_id"])


def grep_lines_fuzzy(spark, sf):
    return _lines_out(G.grep_lines(_docs(spark, sf), KW_LINES_FUZZY, "fuzzy"), ["doc_id"])


def grep_paged(spark, sf):
    return _lines_out(G.grep_lines(FX.fx_paged(spark, sf), KW_CI, "default", id_cols=("doc_group",)), ["doc_group"])


def grep_crlf(spark, sf):
    return _lines_out(G.grep_lines(FX.fx_crlf(spark, sf), KW_CI, "default"), ["doc_id"])


def grep_conversations(spark, sf):
    c = TB.conversations(spark, sf)
    out = G.grep_lines(c, KW_CI, "default", id_cols=("conv_id", "turn"))
    return out.select("conv_id", "turn", *_long("page", "line", "count"), "snippet")


def grep_files(spark, sf):
    lines = G.grep_lines(_docs(spark, sf), KW_DEFAULT, "default")
    return G.grep_files(lines).select("doc_id", *_long("total_matches", "matching_lines"), "has_pages")


def file_totals(spark, sf):
    d = G.doc_counts(_docs(spark, sf), KW_TOTALS, "default")
    return d.select("doc_id", F.col("count").cast("long").alias("total_matches"))


def multi_keyword_grep(spark, sf):
    out = G.multi_keyword_grep(_docs(spark, sf), FX.KEYWORDS)
    return out.select("doc_id", "keyword", "mode", *_long("page", "line", "count"), "snippet")


def keyword_table_grep(spark, sf):
    out = G.keyword_table_grep(FX.fx_noted(spark, sf), FX.fx_keywords(spark, sf))
    return out.select("doc_id", "keyword", "mode", *_long("page", "line", "count"), "snippet")


def max_hits_cut(spark, sf):
    lines = G.grep_lines(_docs(spark, sf), KW_CI, "default")
    per_doc = G.grep_files(lines).select("doc_id", "total_matches")
    return S.max_hits_cut(per_doc, ["doc_id"], "total_matches", MAX_HITS).select("doc_id", *_long("total_matches"))


def running_matches(spark, sf):
    lines = G.grep_lines(_docs(spark, sf), KW_CI, "default")
    per_doc = G.grep_files(lines).select("doc_id", "total_matches")
    r = S.running_sum(per_doc, ["doc_id"], "total_matches", out_col="running", inclusive=True)
    return r.select("doc_id", *_long("total_matches", "running"))


def folder_stats(spark, sf):
    d = _docs(spark, sf).select(F.col("doc_id").alias("path"), F.octet_length("text").cast("long").alias("length"), "text")
    within = d.filter(F.col("length") <= FOLDER_MAX_BYTES)
    lines = G.grep_lines(within, KW_CI, "default", id_cols=("path",))
    per = G.grep_files(lines, ("path",))
    return S.folder_stats(d, per, FOLDER_MAX_BYTES)


# --- snippets (checked against a sequential model in the tests) -------------------------------

def _snip(spark, sf, kw, mode):
    d = _docs(spark, sf)
    counted = G.with_computed(d, ["doc_id", "text"], count=T.count_matches("text", kw, mode)).filter("count > 0")
    snippets = T.find_snippets(F.col("text"), kw, mode, 3)
    return counted.select("doc_id", *_long("count"), F.array_join(snippets, "\n").alias("snippets"))


def snippets_default(spark, sf):
    return _snip(spark, sf, KW_DEFAULT, "default")


def snippets_exact(spark, sf):
    return _snip(spark, sf, KW_EXACT, "exact")


def snippets_fuzzy(spark, sf):
    return _snip(spark, sf, KW_SNIPPETS_FUZZY, "fuzzy")


def build_snippet(spark, sf):
    """The excerpt of every case-sensitive hit of every text."""
    flat = G.with_computed(_docs(spark, sf), ["doc_id"], flat=T.flatten_whitespace(F.col("text")))
    snippets = G.with_computed(flat, ["doc_id"], snippets=T.literal_snippets(F.col("flat"), KW_SNIPPET))
    return snippets.select("doc_id", F.posexplode("snippets").alias("hit", "snippet")).select("doc_id", *_long("hit"), "snippet")


# --- pages ------------------------------------------------------------------------------------

def page_text(spark, sf):
    return FX.fx_html(spark, sf).select("page_id", H.page_text(F.col("html")).alias("text"))


def page_title(spark, sf):
    return FX.fx_html(spark, sf).select("page_id", H.page_title(F.col("html")).alias("title"))


def grep_pages(spark, sf):
    out = P.grep_pages(_pages(spark, sf), KW_PAGES, "default", with_snippets=False)
    return out.select("page_id", "url", *_long("count"))


def grep_pages_ranked(spark, sf):
    out = P.grep_pages(_pages(spark, sf), KW_PAGES, "default")
    ranked = S.global_rank(out.withColumn("_neg", F.negative("count")), ["_neg", "url", "page_id"])
    return ranked.select(*_long("rank"), "page_id", "url", *_long("count"), F.array_join("snippets", "\n").alias("snippets"), _more())


def _more():
    return F.greatest(F.col("count") - F.size("snippets"), F.lit(0)).cast("long").alias("more")


def grep_pages_snippets(spark, sf):
    out = P.grep_pages(_pages(spark, sf), KW_PAGES, "default", with_snippets=True)
    return out.select("page_id", "url", *_long("count"), F.array_join("snippets", "\n").alias("snippets"), _more())


def url_totals(spark, sf):
    out = P.grep_pages(_pages(spark, sf), KW_PAGES, "default", with_snippets=False)
    return out.groupBy(U.normalize_url(F.col("url")).alias("url")).agg(F.sum("count").cast("long").alias("count"))


def page_meta(spark, sf):
    h = FX.fx_html(spark, sf)
    return h.select("page_id", H.meta_description(F.col("html")).alias("description"), H.meta_keywords(F.col("html")).alias("keywords"))


def spa_pages(spark, sf):
    return FX.fx_html(spark, sf).select("page_id", H.is_spa(F.col("html")).alias("is_spa"))


def anchor_rules(spark, sf):
    h = FX.fx_html(spark, sf)
    tags = h.select("page_id", F.posexplode(H.anchor_tags(F.col("html"))).alias("pos", "tag"))
    x = tags.select("page_id", F.col("pos").cast("long").alias("pos"), H.tag_href("tag").alias("href"),
                    H.is_download("tag").alias("is_download"))
    return x.filter(H.is_followed(F.col("href")))


def main_content_text(spark, sf):
    return FX.fx_html(spark, sf).select("page_id", H.main_content_text(F.col("html")).alias("text"))


def extract_links_fallback(spark, sf):
    """Links of pages without anchors: the anchors of every page are turned into other elements first."""
    h = FX.fx_html(spark, sf).withColumn("html", F.regexp_replace("html", r"(?i)<a(?=\s)", "<area"))
    base = U.normalize_url(F.col("url"))
    x = h.select("page_id", F.posexplode(H.extract_links(F.col("html"), base)).alias("pos", "link"))
    return x.select("page_id", F.col("pos").cast("long").alias("pos"), "link")


def extract_links(spark, sf):
    p = FX.fx_html(spark, sf)
    base = U.normalize_url(F.col("url"))
    x = p.select("page_id", F.posexplode(H.extract_links(F.col("html"), base)).alias("pos", "link"))
    return x.select("page_id", F.col("pos").cast("long").alias("pos"), "link")


def link_graph(spark, sf):
    g = GR.page_links(_pages(spark, sf))
    return g.select("src", F.col("pos").cast("long").alias("pos"), "dst", "kind")


def host_rollup(spark, sf):
    g = GR.page_links(_pages(spark, sf))
    return g.groupBy(U.url_host(F.col("dst")).alias("host")).agg(
        F.count(F.lit(1)).cast("long").alias("links"), F.count_distinct("src").cast("long").alias("pages")
    )


def dangling_links(spark, sf):
    g = GR.page_links(_pages(spark, sf))
    known = _pages(spark, sf).select(U.normalize_url(F.col("url")).alias("dst"))
    return g.join(known, "dst", "left_anti").select("src", F.col("pos").cast("long").alias("pos"), "dst")


def normalize_url(spark, sf):
    return _pages(spark, sf).select("page_id", U.normalize_url(F.col("url")).alias("normalized"))


def resolve_links(spark, sf):
    h = FX.fx_hrefs(spark, sf)
    return h.select("page_id", "href", U.normalize_url(F.col("href"), F.col("url")).alias("resolved"))


def classify_links(spark, sf):
    l = FX.fx_links(spark, sf)
    return l.select("page_id", F.col("pos").cast("long").alias("pos"), "href",
                    U.is_document_link(F.col("href")).alias("is_doc"), U.is_ignored_link(F.col("href")).alias("is_ignored"))


def site_scope(spark, sf):
    """Pages in the scope of seeds from a table: the first page of every host, and its ``www.`` form for odd hosts."""
    p = _pages(spark, sf).select("page_id", U.url_host(U.normalize_url(F.col("url"))).alias("host"))
    bare = U.scope_root(F.col("host"))
    seeds = p.groupBy("host").agg(F.min("page_id").alias("seed_id")).select(
        "seed_id", F.when(F.col("seed_id") % 2 == 1, F.concat(F.lit("www."), bare)).otherwise(F.col("host")).alias("seed_host"))
    return SC.in_scope_of(p, seeds).select("page_id", "host", "seed_id", "seed_host")


# --- dedup --------------------------------------------------------------------------------------

def dedup_exact(spark, sf):
    return D.dedup_flags(FX.fx_urls(spark, sf), all_urls=True).select(*_long("seq"), "url", "duplicate")


def dedup_smart(spark, sf):
    return D.smart_dedup(FX.fx_urls(spark, sf)).select(*_long("seq"), "url")


def dedup_all_urls(spark, sf):
    return D.smart_dedup(FX.fx_urls(spark, sf), all_urls=True).select(*_long("seq"), "url")


def dedup_size(spark, sf):
    u = FX.fx_urls(spark, sf)
    smart = D.dedup_size(u).select(F.lit("smart").alias("mode"), "accepted")
    allu = D.dedup_size(u, all_urls=True).select(F.lit("all_urls").alias("mode"), "accepted")
    return smart.unionByName(allu)


# --- fetch log ----------------------------------------------------------------------------------

def _outcomes(spark, sf):
    return FE.fetch_outcomes(FX.fx_fetch_log(spark, sf), FETCH_LIMIT)


def fetch_outcomes(spark, sf):
    return _outcomes(spark, sf).select("page_id", "outcome", "category", "reason")


def size_gate(spark, sf):
    f = FX.fx_fetch_log(spark, sf)
    return f.select("page_id", FE.over_size(F.col("content_length"), F.col("body"), FETCH_LIMIT).alias("skipped"))


def route_content(spark, sf):
    return FX.fx_fetch_log(spark, sf).select("page_id", FE.route_content(F.col("content_type")).alias("kind"))


def bot_challenge(spark, sf):
    f = FX.fx_fetch_log(spark, sf)
    return f.filter(H.is_challenge(F.col("body"))).select("page_id", "url")


def error_counts(spark, sf):
    return FE.error_counts(_outcomes(spark, sf)).select("category", "count")


def error_reasons(spark, sf):
    return FE.error_reasons(_outcomes(spark, sf))


def blocked_by_reason(spark, sf):
    b = FE.blocked_by_reason(_outcomes(spark, sf))
    return b.select("reason", "count", "more", F.array_join("urls", " ").alias("first_urls"))


def crawl_stats(spark, sf):
    return FE.crawl_stats(_outcomes(spark, sf)).select("pages_visited", "pages_parsed", "docs_parsed", "html_pages", "pages_blocked")


def dedup_redirects(spark, sf):
    return FE.redirect_duplicates(FX.fx_fetch_log(spark, sf)).select(*_long("page_id"))


def _first_url(pages):
    """The URL of the first page, as a scalar subquery."""
    return pages.agg(F.min_by("url", "page_id")).scalar()


def scope_redirect(spark, sf):
    return FE.scope_redirect(_outcomes(spark, sf), _first_url(_pages(spark, sf)))


def json_doc_links(spark, sf):
    j = FX.fx_json(spark, sf)
    x = j.select("page_id", F.posexplode(H.json_doc_links(F.col("body"), F.col("url_base"))).alias("pos", "link"))
    return x.select("page_id", F.col("pos").cast("long").alias("pos"), "link")


def merge_rendered(spark, sf):
    out = RE.merge_rendered(FX.fx_html(spark, sf), FX.fx_rendered(spark, sf))
    return out.select("page_id", "rendered", F.array_join("nav_links", " ").alias("nav_links"), F.array_join("doc_links", " ").alias("doc_links"), "text")


# --- traversal ------------------------------------------------------------------------------

def _node_hosts(spark, sf):
    return _pages(spark, sf).select(F.col("page_id").alias("node"), U.url_host(U.normalize_url(F.col("url"))).alias("host"))


def bfs_depth(spark, sf):
    e = FX.fx_edges(spark, sf)
    seeds = spark.range(1).select(F.lit(0).cast("long").alias("node"))
    out = GR.bfs_levels(e, seeds, BFS_DEPTH, doc_leaves=False)
    return out.select(*_long("node", "depth"))


def bfs_scoped(spark, sf):
    e = FX.fx_edges(spark, sf).join(_node_hosts(spark, sf).withColumnRenamed("node", "dst"), "dst")
    seeds = spark.range(1).select(F.lit(0).cast("long").alias("node"))
    out = GR.bfs_levels(e, seeds, BFS_DEPTH, doc_leaves=False, scope=F.col("host").rlike(SCOPE_HOST_REGEX))
    return out.select(*_long("node", "depth"))


def bfs_doc_leaves(spark, sf):
    e = FX.fx_edges(spark, sf)
    seeds = spark.range(1).select(F.lit(0).cast("long").alias("node"))
    out = GR.bfs_levels(e, seeds, 2, doc_leaves=True)
    return out.select(*_long("node", "depth"), "kind")


def _edge_urls(spark, sf):
    e = FX.fx_edges(spark, sf)
    urls = _pages(spark, sf).select(F.col("page_id"), U.normalize_url(F.col("url")).alias("u"))
    s = urls.select(F.col("page_id").alias("src"), F.col("u").alias("src_url"))
    d = urls.select(F.col("page_id").alias("dst"), F.col("u").alias("dst_url"))
    x = e.join(s, "src").join(d, "dst")
    dst = F.when(F.col("kind") == "doc", F.concat(F.col("dst_url"), F.lit("/file.pdf"))).otherwise(F.col("dst_url"))
    return x.select(F.col("src_url").alias("src"), "pos", dst.alias("dst"), "kind")


def bfs_rank(spark, sf):
    links = _edge_urls(spark, sf)
    out = GR.crawl_frontier(links, _first_url(_pages(spark, sf)), depth=3, allow_external=True)
    return out.select(*_long("rank"), "url", *_long("depth"), "kind")


def max_pages_cut(spark, sf):
    links = _edge_urls(spark, sf)
    out = GR.crawl_frontier(links, _first_url(_pages(spark, sf)), depth=5, max_pages=MAX_PAGES, allow_external=True)
    return out.select(*_long("rank"), "url", *_long("depth"))


def crawl_grep(spark, sf):
    site = FX.fx_site(spark, sf)
    out = P.crawl_grep(site, _first_url(site), KW_PAGES, "default", depth=2)
    return out.select(*_long("rank"), "url", *_long("depth", "count"), F.array_join("snippets", "\n").alias("snippets"))


def _crawl_log(spark, sf, **limits):
    ensure_checkpoint_dir(spark)
    log = FX.fx_crawl_log(spark, sf).checkpoint()  # stands for a stored log
    seeds = log.filter(F.col("page_id") % FX.SITE == 0).select(F.col("site").cast("long").alias("crawl"), "url")
    return CR.crawl_log(log, seeds, KW_PAGES, "default", CRAWL_DEPTH, max_bytes=CRAWL_BYTES, **limits)


def crawl_fetch_log(spark, sf):
    """One crawl per site over the fetch log, stopped by matches only."""
    units = _crawl_log(spark, sf, max_hits=CRAWL_HITS)
    return units.select("crawl", "rank", *_long("depth"), "url", "final_url", "outcome", "reason", "count")


def crawl_fetch_log_limits(spark, sf):
    """The same crawls under a page limit and a smaller limit of matches."""
    units = _crawl_log(spark, sf, max_pages=LIMITED_PAGES, max_hits=LIMITED_HITS)
    return units.select("crawl", "rank", *_long("depth"), "url", "final_url", "outcome", "reason", "count")


def crawl_log_totals(spark, sf):
    """Statistics of every crawl, with the limit that stopped it."""
    return CR.crawl_totals(_crawl_log(spark, sf, max_pages=LIMITED_PAGES, max_hits=LIMITED_HITS), LIMITED_HITS)


# --- reports --------------------------------------------------------------------------------

def _doc_paths(spark, sf):
    return _docs(spark, sf).select(F.format_string("doc-%08d.txt", "doc_id").alias("path"), F.octet_length("text").cast("long").alias("length"), "text")


def _folder_lines(spark, sf):
    """Line matches of the documents within the size limit, as files of a folder, and the run's statistics."""
    d = _doc_paths(spark, sf)
    lines = G.grep_lines(d.filter(F.col("length") <= FOLDER_MAX_BYTES), KW_CI, "default", id_cols=("path",))
    return lines, S.folder_stats(d, G.grep_files(lines, ("path",)), FOLDER_MAX_BYTES)


def report_json_file(spark, sf):
    """The JSON report of every document as a searched file."""
    lines = G.grep_lines(_doc_paths(spark, sf), KW_CI, "default", id_cols=("path",))
    return R.file_json(lines, F.col("path"), KW_CI, "default").select("path", "section", *R.KEYS, "line")


def report_text_file(spark, sf):
    d = _doc_paths(spark, sf)
    lines = G.grep_lines(d, KW_CI, "default", id_cols=("path",))
    return R.file_text(lines, d).select("path", "section", *R.KEYS, "line")


def report_json_folder(spark, sf):
    lines, stats = _folder_lines(spark, sf)
    return R.folder_json(lines, stats, "documents", KW_CI, "default")


def report_text_folder(spark, sf):
    lines, stats = _folder_lines(spark, sf)
    return R.folder_text(lines, stats, "documents")


def _crawl(spark, sf):
    """(results, outcomes, blocked) of the fetch log: hits are found in the stage that scans the bodies, summed per
    final URL, and narrow rows are joined."""
    ensure_checkpoint_dir(spark)
    o = _outcomes(spark, sf).checkpoint()
    hits = FE.page_hits(FX.fx_fetch_log(spark, sf), KW_PAGES, "default", FETCH_LIMIT)
    final = U.normalize_url(F.col("final_url"))
    ok = o.filter("outcome = 'ok'").select("page_id", F.when(final != "", final).otherwise(F.col("final_url")).alias("url"))
    results = ok.join(hits, "page_id").groupBy("url").agg(
        F.min("page_id").alias("seq"), F.sum("count").cast("long").alias("count"), F.min_by("snippets", "page_id").alias("snippets"))
    where = F.when(F.col("outcome") == "challenge", F.when(final != "", final).otherwise(F.col("final_url"))).otherwise(F.col("url"))
    blocked = o.filter(F.col("outcome").isin("blocked", "challenge")).select(F.col("page_id").alias("seq"), where.alias("url"), "reason")
    return results.checkpoint(), o, blocked


def report_json_crawl(spark, sf):
    results, o, blocked = _crawl(spark, sf)
    return R.crawl_json(results, o, blocked, "fetch_log", 1, KW_PAGES, "default")


def report_text(spark, sf):
    results, o, _ = _crawl(spark, sf)
    return R.crawl_text(results, o, FE.blocked_by_reason(o))


# --- files (one per document, written by Spark, then scanned as a folder) ----------------------

def _from_folder(spark, sf, job):
    return _from_folder_of(spark, _docs(spark, sf), job)


def _from_folder_of(spark, docs, job, folders=FS.FOLDERS):
    """``job`` over a folder with one file per document; the result is cut into the checkpoint folder and the files are
    removed."""
    folder = f"{ensure_checkpoint_dir(spark)}/trawl-docs-{uuid.uuid4().hex}"
    docs = docs.select(F.format_string("doc-%d", "doc_id").alias("name"), F.concat("text", F.lit("\n")).alias("text"))
    FS.write_texts(docs, folder, folders)
    try:
        return job(folder).checkpoint()
    finally:
        FS.remove_folder(spark, folder)


def _doc_id():
    return F.regexp_extract("path", r"/doc-(-?\d+)-\d+[.]txt$", 1).cast("long").alias("doc_id")


def folder_scan(spark, sf):
    def job(folder):
        _, per_file, _ = P.scan_folder(spark, folder, KW_CI, "default", max_bytes=MAX_BYTES)
        return per_file.select(_doc_id(), *_long("total_matches", "matching_lines"))

    return _from_folder(spark, sf, job)


def file_scan(spark, sf):
    """Line matches of every file of the folder."""
    def job(folder):
        files = FS.read_files(spark, folder)
        lines = G.grep_lines(files, KW_PAGES, "default", id_cols=("path",))
        return lines.select(_doc_id(), *_long("page", "line", "count"), "snippet")

    return _from_folder(spark, sf, job)


def folder_scan_stopped(spark, sf):
    """The files that a folder search lists before it stops at a limit of matches, in the order of their paths."""
    def job(folder):
        _, per_file, stats = P.scan_folder(spark, folder, KW_CI, "default", max_bytes=MAX_BYTES, max_hits=MAX_HITS, first_bytes=1 << 18)
        numbers = stats.select(*_long("files_scanned", "stopped_early"))
        return per_file.select(_doc_id(), *_long("total_matches")).join(F.broadcast(numbers))  # one row

    ordered = _docs(spark, sf).withColumn("doc_id", F.col("doc_id") + 100_000_000)  # ids of one length sort as paths do
    return _from_folder_of(spark, ordered, job, folders=1).withColumn("doc_id", F.col("doc_id") - 100_000_000)


def sql_grep_lines(spark, sf):
    """Line matches through SQL alone."""
    SF.register(spark)
    _docs(spark, sf).createOrReplaceTempView("trawl_documents")
    return spark.sql(f"""SELECT doc_id, CAST(m.page AS BIGINT) AS page, CAST(m.line AS BIGINT) AS line, CAST(m.count AS BIGINT) AS count, m.snippet
FROM (SELECT doc_id, line_matches(text, '{KW_LINES_FUZZY}', 'fuzzy') AS found FROM trawl_documents) LATERAL VIEW explode(found) AS m""")


def decode_bytes(spark, sf):
    def job(folder):
        texts = FS.read_files(spark, folder)
        return texts.select(_doc_id(), F.length("text").cast("long").alias("chars"), F.col("length").alias("bytes"))

    return _from_folder(spark, sf, job)


# --- streams (three micro-batches, each a run of its own that goes on from the last one's checkpoint) --------------

def _streamed(spark, parts, job, mode="append", keys=None):
    """The table that ``job`` over a folder leaves after each of ``parts`` has arrived there and been processed."""
    place = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    sink = ST.BatchTable(spark, f"{place}/out")
    provider = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        for i, part in enumerate(parts):
            part.write.parquet(f"{place}/in/part-{i}")
            arriving = spark.readStream.schema(part.schema).option("recursiveFileLookup", "true").parquet(f"{place}/in")
            ST.run_available(job(arriving), sink, f"{place}/state", mode)
        return (sink.latest(keys) if keys else sink.read().drop("batch")).checkpoint()
    finally:
        spark.conf.set(STATE_STORE, provider)
        FS.remove_folder(spark, place)


def _thirds(df, order):
    """``df`` in three parts of about equal ranges of the number ``order``."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    step = ((high or 0) - (low or 0)) // 3 + 1
    # plain ranges, which a scan of stored files can use to leave out row groups
    return [df.filter(F.col(order).between((low or 0) + i * step, (low or 0) + (i + 1) * step - 1)) for i in range(3)]


def stream_grep(spark, sf):
    """Line matches of documents that arrive in three batches."""
    parts = _thirds(_docs(spark, sf).select("doc_id", "text"), "doc_id")
    return _streamed(spark, parts, lambda s: _lines_out(G.grep_lines(s, KW_CI, "default"), ["doc_id"]))


def stream_url_dedup(spark, sf):
    """Smart URL dedup of a stream: every URL with whether it is new."""
    return _streamed(spark, _thirds(FX.fx_urls(spark, sf), "seq"), lambda s: ST.stream_dedup(s))


def stream_totals(spark, sf):
    """Keyword totals per event-time window of a stream, documents a minute apart."""
    timed = _docs(spark, sf).select("doc_id", "text", F.timestamp_seconds(F.col("doc_id") * 60).alias("at"))
    def job(s):
        return ST.stream_window_totals(s, FX.KEYWORDS, "at", STREAM_WINDOW, "5 minutes")
    out = _streamed(spark, _thirds(timed, "doc_id"), job, "update", ["window_start", "keyword", "mode"])
    return out.select(F.unix_seconds("window_start").alias("window_start"), "keyword", "mode", "total_matches", "matching_lines")


QUERIES = {
    name: fn
    for name, fn in list(globals().items())
    if callable(fn) and not name.startswith("_") and getattr(fn, "__module__", None) == __name__
}
