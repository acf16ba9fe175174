"""End-to-end searches mirroring the three inputs of the search tool: a folder, a file, and a
crawl — here over stored pages and their link graph instead of live HTTP."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions import html as H
from trawl.functions import text as T
from trawl.functions import urls as U
from trawl.operators import grep as G
from trawl.operators import graph as GR
from trawl.operators import stats as S
from trawl.sources import files as FS


#: Bytes of the first range of files that a search with a hit limit opens; every further range is four times as large.
FIRST_BYTES = 256 << 20


def _scan(listed: DataFrame, keyword: str, mode: str, max_bytes: int):
    """(texts, line matches, per-file results) of listed files, the texts cut."""
    texts = FS.read_listed(listed, max_bytes).checkpoint()
    lines = G.grep_lines(texts, keyword, mode, text_col="text", id_cols=("path",))
    return texts, lines, G.grep_files(lines, ("path",))


def scan_until(listed: DataFrame, keyword: str, mode: str, max_bytes: int, max_hits: int, first_bytes: int = FIRST_BYTES):
    """``_scan`` of a prefix of the files in the order of their paths: ranges of growing size are opened one after the other
    until the matches reach ``max_hits``.  The driver sees one number per range, and there are few: each is four times the
    last."""
    small = listed.filter(F.col("length") <= max_bytes)
    placed = S.running_sum(small, ["path"], "length", "_before").checkpoint()
    end = placed.agg(F.max("_before")).first()[0]
    found, total, low, size = None, 0, 0, first_bytes
    while end is not None and low <= end:
        part = placed.filter((F.col("_before") >= low) & (F.col("_before") < low + size)).select("path", "length")
        texts, lines, per_file = _scan(part, keyword, mode, max_bytes)
        per_file = per_file.checkpoint()
        found = (texts, lines, per_file) if found is None else tuple(a.unionByName(b) for a, b in zip(found, (texts, lines, per_file), strict=True))
        total += per_file.agg(F.sum("total_matches")).first()[0] or 0
        if total >= max_hits:
            break
        low, size = low + size, size * 4
    return found or _scan(small, keyword, mode, max_bytes)


def scan_folder(spark: SparkSession, folder: str, keyword: str, mode: str = "default",
                max_bytes: int = 10 * 1024 * 1024, max_hits: int = 0, first_bytes: int = FIRST_BYTES):
    """Returns (line matches, per-file results, one-row stats).

    With ``max_hits`` the scan stops after the file (in path order) whose matches bring the
    total to the limit: later files are neither reported nor counted as scanned or skipped,
    and the stats row carries ``stopped_early`` = the limit.  Files are opened in ranges, so those far behind
    that file are not read."""
    listed = FS.list_files(spark, folder)
    if max_hits > 0:
        texts, lines, per_file = scan_until(listed, keyword, mode, max_bytes, max_hits, first_bytes)
    else:
        texts, lines, per_file = _scan(listed, keyword, mode, max_bytes)
    failed = texts.filter(F.col("text").isNull()).select(F.col("path").alias("_failed_path"), F.lit(True).alias("_failed"))
    listed = listed.join(failed, F.col("path") == F.col("_failed_path"), "left").select("path", "length", F.coalesce("_failed", F.lit(False)).alias("failed"))
    stopped = 0
    if max_hits > 0:
        per_file = S.max_hits_cut(per_file, ["path"], "total_matches", max_hits)
        lines = lines.join(per_file.select("path"), "path", "left_semi")
        # one scalar to the driver: the path of the file that reached the limit, if any
        last = per_file.agg(F.max("path").alias("p"), F.sum("total_matches").alias("t")).first()
        if last is not None and last["t"] is not None and last["t"] >= max_hits:
            listed = listed.filter(F.col("path") <= F.lit(last["p"]))
            stopped = max_hits
    stats = S.folder_stats(listed, per_file, max_bytes, failed_col="failed").withColumn("stopped_early", F.lit(stopped))
    return lines, per_file, stats


def scan_file(spark: SparkSession, path: str, keyword: str, mode: str = "default", max_bytes: int = 10 * 1024 * 1024):
    text = FS.read_file(spark, path, max_bytes)
    return G.grep_lines(text, keyword, mode, text_col="text", id_cols=("path",))


def grep_pages(pages: DataFrame, keyword: str, mode: str = "default", with_snippets: bool = True,
               id_cols=("page_id", "url")) -> DataFrame:
    """Page text -> whole-page count -> up to 3 snippets for pages with matches."""
    ids = list(id_cols)
    t = G.with_computed(pages, ids, text=H.page_text(F.col("html")))
    counted = G.with_computed(t, [*ids, "text"], count=T.count_matches(F.col("text"), keyword, mode)).filter(F.col("count") > 0)
    if not with_snippets:
        return counted.drop("text")
    return counted.select(*ids, "count", T.find_snippets(F.col("text"), keyword, mode, T.PAGE_SNIPPETS).alias("snippets"))


def crawl_grep(pages: DataFrame | GR.PageStore, seed_url: str | Column, keyword: str, mode: str = "default", depth: int = 1,
               max_pages: int | None = None, allow_external: bool = False, all_urls: bool = False) -> DataFrame:
    """Breadth-first reach from ``seed_url`` over the stored pages' links, then page grep on the
    reached pages.  Returns (rank, url, depth, count, snippets).  ``pages`` is a table, or a store that serves many crawls."""
    store = pages if isinstance(pages, GR.PageStore) else GR.PageStore(pages)
    reached = GR.crawl_frontier(store.links_of, seed_url, depth, max_pages, allow_external, all_urls).checkpoint()
    found = store.of(reached.select(F.col("rank").alias("seq"), F.col("url").alias("src"), "depth"), reached.count() <= GR.BROADCAST_URLS)
    hits = grep_pages(found.withColumnRenamed("src", "url"), keyword, mode, id_cols=("seq", "url", "depth"))
    hits = hits.withColumnRenamed("seq", "rank").select("rank", "url", "depth", "count", "snippets")
    if store is pages:
        return hits
    hits = hits.checkpoint()
    store.remove()
    return hits
