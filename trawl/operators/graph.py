"""Link graph and breadth-first traversal.

The traversal is level-synchronous: each level is one join of the frontier with the edges of its nodes, a
scope filter, an anti-join against what is already queued, and a checkpoint to the shared checkpoint
folder that cuts the lineage.  The number of driver iterations is the depth limit, never the data size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.functions import html as H
from trawl.functions import urls as U
from trawl.operators.dedup import query_tokens
from trawl.operators.shelf import BUCKETS, Shelf, bucket_of, in_buckets, sent
from trawl.operators.stats import global_rank
from trawl.session import ensure_checkpoint_dir


#: (parents (src, parent_rank), whether they are few) to their links (src, parent_rank, pos, dst, kind).
LinksOf = Callable[[DataFrame, bool], DataFrame]


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, pos, dst, kind) for every extracted link, ``kind`` in {doc, nav}."""
    base = U.normalize_url(F.col(url_col))
    x = pages.select(base.alias("src"), F.posexplode(H.extract_links(F.col(html_col), base)).alias("pos", "dst"))
    return x.select("src", F.col("pos").cast("int").alias("pos"), "dst",
                    F.when(U.is_document_link(F.col("dst")), F.lit("doc")).otherwise(F.lit("nav")).alias("kind"))


#: Links of one page that lie in one partition; a page with more is spread over as many as it needs.
HUB_LINKS = 100_000


def _salted(edges: DataFrame, hub_links: int) -> tuple[DataFrame, DataFrame]:
    """``edges`` with a salt per ``hub_links`` links of their page, and (src, salts) of the pages that have more than one."""
    hubs = edges.groupBy("src").count().filter(F.col("count") > hub_links).select("src", F.ceil(F.col("count") / hub_links).cast("int").alias("salts"))
    hubs = hubs.checkpoint()
    j = edges.join(sent(hubs), "src", "left")
    return j.withColumn("salt", F.pmod(F.xxhash64("dst"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts"), hubs


def bfs_levels(
    edges: DataFrame,
    seeds: DataFrame,
    depth: int,
    node_col: str = "node",
    doc_leaves: bool = True,
    scope=None,
    partitions: int | None = None,
    hub_links: int = HUB_LINKS,
) -> DataFrame:
    """Minimum depth of every node reachable from ``seeds`` (column ``node_col``).

    ``edges``: (src, dst, kind).  Nav edges are followed from nodes at depth < ``depth``; doc
    edges from any reached nav node (documents bypass the depth limit) and doc targets are
    leaves.  ``scope``: optional Column predicate on ``dst`` applied to every edge.
    Returns (node, depth, kind).

    The edges are partitioned once, by ``src`` and a salt; a page gets one salt per ``hub_links`` links it has, so a hub lies in
    as many partitions as it needs and every other page in one.  Each level shuffles the frontier only, once per salt.
    What is visited lies in files, one scan for all levels."""
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    e = edges.select("src", "dst", "kind")
    if scope is not None:
        e = e.filter(scope)
    if not doc_leaves:
        e = e.withColumn("kind", F.lit("nav"))
    e, hubs = _salted(e.checkpoint(), hub_links)
    e, hubs = e.repartition(n, "src", "salt").checkpoint(), sent(hubs)
    shelf = Shelf(spark)
    start = seeds.select(F.col(node_col).alias("node")).distinct()
    frontier = shelf.add("visited", start.select("node", F.lit(0).alias("depth"), F.lit("nav").alias("kind")))
    for level in range(depth + 1):
        step = frontier.filter(F.col("kind") == "nav").select(F.col("node").alias("src")).join(hubs, "src", "left")
        step = step.select("src", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")).join(e, ["src", "salt"])
        if level >= depth:
            step = step.filter(F.col("kind") == "doc")
        # kind as an int code so the per-node minimum is a hash aggregate (documents first)
        cand = step.groupBy(F.col("dst").alias("node")).agg(
            F.min(F.when(F.col("kind") == "doc", 0).otherwise(1)).alias("_k")
        ).select("node", F.when(F.col("_k") == 0, F.lit("doc")).otherwise(F.lit("nav")).alias("kind"))
        new = cand.join(shelf.read("visited"), "node", "left_anti").select("node", F.lit(level + 1).alias("depth"), "kind")
        frontier = shelf.add("visited", new)
        if frontier.isEmpty():
            break
    visited = shelf.read("visited").checkpoint()
    shelf.remove()
    return visited


#: A level of no more URLs than this is sent to every executor to find its pages; a larger one is shuffled.
BROADCAST_URLS = 100_000


def table_links(links: DataFrame) -> LinksOf:
    """Links of a frontier from a stored table (src, pos, dst, kind) over normalised URLs."""
    stored = links.select("src", "pos", "dst", "kind")
    return lambda parents, few: (F.broadcast(parents) if few else parents).join(stored, "src")


def stored_page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> LinksOf:
    """Links of a frontier from stored pages: only the pages of the frontier have their links extracted, and their
    HTML is not shuffled while the frontier is small."""
    keyed = pages.select(U.normalize_url(F.col(url_col)).alias("src"), F.col(html_col).alias("_html"))

    def links_of(parents: DataFrame, few: bool) -> DataFrame:
        found = (F.broadcast(parents) if few else parents).join(keyed, "src")
        x = found.select("src", "parent_rank", F.posexplode(H.extract_links("_html", F.col("src"))).alias("pos", "dst"))
        return x.withColumn("kind", F.when(U.is_document_link(F.col("dst")), F.lit("doc")).otherwise(F.lit("nav")))

    return links_of


class PageStore:
    """Stored pages by the hash of their normalised URL: written once, for any number of crawls.  A level of a crawl reads
    the files of its URLs' hash values only."""

    def __init__(self, pages: DataFrame, url_col: str = "url", html_col: str = "html", buckets: int = BUCKETS):
        self.shelf, self.buckets = Shelf(pages.sparkSession), buckets
        keyed = pages.select(U.normalize_url(F.col(url_col)).alias("src"), F.col(html_col).alias("html"))
        keyed = keyed.withColumn("bucket", bucket_of(F.col("src"), buckets))
        self.pages = self.shelf.add("pages", keyed.repartition(buckets, "bucket", F.pmod(F.xxhash64("html"), F.lit(4))), bucketed=True)

    def of(self, urls: DataFrame, few: bool) -> DataFrame:
        """The pages of ``urls`` (src, ...), with their columns."""
        wanted = urls.withColumn("bucket", bucket_of(F.col("src"), self.buckets))
        return in_buckets(self.pages, wanted).join(F.broadcast(wanted) if few else wanted, ["bucket", "src"]).drop("bucket")

    def links_of(self, parents: DataFrame, few: bool) -> DataFrame:
        x = self.of(parents, few).select("src", "parent_rank", F.posexplode(H.extract_links("html", F.col("src"))).alias("pos", "dst"))
        return x.withColumn("kind", F.when(U.is_document_link(F.col("dst")), F.lit("doc")).otherwise(F.lit("nav")))

    def remove(self) -> None:
        self.shelf.remove()


def crawl_frontier(
    links: DataFrame | LinksOf,
    seed_url: str | Column,
    depth: int = 1,
    max_pages: int | None = None,
    allow_external: bool = False,
    all_urls: bool = False,
) -> DataFrame:
    """URLs a breadth-first crawl from ``seed_url`` queues, in visit order.

    ``links``: (src, pos, dst, kind) over normalised URLs, or what ``stored_page_links`` returns.  Within
    a level, candidates are discovered in (parent rank, documents before navigation links, link position)
    order; a candidate is queued when it is in scope, not a duplicate under the smart dedup rules of
    everything queued before it, and, if ``max_pages`` is given, fewer than that are queued.  Returns
    (rank, url, depth, kind)."""
    links_of = table_links(links) if isinstance(links, DataFrame) else links
    spark = SparkSession.getActiveSession()
    ensure_checkpoint_dir(spark)
    start = spark.range(1).select((seed_url if isinstance(seed_url, Column) else F.lit(seed_url)).alias("_seed"))

    def with_parts(df):
        key = U.scheme_key(F.col("url"))
        q = F.instr(key, "?")
        return df.withColumn("key", key).withColumn("has_q", q > 0).withColumn(
            "base", F.when(q > 0, F.expr("substring(key, 1, instr(key, '?') - 1)")).otherwise(F.col("key"))
        ).withColumn(
            "params",
            F.when(q > 0, query_tokens(F.expr("substring(key, instr(key, '?') + 1)"))).otherwise(F.array().cast("array<string>")),
        )

    queued = with_parts(
        start.select(F.lit(1).cast("long").alias("rank"), U.normalize_url(F.col("_seed")).alias("url"), F.lit(0).alias("depth"), F.lit("nav").alias("kind"))
    ).checkpoint()
    seed_host = U.url_host(F.lit(queued.first()["url"]))
    # canonical parameter set of every base path seen so far
    canon = queued.select("base", F.col("params").alias("canon")).checkpoint()
    frontier, added = queued, 1
    total = 1
    for level in range(depth + 1):
        if max_pages is not None and total >= max_pages:
            break
        parents = frontier.filter(F.col("kind") == "nav").select(F.col("url").alias("src"), F.col("rank").alias("parent_rank"))
        cand = links_of(parents, added <= BROADCAST_URLS)
        if not allow_external:
            cand = cand.filter(U.in_scope(U.url_host(F.col("dst")), seed_host))
        if level >= depth:
            cand = cand.filter(F.col("kind") == "doc")
        cand = cand.select(
            "parent_rank", F.when(F.col("kind") == "doc", 0).otherwise(1).alias("kind_ord"), "pos",
            F.col("dst").alias("url"), "kind",
        )
        # Narrow rows, cut: the range partitioning below would have the links extracted twice.
        cand = with_parts(cand).checkpoint()
        fresh = cand.join(queued.select("key"), "key", "left_anti")
        firsts = fresh.groupBy("key").agg(F.min(F.struct("parent_rank", "kind_ord", "pos", "url", "kind", "has_q", "base", "params")).alias("_f"))
        firsts = firsts.select("key", "_f.*")
        level_canon = firsts.groupBy("base").agg(F.min(F.struct("parent_rank", "kind_ord", "pos", "params")).alias("_c")).select(
            "base", F.col("_c.parent_rank").alias("c_pr"), F.col("_c.kind_ord").alias("c_ko"), F.col("_c.pos").alias("c_pos"),
            F.col("_c.params").alias("level_canon"),
        )
        j = firsts.join(canon, "base", "left").join(level_canon, "base", "left")
        is_first_of_new_base = F.col("canon").isNull() & (F.col("parent_rank") == F.col("c_pr")) & (
            F.col("kind_ord") == F.col("c_ko")) & (F.col("pos") == F.col("c_pos"))
        eff = F.coalesce(F.col("canon"), F.col("level_canon"))
        dup = ~is_first_of_new_base & (
            (F.col("has_q") & (F.size(eff) > 0) & (F.size(F.array_except(eff, F.col("params"))) == 0))
            | (~F.col("has_q") & (F.size(eff) == 0))
        )
        if all_urls:
            dup = F.lit(False)
        accepted = j.filter(~dup).select("parent_rank", "kind_ord", "pos", "url", "kind", "key", "has_q", "base", "params")
        ranked = global_rank(accepted, ["parent_rank", "kind_ord", "pos"], out_col="_lr")
        if max_pages is not None:
            ranked = ranked.filter(F.col("_lr") <= F.lit(max_pages - total))
        new = ranked.select(
            (F.col("_lr") + F.lit(total)).alias("rank"), "url", F.lit(level + 1).alias("depth"), "kind", "key", "has_q", "base", "params"
        ).checkpoint()
        added = new.count()
        if added == 0:
            break
        total += added
        # a union of checkpointed parts: reading it back is cheap, so no further checkpoint
        queued = queued.unionByName(new)
        canon = canon.unionByName(
            new.join(canon.select("base"), "base", "left_anti")
            .withColumn("_r", F.row_number().over(Window.partitionBy("base").orderBy("rank")))
            .filter(F.col("_r") == 1)
            .select("base", F.col("params").alias("canon"))
        ).checkpoint()
        frontier = new
    return queued.select("rank", "url", "depth", "kind")
