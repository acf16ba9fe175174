"""Merging rendered snapshots into stored pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions import html as H
from trawl.functions import urls as U


def _links(hrefs: Column, base: Column) -> Column:
    """Normalised, distinct links that are not ignored; an array per page."""
    items = F.transform(hrefs, lambda u: F.struct(u.alias("u"), base.alias("b"), F.lit(False).alias("qf")))
    return F.array_distinct(F.filter(U.normalize_url_structs(items), lambda u: (u != "") & ~U.is_ignored_link(u)))


def merge_rendered(pages: DataFrame, rendered: DataFrame) -> DataFrame:
    """(page_id, rendered, text, nav_links, doc_links) of every page.

    ``rendered``: (page_id, text, links, doc_links), at most one row per page.  Where there is one for a page that
    the client-rendered detector flags, its text and navigation links replace the page's own and its document
    links are added to the page's."""
    base = U.normalize_url(F.col("url"))
    own = pages.select("page_id", base.alias("base"), H.page_text(F.col("html")).alias("own_text"),
                       H.extract_links(F.col("html"), base).alias("own"), H.is_spa(F.col("html")).alias("spa"))
    other = rendered.select("page_id", F.col("text").alias("r_text"), F.col("links").alias("r_links"), F.col("doc_links").alias("r_docs"))
    x = own.join(other, "page_id", "left").withColumn("rendered", F.col("spa") & F.col("r_text").isNotNull())
    nav = F.filter("own", lambda u: ~U.is_document_link(u))
    docs = F.filter("own", lambda u: U.is_document_link(u))
    return x.select(
        "page_id", "rendered", F.when(F.col("rendered"), F.col("r_text")).otherwise(F.col("own_text")).alias("text"),
        F.when(F.col("rendered"), _links(F.col("r_links"), F.col("base"))).otherwise(nav).alias("nav_links"),
        F.when(F.col("rendered"), F.array_union(docs, _links(F.col("r_docs"), F.col("base")))).otherwise(docs).alias("doc_links"),
    )
