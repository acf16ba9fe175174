"""Fetch-log analytics: outcome of every stored fetch, size gate, content routing, bot
challenges, redirect dedup, scope moves, and the crawl statistics built from them.

Input schema (``fetch_log``): ``page_id`` (fetch order), ``url``, ``final_url``, ``status``,
``error_class``, ``error_message``, ``content_type``, ``content_length`` (header text), ``body``.
Bodies are reduced to flags in the stage that scans them; only narrow rows are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions import html as H
from trawl.functions import urls as U
from trawl.operators.dedup import smart_dedup
from trawl.session import ensure_checkpoint_dir

# Fixed values that must equal the search tool's: error categories (report order) and the
# labels for network error classes.
ERROR_TYPES = ("network_error", "blocked", "parse_error", "skipped_size", "skipped_type")
ERROR_REASONS = (
    ("SocketTimeoutException", "Timeout"),
    ("UnknownHostException", "DNS failure"),
    ("ConnectException", "Connection refused"),
    ("SSLException", "SSL error"),
    ("SSLHandshakeException", "SSL error"),
    ("SSLPeerUnverifiedException", "SSL error"),
    ("UnsupportedMimeTypeException", "Unsupported content type"),
)
BLOCKED_STATUSES = (403, 429)


def classify_error(error_class: Column, message: Column | None = None) -> Column:
    out = None
    for cls, label in ERROR_REASONS:
        cond = error_class == cls
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    first_line = error_class if message is None else F.coalesce(F.regexp_extract(message, "^([^\n]*)", 1), error_class)
    return out.otherwise(first_line)


def route_content(content_type: Column) -> Column:
    """``html`` for text/html or application/xhtml+xml, else ``document``."""
    ct = F.coalesce(content_type, F.lit(""))
    return F.when(ct.contains("text/html") | ct.contains("application/xhtml+xml"), F.lit("html")).otherwise(F.lit("document"))


def over_size(content_length: Column, body: Column, max_bytes: int) -> Column:
    """Header length above the limit (non-numeric headers ignored) or body bytes above it."""
    header = F.coalesce(content_length.try_cast("long") > F.lit(max_bytes), F.lit(False))
    return header | F.coalesce(F.octet_length(body) > F.lit(max_bytes), F.lit(False))


def redirect_duplicates(log: DataFrame) -> DataFrame:
    """page_ids whose redirect target was already queued (requested URLs come first at each step: the requested
    URL of fetch i has order 2i, its final URL 2i+1).  A final URL that is the requested page itself, up to
    scheme and fragment, is no redirect.  Only fetches that returned have a final URL."""
    asked, got = U.normalize_url(F.col("url")), U.normalize_url(F.col("final_url"))
    returned = F.coalesce(F.col("status") < 400, F.lit(False)) & F.col("error_class").isNull()
    both = log.select("page_id", asked.alias("_asked"), F.when(returned, got).alias("_got"))
    moved = F.col("_got").isNotNull() & (U.scheme_key(F.col("_got")) != U.scheme_key(F.col("_asked")))
    events = both.select(F.inline(F.array(
        F.struct((F.col("page_id") * 2).alias("seq"), F.col("_asked").alias("url")),
        F.struct((F.col("page_id") * 2 + 1).alias("seq"), F.when(moved, F.col("_got")).otherwise(F.lit("")).alias("url")),
    ))).filter(F.col("url") != "")
    ensure_checkpoint_dir(log.sparkSession)
    events = events.checkpoint()  # narrow rows, read several times below
    accepted = smart_dedup(events, "url", "seq").select("seq")
    dup = events.filter(F.col("seq") % 2 == 1).join(accepted, "seq", "left_anti")
    return dup.select((F.col("seq") / 2).cast("long").alias("page_id"))


def fetch_flags(log: DataFrame, max_bytes: int) -> DataFrame:
    """The fetch log without bodies: kind, over (size), lost (HTML without a body) and challenge."""
    from trawl.operators.grep import with_computed

    html = route_content(F.col("content_type")) == "html"
    # The costly tests are computed once per fetch, in a generator that later filters cannot be pushed through.
    return with_computed(
        log, ["page_id", "url", "final_url", "status", "error_class", "error_message"],
        kind=route_content(F.col("content_type")),
        over=over_size(F.col("content_length"), F.col("body"), max_bytes),
        lost=html & F.col("body").isNull(),
        challenge=F.coalesce(html & H.is_challenge(F.col("body")), F.lit(False)),
    )


def fetch_outcomes(log: DataFrame, max_bytes: int) -> DataFrame:
    """(page_id, url, final_url, kind, outcome, reason, category) with the first matching rule winning: 403/429
    blocked; other HTTP >= 400 network error; exception network error; redirect to an already-queued URL;
    over size; HTML that could not be parsed; bot challenge (HTML only); else ok."""
    dups = redirect_duplicates(log).withColumn("_redir_dup", F.lit(True))
    return judge(fetch_flags(log, max_bytes).join(dups, "page_id", "left"))


def judge(j: DataFrame) -> DataFrame:
    """Outcome, reason and category of fetches with their flags and ``_redir_dup``."""
    status = F.col("status")
    http_err = status.isNotNull() & (status >= 400)
    outcome = (
        F.when(status.isin(*BLOCKED_STATUSES), F.lit("blocked"))
        .when(http_err, F.lit("network_error"))
        .when(F.col("error_class").isNotNull(), F.lit("network_error"))
        .when(F.coalesce(F.col("_redir_dup"), F.lit(False)), F.lit("redirect_duplicate"))
        .when(F.col("over"), F.lit("skipped_size"))
        .when(F.col("lost"), F.lit("parse_error"))
        .when(F.col("challenge"), F.lit("challenge"))
        .otherwise(F.lit("ok"))
    )
    out = j.select("page_id", "url", "final_url", "kind", outcome.alias("outcome"), "status", "error_class", "error_message")
    reason = (
        F.when(F.col("outcome") == "blocked", F.format_string("HTTP %d (Access Denied/Rate Limited)", status))
        .when(http_err, F.format_string("HTTP %d", status))
        .when(F.col("outcome") == "network_error", classify_error(F.col("error_class"), F.col("error_message")))
        .when(F.col("outcome") == "challenge", F.lit(H.CHALLENGE_REASON))
    )
    category = F.when(F.col("outcome") == "challenge", F.lit("blocked")).when(
        F.col("outcome").isin("blocked", "network_error", "skipped_size", "parse_error"), F.col("outcome"))
    return out.select("page_id", "url", "final_url", "kind", "outcome", reason.alias("reason"), category.alias("category"))


#: Outcomes of fetches that returned and count as visited.
VISITED = ("redirect_duplicate", "skipped_size", "parse_error", "challenge", "ok")


def stat_columns() -> list[Column]:
    """The statistics of a crawl's fetches, as aggregates over outcome and kind."""
    o = F.col("outcome")
    return [
        F.count_if(o.isin(*VISITED)).cast("long").alias("pages_visited"),
        F.count_if(o == "ok").cast("long").alias("pages_parsed"),
        F.count_if((o == "ok") & (F.col("kind") == "document")).cast("long").alias("docs_parsed"),
        F.count_if(o.isin("blocked", "challenge")).cast("long").alias("pages_blocked"),
    ]


def crawl_stats(outcomes: DataFrame) -> DataFrame:
    """visited (fetches that returned), parsed, docs, html pages = max(0, parsed - docs), blocked."""
    return outcomes.agg(*stat_columns()).withColumn("html_pages", F.greatest(F.col("pages_parsed") - F.col("docs_parsed"), F.lit(0)))


def error_counts(outcomes: DataFrame) -> DataFrame:
    """Count per error category, zero rows included."""
    spark = outcomes.sparkSession
    dim = spark.createDataFrame([(i, t) for i, t in enumerate(ERROR_TYPES)], "ord int, category string")
    counts = outcomes.filter(F.col("category").isNotNull()).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return dim.join(counts, "category", "left").select(
        "ord", "category", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("count")
    )


def error_reasons(outcomes: DataFrame) -> DataFrame:
    return (
        outcomes.filter(F.col("outcome") == "network_error")
        .groupBy("reason")
        .agg(F.count(F.lit(1)).cast("long").alias("count"))
    )


def blocked_by_reason(outcomes: DataFrame, shown: int = 10) -> DataFrame:
    """Per reason: number of blocked URLs, the first ``shown`` in fetch order, and how many more.

    ``max_by``-style top-k via ``min_by`` over a bounded array would still collect per group, so
    the first URLs come from a rank window restricted to ``shown`` rows per reason before the
    (now bounded) collect."""
    from pyspark.sql import Window

    b = outcomes.filter(F.col("outcome").isin("blocked", "challenge")).select(
        "reason", "page_id", F.when(F.col("outcome") == "challenge", F.col("final_url")).otherwise(F.col("url")).alias("url")
    )
    counts = b.groupBy("reason").agg(F.count(F.lit(1)).cast("long").alias("count"))
    firsts = (
        b.withColumn("_r", F.row_number().over(Window.partitionBy("reason").orderBy("page_id")))
        .filter(F.col("_r") <= shown)
        .groupBy("reason")
        .agg(F.array_sort(F.collect_list(F.struct("page_id", "url"))).alias("_f"))
    )
    return counts.join(firsts, "reason").select(
        "reason", "count", F.col("_f.url").alias("urls"), F.greatest(F.col("count") - F.lit(shown), F.lit(0)).alias("more")
    )


def scope_redirect(outcomes: DataFrame, seed_url: str | Column) -> DataFrame:
    """Scope after the first visited fetch: it moves to the host where that fetch ended if that is outside the
    seed's scope.  Blocked and failed fetches are not visits, and a redirect duplicate moves nothing."""
    seed = seed_url if isinstance(seed_url, Column) else F.lit(seed_url)
    first = outcomes.filter(F.col("outcome").isin(*VISITED)).agg(F.min(F.struct("page_id", "final_url", "outcome")).alias("_f"))
    x = first.select("_f", seed.alias("_seed")).select(U.url_host(U.normalize_url(F.col("_seed"))).alias("seed_host"),
                     U.url_host(U.normalize_url(F.col("_f.final_url"))).alias("first_host"),
                     (F.col("_f.outcome") != "redirect_duplicate").alias("_may"))
    moved = F.col("_may") & ~U.in_scope(F.col("first_host"), F.col("seed_host"))
    x = x.select("seed_host", "first_host", moved.alias("moved"), F.when(moved, F.col("first_host")).otherwise(F.col("seed_host")).alias("_host"))
    return x.select("seed_host", "first_host", "moved", U.scope_root(F.col("_host")).alias("scope_root"),
                    F.col("_host").startswith("www.").alias("allow_subdomains"))


def page_hits(log: DataFrame, keyword: str, mode: str = "default", max_bytes: int | None = None, snippets: int = 3) -> DataFrame:
    """(page_id, kind, count, snippets) of the fetches with matches, in the stage that scans the bodies: page text of
    HTML, decoded text of documents.  Join it with ``fetch_outcomes`` to keep the fetches that count."""
    from trawl.functions import text as T
    from trawl.operators.grep import with_computed

    kind = route_content(F.col("content_type"))
    read = log.filter(F.col("body").isNotNull() & F.coalesce(F.col("status") < 400, F.lit(False)))
    text = F.when(kind == "html", H.page_text(F.col("body"))).otherwise(F.col("body"))
    t = with_computed(read, ["page_id"], text=text)
    counted = with_computed(t, ["page_id", "text"], count=T.count_matches(F.col("text"), keyword, mode)).filter(F.col("count") > 0)
    return counted.select("page_id", "count", T.find_snippets(F.col("text"), keyword, mode, snippets).alias("snippets"))
