"""Report sinks: JSON and text lines built with ``to_json`` / ``format_string``.

A report is a DataFrame of lines (``section``, ``ord``, ``sub``, ``pos``, ``line``): a header line with query and
statistics, then one line per result or match.  Results are never gathered into one row or onto the
driver; ``write_report`` writes the lines with the DataFrame writer, sorted by
(section, ord, sub, pos) — a distributed range sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.text import format_duration

JSON_OPTS = {"ignoreNullFields": "true"}
KEYS = ("ord", "sub", "pos")


def _json(c: Column) -> Column:
    return F.to_json(c, JSON_OPTS)


def _stopped(limit: int) -> Column:
    return F.lit(f"max-hits limit of {limit} reached" if limit else None).cast("string")


def _lines(section: int, line: Column, *order: Column | str) -> list[Column]:
    """Columns of a report line: its section and three sort keys, each a column of its own."""
    keys = [F.col(o) if isinstance(o, str) else o for o in order] + [F.lit(0)] * (3 - len(order))
    return [F.lit(section).alias("section"), *[k.cast("long").alias(n) for k, n in zip(keys, KEYS, strict=True)], line.alias("line")]


def crawl_json(results: DataFrame, outcomes: DataFrame, blocked: DataFrame,
               url: str, depth: int, keyword: str, mode: str, stopped_early: int = 0) -> DataFrame:
    """results: (seq, url, count, snippets), one row per URL; outcomes: fetch outcomes; blocked: (seq, url, reason).

    Lines: a header with query and statistics, one per reason of network errors, one per result by falling
    count then visit order, one per blocked URL.  Statistics and error counts come from aggregations."""
    from trawl.operators.fetch import ERROR_TYPES, error_reasons, stat_columns
    from trawl.operators.stats import global_rank

    stats = outcomes.agg(
        *stat_columns(),
        *[F.count_if(F.col("category") == t).cast("long").alias(t) for t in ERROR_TYPES],
    )
    total = results.agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("total_matches"))
    query = F.struct(F.lit(url).alias("url"), F.lit(depth).alias("depth"), F.lit(keyword).alias("keyword"), F.lit(mode).alias("mode"))
    head = stats.select("*", total.scalar().alias("total_matches")).select(*_lines(0, _json(F.struct(
        query.alias("query"),
        F.struct("total_matches", "pages_visited", "pages_parsed", "docs_parsed", "pages_blocked",
                 F.struct(*ERROR_TYPES).alias("errors")).alias("stats"),
        _stopped(stopped_early).alias("stopped_early"),
    ))))
    reasons = global_rank(error_reasons(outcomes), ["reason"], out_col="_r")
    head = head.unionByName(reasons.select(*_lines(0, _json(F.struct(F.create_map("reason", "count").alias("network_error_reasons"))), "_r")))
    ranked = global_rank(results.withColumn("_neg", F.negative("count")), ["_neg", "seq"], out_col="_rank")
    some = F.when(F.size("snippets") > 0, F.col("snippets"))
    body = ranked.select(*_lines(1, _json(F.struct("url", "count", some.alias("snippets"))), "_rank"))
    blk = blocked.select(*_lines(2, _json(F.struct("url", "reason")), "seq"))
    return head.unionByName(body).unionByName(blk)


def _match_json(has_pages: Column) -> Column:
    return _json(F.struct(F.when(has_pages, F.col("page")).alias("page"), "line", "count", "snippet"))


def _files_ranked(lines: DataFrame, id_cols=("path",)) -> DataFrame:
    """(ids, total_matches, has_pages, _rank): files with matches, ranked by path."""
    from trawl.operators.grep import grep_files
    from trawl.operators.stats import global_rank

    return global_rank(grep_files(lines, id_cols), list(id_cols), out_col="_rank")


def folder_json(lines: DataFrame, stats: DataFrame, folder: str, keyword: str, mode: str, stopped_early: int = 0) -> DataFrame:
    """lines: line matches (path, page, line, count, snippet); stats: one row.  A header line, then per file in path
    order a file line and one line per match, so no file's matches are gathered into one row.  ``page`` is
    left out for files without pages."""
    query = F.struct(F.lit(folder).alias("folder"), F.lit(keyword).alias("keyword"), F.lit(mode).alias("mode"))
    head = stats.select(*_lines(0, _json(F.struct(
        query.alias("query"),
        F.struct("files_scanned", "files_skipped", "files_failed", "files_with_matches", "total_matches").alias("stats"),
        _stopped(stopped_early).alias("stopped_early"),
    ))))
    files = _files_ranked(lines)
    file_lines = files.select(*_lines(1, _json(F.struct(F.col("path").alias("file"), "total_matches")), "_rank"))
    matches = lines.join(files.select("path", "has_pages", "_rank"), "path")
    match_lines = matches.select(*_lines(1, _match_json(F.col("has_pages")), "_rank", "page", "line"))
    return head.unionByName(file_lines).unionByName(match_lines)


def file_json(lines: DataFrame, file: Column | str, keyword: str, mode: str) -> DataFrame:
    """One report per file of ``lines`` (path, page, line, count, snippet): the file, a header line and a line per match."""
    file = F.lit(file) if isinstance(file, str) else file
    files = _files_ranked(lines)
    query = F.struct(file.alias("file"), F.lit(keyword).alias("keyword"), F.lit(mode).alias("mode"))
    head = files.select("path", *_lines(0, _json(F.struct(query.alias("query"), F.struct("total_matches").alias("stats")))))
    body = lines.join(files.select("path", "has_pages"), "path").select("path", *_lines(1, _match_json(F.col("has_pages")), F.lit(0), "page", "line"))
    return head.unionByName(body)


def _match_text(has_pages: Column) -> Column:
    place = F.when(has_pages, F.format_string("p.%d, l.%d", "page", "line")).otherwise(F.format_string("l.%d", "line"))
    times = F.when(F.col("count") == 1, F.lit("(1 match)")).otherwise(F.format_string("(%d matches)", "count"))
    return F.format_string('  %-16s  %s  "%s"', place, times, F.col("snippet"))


def folder_text(lines: DataFrame, stats: DataFrame, folder: str, duration_ms: int | None = None, stopped_early: int = 0) -> DataFrame:
    """The text report of a folder scan: summary, early-stop note, then per file its matches."""
    timing = [F.concat(F.lit("Duration: "), format_duration(F.lit(duration_ms)))] if duration_ms is not None else []
    none = F.lit(None).cast("string")
    summary = F.array(
        F.lit("--- Results ---"), *timing, F.lit(f"Folder: {folder}"), F.format_string("Files scanned: %d", "files_scanned"),
        F.when(F.col("files_skipped") > 0, F.format_string("  Skipped (too large): %d", "files_skipped")).otherwise(none),
        F.when(F.col("files_failed") > 0, F.format_string("  Failed (unreadable): %d", "files_failed")).otherwise(none),
        F.format_string("  With matches: %d", "files_with_matches"), F.format_string("Total matches found: %d", "total_matches"),
        F.lit(f"\nNote: Search stopped early - max-hits limit of {stopped_early} reached." if stopped_early else None),
    )
    head = stats.select(F.posexplode(summary).alias("i", "line")).filter(F.col("line").isNotNull()).select(*_lines(0, F.col("line"), "i"))
    files = _files_ranked(lines)
    title = F.format_string("\n%s  (%d match%s)", F.col("path"), F.col("total_matches"), F.when(F.col("total_matches") == 1, "").otherwise("es"))
    file_lines = files.select(*_lines(1, title, "_rank"))
    matches = lines.join(files.select("path", "has_pages", "_rank"), "path").select(*_lines(1, _match_text(F.col("has_pages")), "_rank", "page", "line"))
    return head.unionByName(file_lines).unionByName(matches)


def file_text(lines: DataFrame, paths: DataFrame) -> DataFrame:
    """The text report of each searched file of ``paths`` (path): summary, then its matches."""
    from trawl.operators.grep import grep_files

    files = paths.select("path").join(grep_files(lines, ("path",)), "path", "left")
    total = F.coalesce("total_matches", F.lit(0))
    summary = F.array(F.lit("--- Results ---"), F.concat(F.lit("File: "), F.col("path").cast("string")), F.format_string("Total matches found: %d", total),
                      F.when(total > 0, F.lit("\nMatches:")))
    head = files.select("path", F.posexplode(summary).alias("i", "line")).filter(F.col("line").isNotNull()).select("path", *_lines(0, F.col("line"), "i"))
    matched = lines.join(files.select("path", "has_pages"), "path")
    return head.unionByName(matched.select("path", *_lines(1, _match_text(F.col("has_pages")), F.lit(0), "page", "line")))


# Fixed values that must equal the search tool's text report: category labels in report order.
ERROR_LABELS = (
    ("network_error", "Network errors"), ("blocked", "Blocked"), ("parse_error", "Parse errors"),
    ("skipped_size", "Skipped (size limit)"), ("skipped_type", "Skipped (type filter)"),
)


def text_lines(results: DataFrame, keep=()) -> DataFrame:
    """Result lines of the text report: ``  <url> (<count>)``, each snippet quoted on its own
    indented line, then ``(+ N more)`` when the count exceeds the snippets shown."""
    ranked = results.select(
        *keep, "url", "count", "snippets",
        F.greatest(F.col("count") - F.size("snippets"), F.lit(0)).alias("more"),
    )
    lines = F.concat(
        F.array(F.format_string("  %s (%d)", F.col("url"), F.col("count"))),
        F.transform("snippets", lambda s: F.concat(F.lit('    "'), s, F.lit('"'))),
        F.when((F.size("snippets") > 0) & (F.col("more") > 0), F.array(F.format_string("    (+ %d more)", F.col("more"))))
        .otherwise(F.array().cast("array<string>")),
    )
    return ranked.select(*keep, "url", "count", F.posexplode(lines).alias("sub", "line"))


def crawl_text(results: DataFrame, outcomes: DataFrame, blocked: DataFrame, duration_ms: int | None = None,
               stopped_early: int = 0) -> DataFrame:
    """The text report of a crawl as (section, ord, sub, pos, line) rows.

    results: (url, count, snippets), one row per URL; outcomes: fetch outcomes; blocked: output of
    ``fetch.blocked_by_reason`` (reason, count, urls, more).  Sections: summary, issues, results ranked by
    count then URL, blocked URLs by reason, early-stop note.  Every section is built from its own
    aggregation or ranking; nothing is gathered into one row."""
    from trawl.operators.fetch import crawl_stats, error_counts, error_reasons
    from trawl.operators.stats import global_rank

    total = results.agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("t"))
    timing = [F.concat(F.lit("Duration: "), format_duration(F.lit(duration_ms)))] if duration_ms is not None else []
    summary = crawl_stats(outcomes).select("*", total.scalar().alias("t"))
    head = summary.select(F.posexplode(F.array(
        F.lit("--- Results ---"), *timing, F.format_string("Total matches found: %d", "t"), F.format_string("Pages visited: %d", "pages_visited"),
        F.format_string("  HTML pages: %d", "html_pages"), F.format_string("  Documents:  %d", "docs_parsed"),
    )).alias("i", "line")).select(*_lines(0, F.col("line"), "i"))

    labels = F.create_map(*[x for k, v in ERROR_LABELS for x in (F.lit(k), F.lit(v))])
    errs = error_counts(outcomes).filter(F.col("count") > 0)
    issue_lines = errs.select(*_lines(1, F.format_string("  %s: %d", F.element_at(labels, F.col("category")), F.col("count")), F.col("ord") + 1))
    reason_rank = global_rank(error_reasons(outcomes), ["reason"], out_col="_r")
    reason_lines = reason_rank.select(*_lines(1, F.format_string("    %s: %d", F.col("reason"), F.col("count")), F.lit(1), "_r"))

    def title(any_rows: DataFrame, section: int, text: str) -> DataFrame:
        n = any_rows.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 0)
        return n.select(*_lines(section, F.lit(text), F.lit(0)))

    ranked = global_rank(results.withColumn("_neg", F.negative("count")), ["_neg", "url"], out_col="_rank")
    found = text_lines(ranked, keep=("_rank",)).select(*_lines(2, F.col("line"), "_rank", "sub"))
    b = global_rank(blocked, ["reason"], out_col="_br")
    blines = F.concat(
        F.array(F.format_string("  %s (%d):", F.col("reason"), F.col("count"))),
        F.transform("urls", lambda u: F.concat(F.lit("    "), u)),
        F.when(F.col("more") > 0, F.array(F.format_string("    ... and %d more", F.col("more")))).otherwise(F.array().cast("array<string>")),
    )
    blocked_lines = b.select("_br", F.posexplode(blines).alias("i", "line")).select(*_lines(3, F.col("line"), "_br", "i"))
    out = (head.unionByName(title(errs, 1, "\nIssues:")).unionByName(issue_lines).unionByName(reason_lines)
           .unionByName(title(results, 2, "\nFound in:")).unionByName(found)
           .unionByName(title(blocked, 3, "\nBlocked / inaccessible:")).unionByName(blocked_lines))
    if stopped_early:
        note = f"\nNote: Search stopped early - max-hits limit of {stopped_early} reached."
        out = out.unionByName(total.select(*_lines(4, F.lit(note))))
    return out


def write_report(lines: DataFrame, path: str) -> None:
    lines.orderBy("section", *KEYS).select("line").write.mode("overwrite").text(path)
