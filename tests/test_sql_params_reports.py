import json

import pytest
from helpers import SF01

from pyspark.sql import functions as F

import model
from trawl.functions import sql_functions
from trawl.operators import fetch as FE
from trawl.operators import grep as G
from trawl.operators import rendered as RE
from trawl.operators import scope as SC
from trawl.params import SearchParams
from trawl.plans import queries as Q
from trawl.plans import report as R


def test_sql_functions_equal_model(spark):
    sql_functions.register(spark)
    spark.read.parquet(f"{SF01}/documents.parquet").limit(200).createOrReplaceTempView("docs_sql")
    for kw, mode in [("ete", "default"), ("hten", "fuzzy"), ("That", "exact"), ("C++", "default"), ("a\\Eb", "default")]:
        rows = spark.sql(f"SELECT text, count_matches(text, '{kw.replace(chr(92), chr(92) * 2)}', '{mode}') AS c FROM docs_sql").collect()
        assert all(r.c == model.count(r.text, kw, mode) for r in rows), (kw, mode)
    assert spark.sql("SELECT fold_strict('Café-Ünter 1') AS f").first().f == "cafeunter1"


def test_sql_normalize_url_equals_column_version(spark):
    from trawl.functions import urls as U
    from trawl.sources import fixtures as FX

    sql_functions.register(spark)
    h = FX.fx_hrefs(spark, SF01)
    rows = h.select(F.expr("normalize_url(href, url)").alias("a"), U.normalize_url(F.col("href"), F.col("url")).alias("b"),
                    F.expr("normalize_url(url, '')").alias("c"), U.normalize_url(F.col("url")).alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in rows)
    assert spark.sql("SELECT normalize_url('../c', 'http://example.com/a/b/') AS v").first().v == "http://example.com/a/c"


def test_sql_functions_have_no_python_in_plan(spark):
    sql_functions.register(spark)
    plan = spark.sql("SELECT count_matches(text, 'x', 'fuzzy') FROM docs_sql")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


@pytest.mark.parametrize("kwargs", [
    dict(keyword="x"),
    dict(keyword="x", url="u", folder="f"),
    dict(keyword="  ", url="u"),
    dict(keyword="x", url="u", depth=-1),
    dict(keyword="x", url="u", max_pages=0),
    dict(keyword="x", url="u", max_bytes=0),
    dict(keyword="x", url="u", max_hits=-1),
    dict(keyword="x", url="u", delay_ms=-1),
    dict(keyword="x", url="u", timeout_ms=0),
    dict(keyword="x", url="u", mode="regex"),
    dict(keyword="x", url="u", output="xml"),
])
def test_params_validation(kwargs):
    with pytest.raises(ValueError):
        SearchParams(**kwargs)


def test_params_defaults():
    p = SearchParams(keyword="x", folder="/tmp")
    assert (p.depth, p.mode, p.max_pages, p.max_bytes, p.max_hits, p.output) == (1, "default", None, 10 * 1024 * 1024, 0, "text")


def test_sql_functions_reject_unknown_modes(spark):
    sql_functions.register(spark)
    with pytest.raises(Exception, match="unknown mode"):
        spark.sql("SELECT count_matches('a', 'a', 'regex')").collect()


PLAIN = [("a.txt", "one key\nkey key"), ("b.txt", "nothing")]
PAGED = [("p.txt", "key\x0cno\nkey two")]


def _lines(spark, files):
    return G.grep_lines(spark.createDataFrame(files, "path string, text string"), "key", id_cols=("path",))


def test_file_reports_and_pages(spark):
    plain = [json.loads(r.line) for r in R.file_json(_lines(spark, PLAIN), F.col("path"), "key", "default").orderBy("section", *R.KEYS).collect()]
    assert plain[0] == {"query": {"file": "a.txt", "keyword": "key", "mode": "default"}, "stats": {"total_matches": 3}}
    assert plain[1:] == [{"line": 1, "count": 1, "snippet": "one key"}, {"line": 2, "count": 2, "snippet": "key key"}]
    paged = [json.loads(r.line) for r in R.file_json(_lines(spark, PAGED), F.col("path"), "key", "default").orderBy("section", *R.KEYS).collect()]
    assert [(x["page"], x["line"]) for x in paged[1:]] == [(1, 1), (2, 2)]
    files = spark.createDataFrame(PLAIN + PAGED, "path string, text string")
    text = [r.line for r in R.file_text(_lines(spark, PLAIN + PAGED), files).orderBy("path", "section", *R.KEYS).collect()]
    assert text[:6] == ["--- Results ---", "File: a.txt", "Total matches found: 3", "\nMatches:", '  l.1               (1 match)  "one key"', '  l.2               (2 matches)  "key key"']
    assert text[6:9] == ["--- Results ---", "File: b.txt", "Total matches found: 0"]
    assert text[-1] == '  p.2, l.2          (1 match)  "key two"'


def test_folder_reports(spark):
    lines = _lines(spark, PLAIN + PAGED)
    stats = spark.createDataFrame([(3, 1, 2, 2, 5)], "files_scanned long, files_skipped long, files_failed long, files_with_matches long, total_matches long")
    got = [json.loads(r.line) for r in R.folder_json(lines, stats, "dir", "key", "default", stopped_early=4).orderBy("section", *R.KEYS).collect()]
    assert got[0]["stopped_early"] == "max-hits limit of 4 reached" and got[0]["stats"]["files_failed"] == 2
    assert [x.get("file") for x in got[1:]] == ["a.txt", None, None, "p.txt", None, None]
    assert "page" not in got[2] and got[5]["page"] == 1
    text = [r.line for r in R.folder_text(lines, stats, "dir", duration_ms=1500, stopped_early=4).orderBy("section", *R.KEYS).collect()]
    assert text[:5] == ["--- Results ---", "Duration: 1.50s", "Folder: dir", "Files scanned: 3", "  Skipped (too large): 1"]
    assert "\na.txt  (3 matches)" in text and any("limit of 4 reached" in x for x in text)


def test_crawl_json_fields(spark):
    df = Q.report_json_crawl(spark, SF01)
    lines = [json.loads(r.line) for r in df.orderBy("section", *R.KEYS).collect()]
    head = lines[0]
    assert set(head["stats"]) == {"total_matches", "pages_visited", "pages_parsed", "docs_parsed", "pages_blocked", "errors"}
    assert set(head["stats"]["errors"]) == {"network_error", "blocked", "parse_error", "skipped_size", "skipped_type"}
    assert head["stats"]["errors"]["parse_error"] > 0 and "stopped_early" not in head
    reasons = {k: v for x in lines if "network_error_reasons" in x for k, v in x["network_error_reasons"].items()}
    assert {"Timeout", "EOFException", "stream closed", "HTTP 404"} <= set(reasons)
    results = [x for x in lines if "count" in x]
    assert head["stats"]["total_matches"] == sum(x["count"] for x in results) and len({x["url"] for x in results}) == len(results)
    assert [x["count"] for x in results] == sorted((x["count"] for x in results), reverse=True)
    assert all(x.get("snippets") != [] for x in results)


def test_text_report_sections(spark):
    lines = [r.line for r in Q.report_text(spark, SF01).orderBy("section", *R.KEYS).collect()]
    assert lines[0] == "--- Results ---" and lines[1].startswith("Total matches found: ") and lines[2].startswith("Pages visited: ")
    assert "\nIssues:" in lines and "\nFound in:" in lines and "\nBlocked / inaccessible:" in lines
    issues = lines[lines.index("\nIssues:") + 1 : lines.index("\nFound in:")]
    assert issues[0].startswith("  Network errors: ") and issues[1].startswith("    ") and "    Timeout: " in "\n".join(issues)
    found = [x for x in lines if x.startswith("  http")]
    counts = [int(x.rsplit("(", 1)[1].rstrip(")")) for x in found]
    assert counts == sorted(counts, reverse=True)


def test_redirects_to_the_same_page_are_no_redirects(spark):
    rows = [(0, "http://s.com/", "https://elsewhere.org/", 403), (1, "http://a.com/x", "https://a.com/x", 200), (2, "http://b.com/y#top", "http://b.com/y", 200),
            (3, "http://c.com/1", "http://c.com/land", 200), (4, "http://c.com/2", "http://c.com/land", 200)]
    log = spark.createDataFrame([(i, u, f, s, None, None, "text/html", None, "<body>key</body>") for i, u, f, s in rows],
                                "page_id long, url string, final_url string, status int, error_class string, error_message string, content_type string, "
                                "content_length string, body string")
    got = {r.page_id: r.outcome for r in FE.fetch_outcomes(log, 1000).collect()}
    assert got == {0: "blocked", 1: "ok", 2: "ok", 3: "ok", 4: "redirect_duplicate"}
    scope = FE.scope_redirect(FE.fetch_outcomes(log, 1000), "http://a.com/").first()
    assert scope.first_host == "a.com" and not scope.moved  # the blocked fetch is no visit
    moved = log.withColumn("final_url", F.when(F.col("page_id") == 1, F.lit("https://www.new.org/x")).otherwise(F.col("final_url")))
    scope = FE.scope_redirect(FE.fetch_outcomes(moved, 1000), "http://a.com/").first()
    assert (scope.moved, scope.scope_root, scope.allow_subdomains) == (True, "new.org", True)


def test_merge_rendered(spark):
    spa = '<html ng-version="1"><body><a href="/own">x</a><a href="/own.pdf">y</a></body></html>'
    pages = spark.createDataFrame([(1, "http://a.com/p", spa), (2, "http://a.com/q", "<body>plain text <a href='/z'>z</a>" + " w" * 200), (3, "http://a.com/r", spa)],
                                  "page_id long, url string, html string")
    shots = spark.createDataFrame([(1, "seen", ["/r", "/s.css", "/r", "mailto:a@b.c"], ["f/r.pdf"]), (2, "unused", ["/u"], [])],
                                  "page_id long, text string, links array<string>, doc_links array<string>")
    got = {r.page_id: r for r in RE.merge_rendered(pages, shots).collect()}
    assert (got[1].rendered, got[1].text, got[1].nav_links, got[1].doc_links) == (True, "seen", ["http://a.com/r"], ["http://a.com/own.pdf", "http://a.com/f/r.pdf"])
    assert not got[2].rendered and got[2].nav_links == ["http://a.com/z"] and got[2].text.strip().startswith("plain text")
    assert not got[3].rendered and got[3].nav_links == ["http://a.com/own"]


def test_scope_of_seeds(spark):
    pages = spark.createDataFrame([(h,) for h in ("x.org", "www.x.org", "a.b.x.org", "ax.org", "y.org", "www.y.org", "d.y.org", "")], "host string")
    seeds = spark.createDataFrame([("www.x.org",), ("y.org",)], "seed_host string")
    got = sorted((r.host, r.seed_host) for r in SC.in_scope_of(pages, seeds).collect())
    assert got == [("a.b.x.org", "www.x.org"), ("www.x.org", "www.x.org"), ("www.y.org", "y.org"), ("x.org", "www.x.org"), ("y.org", "y.org")]


def test_line_matches_in_sql_equal_the_line_grep(spark):
    from trawl.functions import sql_functions
    from trawl.operators import grep as G

    sql_functions.register(spark)
    texts = ["one key\r\nKEY kéy\rnone", "a key\fkey key\n\nx", "", None, "no", "  \t" + "key " * 50 + "\x01"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.createOrReplaceTempView("sql_texts")
    for mode in ("exact", "default", "fuzzy"):
        got = spark.sql(f"SELECT doc_id, m.* FROM (SELECT doc_id, line_matches(text, 'key', '{mode}') AS f FROM sql_texts) LATERAL VIEW explode(f) AS m")
        assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in G.grep_lines(df, "key", mode).collect())
        assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
