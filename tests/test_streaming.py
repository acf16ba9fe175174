import os
import tempfile

from helpers import SF01
from pyspark.sql import functions as F

import model
from trawl.operators import grep as G
from trawl.streaming import jobs as S


def _drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_stream_grep_lines_equals_batch(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    src = tempfile.mkdtemp(prefix="trawl-stream-")
    docs.select("doc_id", "text").repartition(4).write.mode("overwrite").parquet(os.path.join(src, "in"))
    ckpt = tempfile.mkdtemp(prefix="trawl-stream-ckpt-")
    out = S.stream_grep_lines(spark, os.path.join(src, "in"), "doc_id long, text string", "elle", max_files_per_trigger=1)
    q = (out.writeStream.format("memory").queryName("t1_lines").option("checkpointLocation", ckpt).outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.sql("SELECT doc_id, page, line, count, snippet FROM t1_lines").collect())
    want = sorted(tuple(r) for r in G.grep_lines(docs, "elle", "default").collect())
    assert got == want and len(got) > 0


def test_stream_keyword_totals(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    src = tempfile.mkdtemp(prefix="trawl-stream2-")
    docs.select("doc_id", "text").write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema("doc_id long, text string").parquet(src)
    kws = [("elle", "default"), ("That", "exact")]
    _drain(S.stream_keyword_totals(stream, kws), "t3_totals", "complete")
    got = {r.keyword: r.total_matches for r in spark.sql("SELECT * FROM t3_totals").collect()}
    batch = G.multi_keyword_grep(docs, kws, with_snippet=False).groupBy("keyword").agg(F.sum("count").alias("n"))
    assert got == {r.keyword: r.n for r in batch.collect()}


def test_stream_smart_dedup_equals_definition(spark):
    """Three batches; one base path holds 50,000 URLs."""
    urls = ["https://a.com/p?id=1", "http://a.com/p?id=1&sort=asc", "https://a.com/p?id=2", "https://a.com/q",
            "https://a.com/q?x=1", "https://a.com/q", "https://b.com/?", "https://b.com/?z=1"]
    few = [*urls, "https://a.com/p?id=1", "https://a.com/p?id=3", "https://b.com/", "https://c.com/x", "https://a.com/q?x=1"]
    many = [(100 + i, f"https://hot.com/search?n={i}") for i in range(50_000)]
    rows = [list(enumerate(urls)), many[:30_000] + [(8, few[8]), (9, few[9])], many[30_000:] + many[:10] + [(10 + i, u) for i, u in enumerate(few[10:])]]
    rows[2] = [(200_000 + i, u) if s >= 100 and i >= 20_000 else (s, u) for i, (s, u) in enumerate(rows[2])]  # the ten repeats
    src = tempfile.mkdtemp(prefix="trawl-stream3-")
    for i, r in enumerate(rows):
        spark.createDataFrame(r, "seq long, url string").coalesce(1).write.parquet(os.path.join(src, f"batch{i}"))
    stream = spark.readStream.schema("seq long, url string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    query = S.stream_dedup(stream).writeStream.format("memory").queryName("t2_dedup").outputMode("append").start()
    query.processAllAvailable()
    assert query.lastProgress.batchId >= 2
    query.stop()
    got = {r.seq: r.accepted for r in spark.sql("SELECT * FROM t2_dedup").collect()}
    assert [got[i] for i in range(len(few))] == model.accepted(few)
    assert all(got[s] for s, _ in many[:5]) and sum(got[s] for s, _ in many) == 50_000
    assert sum(v for s, v in got.items() if s >= 200_000) == 0  # repeats of the hot path


def test_batches_count_once_after_a_repeat(spark, tmp_path):
    table = S.BatchTable(spark, str(tmp_path))
    table.write(spark.createDataFrame([(1, 5), (2, 7)], "k long, n long"), 0)
    table.write(spark.createDataFrame([(1, 6)], "k long, n long"), 1)
    table.write(spark.createDataFrame([(1, 8)], "k long, n long"), 1)  # the batch runs again after a restart
    assert sorted(tuple(r) for r in table.read().collect()) == [(1, 5, 0), (1, 8, 1), (2, 7, 0)]
    assert sorted(tuple(r) for r in table.latest(["k"]).collect()) == [(1, 8), (2, 7)]


def test_dedup_state_holds_active_base_paths_only(spark, tmp_path):
    """Ten base paths an hour; each is forgotten ten minutes after the watermark has passed it."""
    sink, sizes, hours = S.BatchTable(spark, str(tmp_path / "out")), [], 3
    for hour in range(hours):
        rows = [(hour * 100 + i, f"http://a.com/{hour}-{i}", (hour + 1) * 3600 + i) for i in range(10)]
        if hour == hours - 1:
            rows.append((hour * 100 + 50, "http://a.com/0-3", (hour + 1) * 3600 + 50))  # long forgotten, so new again
            rows.append((hour * 100 + 51, f"http://a.com/{hour}-3", (hour + 1) * 3600 + 51))
        spark.createDataFrame(rows, "seq long, url string, s long").select("seq", "url", F.timestamp_seconds("s").alias("at")).coalesce(1).write.parquet(
            str(tmp_path / "in" / f"h{hour}"))
        stream = spark.readStream.schema("seq long, url string, at timestamp").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        query = S.run_available(S.stream_dedup(stream, time_col="at", keep_ms=600_000), sink, str(tmp_path / "state"))
        sizes.append(max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]))
    got = {r.seq: r.accepted for r in sink.read().collect()}
    assert got.pop((hours - 1) * 100 + 51) is False
    assert [s for s in (*(100 * h + i for h in range(hours) for i in range(10)), 250) if not got.get(s)] == []
    assert sizes[-1] <= 2.2 * sizes[0]  # the last two hours; all three would be 3 times


def test_window_totals_drop_closed_windows(spark, tmp_path):
    sink, totals = S.BatchTable(spark, str(tmp_path / "out")), []
    for hour in range(4):
        spark.createDataFrame([(hour, "elle elle", hour * 3600)], "doc_id long, text string, s long").select("doc_id", "text", F.timestamp_seconds("s").alias("at")).coalesce(
            1).write.parquet(str(tmp_path / "in" / f"h{hour}"))
        stream = spark.readStream.schema("doc_id long, text string, at timestamp").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        query = S.run_available(S.stream_window_totals(stream, [("elle", "default")], "at", "1 hour", "5 minutes"), sink, str(tmp_path / "state"), "update")
        totals.append(query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    assert [r.total_matches for r in sink.latest(["window_start", "keyword", "mode"]).collect()] == [2] * 4
    assert max(totals) <= 2


def test_parts_of_a_stream_are_ranges_that_a_scan_can_use(spark):
    from trawl.plans import queries as Q

    root = tempfile.mkdtemp(prefix="trawl-thirds-")
    spark.createDataFrame([(i, "x") for i in (-4, 0, 0, 5, 9, None)], "doc_id long, text string").write.parquet(f"{root}/d")
    parts = Q._thirds(spark.read.parquet(f"{root}/d"), "doc_id")
    assert [sorted(r.doc_id for r in p.collect()) for p in parts] == [[-4, 0, 0], [5], [9]]
    for p in parts:
        assert "GreaterThanOrEqual(doc_id" in p._jdf.queryExecution().executedPlan().toString()
