import os
import tempfile

import pytest
from helpers import SF01
from pyspark.sql import functions as F

import model
from trawl.functions import urls as U
from trawl.operators import graph as GR
from trawl.operators import stats as S
from trawl.plans import search as P


def _crawl_order(links, seed, depth, max_pages=None):
    """(url, depth, kind) in the order a breadth-first crawl queues them, level by level: the candidates of a level
    follow everything queued before, and the dedup's definition over that sequence says which are queued."""
    by_src = {}
    for src, pos, dst, kind in links:
        by_src.setdefault(src, []).append((kind != "doc", pos, dst, kind))
    queued, level = [(seed, 0, "nav")], [(seed, 0, "nav")]
    while level:
        found = []
        for url, dep, kind in level:
            if kind == "nav":
                found += [(dst, dep + 1, k) for _, _, dst, k in sorted(by_src.get(url, [])) if k == "doc" or dep < depth]
        kept = model.accepted([u for u, _, _ in queued + found])[len(queued):]
        level = [x for x, ok in zip(found, kept) if ok]
        queued += level
        if max_pages is not None and len(queued) >= max_pages:
            return queued[:max_pages]
    return queued


def _edges(spark):
    pages = spark.read.parquet(f"{SF01}/pages.parquet")
    n = pages.count()
    urls = {r.page_id: r.u for r in pages.select("page_id", U.normalize_url(F.col("url")).alias("u")).collect()}
    links = []
    for pid in urls:
        for k in range(4):
            dst = (pid * 7 + k * 13 + 1) % n
            kind = "doc" if dst % 5 == 0 else "nav"
            links.append((urls[pid], k, urls[dst] + ("/file.pdf" if kind == "doc" else ""), kind))
    return urls, links


def test_crawl_order_equals_queue_model(spark):
    urls, links = _edges(spark)
    df = spark.createDataFrame(links, "src string, pos int, dst string, kind string")
    for depth, max_pages in [(2, None), (4, 30), (3, 7)]:
        got = [(r.url, r.depth, r.kind) for r in
               GR.crawl_frontier(df, urls[0], depth, max_pages, allow_external=True).orderBy("rank").collect()]
        assert got == _crawl_order(links, urls[0], depth, max_pages), (depth, max_pages)


def test_crawl_has_no_page_limit_of_its_own(spark):
    """A page with 6,000 links, each to a page with a link of its own."""
    n = 6000
    html = "<body>" + "".join(f'<a href="/p{i}">x</a>' for i in range(n)) + "</body>"
    pages = [("http://a.com/", html)] + [(f"http://a.com/p{i}", f'<body>key <a href="/q{i}">y</a></body>') for i in range(n)]
    df = spark.createDataFrame(pages, "url string, html string").repartition(4)
    links = GR.page_links(df.filter("url = 'http://a.com/'"))
    assert links.count() == n
    got = P.crawl_grep(df.withColumn("page_id", F.lit(1)), "http://a.com/", "key", depth=2)
    assert got.count() == n
    assert GR.crawl_frontier(GR.stored_page_links(df), "http://a.com/", depth=2).count() == 1 + 2 * n


def test_hub_page_is_split(spark):
    edges = [(0, i, "nav") for i in range(1, 5001)] + [(i, i + 5000, "nav") for i in range(1, 101)]
    df = spark.createDataFrame(edges, "src long, dst long, kind string")
    got = GR.bfs_levels(df, spark.createDataFrame([(0,)], "node long"), 2, doc_leaves=False)
    assert {d: got.filter(F.col("depth") == d).count() for d in (0, 1, 2)} == {0: 1, 1: 5000, 2: 100}


def test_bfs_levels_equal_python_bfs(spark):
    pages = spark.read.parquet(f"{SF01}/pages.parquet")
    n = pages.count()
    edges = [(p, (p * 7 + k * 13 + 1) % n, "nav") for p in range(n) for k in range(4)]
    df = spark.createDataFrame(edges, "src long, dst long, kind string")
    seeds = spark.createDataFrame([(0,)], "node long")
    got = {r.node: r.depth for r in GR.bfs_levels(df, seeds, 3, doc_leaves=False).collect()}
    dist, frontier = {0: 0}, [0]
    for level in range(3):
        nxt = []
        for u in frontier:
            for s, d, _ in edges:
                if s == u and d not in dist:
                    dist[d] = level + 1
                    nxt.append(d)
        frontier = nxt
    assert got == dist


def test_running_sum_and_rank_are_exact(spark):
    df = spark.range(0, 1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    r = {x.k: x.running for x in S.running_sum(df, ["k"], "v", "running", n_ranges=5).collect()}
    total = 0
    for k in range(1000):
        assert r[k] == total
        total += k % 7
    ranks = {x.k: x["rank"] for x in S.global_rank(df.select(F.negative("k").alias("k")), ["k"], n_ranges=4).collect()}
    assert ranks[-999] == 1 and ranks[0] == 1000


def _write(path, data: bytes):
    with open(path, "wb") as f:
        f.write(data)


def test_folder_scan(spark):
    root = tempfile.mkdtemp(prefix="trawl-folder-")
    os.makedirs(os.path.join(root, "sub", "_deep"))
    _write(os.path.join(root, "a.txt"), b"one key\ntwo\nkey key")
    _write(os.path.join(root, "_b.txt"), b"key")
    _write(os.path.join(root, ".c.txt"), b"key")
    _write(os.path.join(root, "sub", "b.txt"), b"nothing here")
    _write(os.path.join(root, "sub", "_deep", "d.txt"), b"deep key")
    _write(os.path.join(root, "bad.bin"), bytes([0x61, 0xFF, 0x62]) + b" key")
    _write(os.path.join(root, "empty.txt"), b"")
    _write(os.path.join(root, "big.txt"), b"key " * 100)
    os.symlink(os.path.join(root, "a.txt"), os.path.join(root, "link.txt"))
    os.symlink(os.path.join(root, "sub"), os.path.join(root, "linked"))
    for folder in (root, f"file://{root}"):
        lines, per_file, stats = P.scan_folder(spark, folder, "key", "default", max_bytes=100)
        st = stats.first()
        assert (st.files_scanned, st.files_skipped, st.files_failed, st.files_with_matches, st.total_matches) == (7, 1, 0, 5, 7)
        paths = sorted(os.path.basename(r.path) for r in per_file.collect())
        assert paths == [".c.txt", "_b.txt", "a.txt", "bad.bin", "d.txt"]
        snip = [r.snippet for r in lines.collect() if r.path.endswith("bad.bin")][0]
        assert snip == "a\ufffdb key"


def test_folder_scan_query_reads_long_documents(spark):
    from trawl.plans import queries as Q

    root = tempfile.mkdtemp(prefix="trawl-long-")
    rows = [(1, "one elle"), (2, "x " * 15_000 + "elle\nelle elle"), (3, "none")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{root}/documents.parquet")
    got = sorted(tuple(r) for r in Q.folder_scan(spark, root).collect())
    assert got == [(1, 1, 1), (2, 3, 2)]


def test_unreadable_files_count_as_failed(spark):
    from trawl.sources import files as FS

    listed = spark.createDataFrame([("/nowhere/at/all.txt", 3)], "path string, length long")
    assert FS.read_listed(listed, 10).first().text is None
    with pytest.raises(FileNotFoundError):
        FS.list_files(spark, "/nowhere")
    with pytest.raises(FileNotFoundError):
        P.scan_file(spark, "/nowhere/x.txt", "key")


def test_folder_max_hits(spark):
    root = tempfile.mkdtemp(prefix="trawl-hits-")
    for name in ("f1.txt", "f2.txt", "f3.txt"):
        _write(os.path.join(root, name), b"key one\nkey two")
    lines, per_file, stats = P.scan_folder(spark, root, "key", "default", max_hits=3)
    assert sorted(os.path.basename(r.path) for r in per_file.collect()) == ["f1.txt", "f2.txt"]
    st = stats.first()
    assert (st.total_matches, st.files_scanned, st.stopped_early) == (4, 2, 3)


def test_large_files_are_not_opened(spark):
    from trawl.sources import files as FS

    root = tempfile.mkdtemp(prefix="trawl-gate-")
    _write(os.path.join(root, "a.txt"), b"key")
    _write(os.path.join(root, "b.txt"), b"key " * 10)
    assert FS.list_files(spark, root).count() == 2
    assert [r.text for r in FS.read_files(spark, root, 10).collect()] == ["key"]


def test_files_are_packed_into_tasks_by_bytes(spark):
    """Many small files and one large one of one folder."""
    from trawl.sources import files as FS

    root = tempfile.mkdtemp(prefix="trawl-pack-")
    for i in range(300):
        _write(os.path.join(root, f"f{i:03d}.txt"), b"key " * 10)
    _write(os.path.join(root, "f150-large.txt"), b"key " * 5000)
    listed = FS.list_files(spark, root)
    assert listed.count() == 301
    parts = FS.packed(listed, task_bytes=4000, open_bytes=0)
    sizes = [r["b"] for r in parts.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("length").alias("b")).collect()]
    assert sum(sizes) == 300 * 40 + 20_000 and max(sizes) <= 4000 + 20_000 and sorted(sizes)[-2] <= 4040
    texts = FS.read_listed(listed, task_bytes=4000).collect()
    assert len(texts) == 301 and sum(len(r.text) for r in texts) == sum(sizes)
    chunks = [len(x) for x in FS._listing(100)(iter([__import__("pandas").DataFrame({"path": [root]})]))]
    assert chunks == [100, 100, 100, 1]


def test_a_scan_with_a_hit_limit_opens_a_prefix_of_the_files(spark):
    from trawl.sources import files as FS

    root = tempfile.mkdtemp(prefix="trawl-prefix-")
    for i in range(200):
        _write(os.path.join(root, f"f{i:03d}.txt"), b"key\n" if i % 2 else b"no\nk")
    listed = FS.list_files(spark, root)
    texts, _, per_file = P.scan_until(listed, "key", "exact", 1000, 9, first_bytes=20)
    assert texts.count() < 100 and per_file.agg(F.sum("total_matches")).first()[0] >= 9
    lines, files, stats = P.scan_folder(spark, root, "key", "exact", max_hits=9, first_bytes=20)
    assert sorted(os.path.basename(r.path) for r in files.collect()) == [f"f{i:03d}.txt" for i in range(1, 18, 2)]
    st = stats.first()
    assert (st.total_matches, st.files_scanned, st.stopped_early, lines.count()) == (9, 18, 9, 9)
    _, files, stats = P.scan_folder(spark, root, "key", "exact", max_hits=1000, first_bytes=20)
    assert files.count() == 100 and stats.first().stopped_early == 0


def test_texts_are_written_by_tasks_into_few_folders(spark):
    from trawl.sources import files as FS

    root = tempfile.mkdtemp(prefix="trawl-write-")
    rows = [(f"n{i}", f"text é {i}") for i in range(50)] + [("n1", "again"), ("n2", None)]
    assert FS.write_texts(spark.createDataFrame(rows, "name string, text string").repartition(3), root, folders=4) == 52
    assert len(os.listdir(root)) <= 4
    assert sorted(r.text for r in FS.read_files(spark, root).collect()) == sorted(t or "" for _, t in rows)


def test_scan_prunes_columns(spark):
    from trawl.plans import queries as Q

    plan = Q.count_default(spark, SF01)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_texts_of_one_partition_are_written_and_read_by_many_tasks(spark):
    from trawl.sources import files as FS

    root, batch = tempfile.mkdtemp(prefix="trawl-deal-"), spark.conf.get(FS.ARROW_ROWS)
    rows = [(f"n{i}", None if i == 7 else f"text {i}") for i in range(400)]
    assert FS.write_texts(spark.createDataFrame(rows, "name string, text string").coalesce(1), root, folders=1) == 400
    assert spark.conf.get(FS.ARROW_ROWS) == batch
    listed = FS.list_files(spark, root)
    writers = {int(r.path.rsplit("-", 1)[1][:-4]) >> 33 for r in listed.collect()}
    assert len(writers) > 1
    assert FS.packed(listed).select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert sorted(r.text for r in FS.read_files(spark, root).collect()) == sorted(t or "" for _, t in rows)
