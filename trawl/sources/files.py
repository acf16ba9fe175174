"""File sources: every regular file below a folder, on any file system that Arrow can open.

Folders are listed and files read by tasks, level by level and file by file; the driver only learns how
many folders the next level has.  Hidden files (``_x``, ``.x``) and empty ones are files like any other,
symbolic links are left out, and files over the size limit are listed but never opened.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.operators.stats import running_sum
from trawl.session import ensure_checkpoint_dir, ship_code

_ENTRY = "path string, length long, is_dir boolean"


def decode_utf8(content: Column) -> Column:
    """Bytes to text; malformed UTF-8 sequences become U+FFFD."""
    return F.call_function("make_valid_utf8", content.cast("string"))


def _opener():
    """A function from a path or URI to (Arrow file system, path on it); self-contained, so that it travels to tasks."""
    def open_path(path):
        from pyarrow import fs

        if path.startswith("file:"):
            path = "/" + path[5:].lstrip("/")
        return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)

    return open_path


def _local_path(path: str) -> str | None:
    """The place of a local file, which Python opens in less time than Arrow; None for other file systems."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if "://" not in path else None


def _info(path: str):
    system, place = _opener()(path)
    return system.get_file_info(place)


def _entries(opener, folder: str) -> Iterator[tuple[str, int | None, bool]]:
    """(path, length, whether it is a folder) of what a folder holds, links left out."""
    import os

    from pyarrow import fs

    system, place = opener(folder)
    if isinstance(system, fs.LocalFileSystem):  # one entry at a time
        with os.scandir(place) as found:
            for x in found:
                if not x.is_symlink() and (x.is_file() or x.is_dir()):
                    yield f"{folder.rstrip('/')}/{x.name}", None if x.is_dir() else x.stat().st_size, x.is_dir()
        return
    for x in system.get_file_info(fs.FileSelector(place)):
        if x.type in (fs.FileType.File, fs.FileType.Directory):
            is_dir = x.type == fs.FileType.Directory
            yield f"{folder.rstrip('/')}/{x.base_name}", None if is_dir else x.size, is_dir


def _listing(chunk: int):
    opener, entries = _opener(), _entries

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        def frame(rows):
            return pd.DataFrame(rows, columns=["path", "length", "is_dir"]).astype({"length": "Int64", "is_dir": bool})

        for batch in batches:
            for folder in batch["path"]:
                rows = []
                for row in entries(opener, folder):
                    rows.append(row)
                    if len(rows) == chunk:
                        yield frame(rows)
                        rows = []
                yield frame(rows)

    return run


def _reading(batch_bytes: int, batch_files: int):
    opener, local = _opener(), _local_path

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        def read(path):
            place = local(path)
            if place is not None:
                with open(place, "rb") as f:
                    return f.read()
            system, place = opener(path)
            with system.open_input_stream(place) as f:
                return f.read()

        rows, held = [], 0
        for batch in batches:
            for path, length in zip(batch["path"], batch["length"], strict=True):
                try:
                    content = read(path)
                except OSError:
                    content = None
                if rows and (held + len(content or b"") > batch_bytes or len(rows) == batch_files):
                    yield pd.DataFrame(rows, columns=["path", "length", "content"])
                    rows, held = [], 0
                rows.append((path, length, content))
                held += len(content or b"")
        if rows:
            yield pd.DataFrame(rows, columns=["path", "length", "content"])

    return run


CHUNK_FILES = 10_000  # entries of a folder that a task holds at a time
TASK_BYTES = 128 << 20  # bytes of files that a task reads
OPEN_BYTES = 32 << 10  # what opening a file counts for
BATCH_BYTES = 16 << 20  # bytes of files that a task holds at a time, unless one file has more
BATCH_FILES = 1_000
WRITE_ROWS = 128  # texts that a writing task's Python holds at a time
FOLDERS = 16
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of every regular file below ``folder``, without reading content."""
    if _info(folder).type.name != "Directory":
        raise FileNotFoundError(f"Folder not found: {folder}")
    ensure_checkpoint_dir(spark)
    ship_code(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders, count = spark.createDataFrame([(folder,)], "path string"), 1
    found: DataFrame | None = None
    while count:  # one round per level of folders
        level = folders.repartition(min(n, count)).mapInPandas(_listing(CHUNK_FILES), _ENTRY).checkpoint()
        files = level.filter(~F.col("is_dir")).select("path", "length")
        found = files if found is None else found.unionByName(files)
        folders = level.filter("is_dir").select("path")
        count = folders.count()
    return found


def packed(files: DataFrame, task_bytes: int = TASK_BYTES, open_bytes: int = OPEN_BYTES) -> DataFrame:
    """``files`` (path, length) dealt to tasks by bytes: in the order of paths, a task ends where the running sum of lengths
    (and a fixed sum per file) passes a multiple of ``task_bytes``, so it has that much and one file more at most.  Where that
    makes too few tasks for the cluster's cores, they get less."""
    ensure_checkpoint_dir(files.sparkSession)
    weighed = files.withColumn("_weight", F.col("length") + open_bytes)
    cores = files.sparkSession.sparkContext.defaultParallelism
    task_bytes = min(task_bytes, (weighed.agg(F.sum("_weight")).first()[0] or 0) // (2 * cores) + 1)
    placed = running_sum(weighed, ["path"], "_weight", "_before").withColumn("_task", F.floor(F.col("_before") / task_bytes).cast("int")).checkpoint()
    tasks = (placed.agg(F.max("_task")).first()[0] or 0) + 1
    return placed.repartitionById(tasks, F.col("_task")).select(*files.columns)


def read_listed(files: DataFrame, max_bytes: int | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(path, length, text) of the listed files, those over ``max_bytes`` left out; ``text`` is null for files that can't be read."""
    small = files if max_bytes is None else files.filter(F.col("length") <= F.lit(max_bytes))
    ship_code(files.sparkSession)
    raw = packed(small.select("path", "length"), task_bytes).mapInPandas(_reading(BATCH_BYTES, BATCH_FILES), "path string, length long, content binary")
    return raw.select("path", "length", decode_utf8(F.col("content")).alias("text"))


def read_files(spark: SparkSession, folder: str, max_bytes: int | None = None) -> DataFrame:
    return read_listed(list_files(spark, folder), max_bytes)


def read_file(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """One file as (path, length, text); empty when it is over the limit."""
    info = _info(path)
    if info.type.name != "File":
        raise FileNotFoundError(f"File not found: {path}")
    return read_listed(spark.createDataFrame([(path, info.size)], "path string, length long"), max_bytes)


def _writing(folder: str, folders: int):
    opener, local = _opener(), _local_path

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import zlib

        import pandas as pd

        n, made, at_home = 0, set(), local(folder)
        system, root = opener(folder)
        for batch in batches:
            for name, row, text in zip(batch["name"], batch["row"], batch["text"], strict=True):
                part = f"{zlib.crc32(name.encode()) % folders:04d}"
                if part not in made:
                    system.create_dir(f"{root}/{part}", recursive=True)
                    made.add(part)
                content, place = (text or "").encode("utf-8", "replace"), f"{part}/{name}-{row}.txt"
                with open(os.path.join(at_home, place), "wb") if at_home else system.open_output_stream(f"{root}/{place}") as f:
                    f.write(content)
                n += 1
        yield pd.DataFrame({"n": [n]})

    return run


def write_texts(texts: DataFrame, folder: str, folders: int = FOLDERS) -> int:
    """Writes every row (name, text) as a file ``<name>-<row number>.txt`` below ``folders`` folders, from the tasks; a task that
    runs again writes the same files.  Rows are dealt to all cores first, since stored files often split into few tasks with
    rows; texts reach Python ``WRITE_ROWS`` at a time.  Returns their number."""
    spark = texts.sparkSession
    ensure_checkpoint_dir(spark)
    ship_code(spark)
    tasks = max(2 * spark.sparkContext.defaultParallelism, texts.rdd.getNumPartitions())
    rows = texts.repartition(tasks).withColumn("row", F.monotonically_increasing_id()).checkpoint()
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(WRITE_ROWS))
    try:
        return rows.mapInPandas(_writing(folder, folders), "n long").agg(F.sum("n")).first()[0] or 0
    finally:
        spark.conf.set(ARROW_ROWS, before)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that this library wrote, on whatever file system it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
