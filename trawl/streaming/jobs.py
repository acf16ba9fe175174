"""Structured Streaming variants of the batch jobs.

* :func:`stream_grep_lines` — new documents in, line matches out (stateless, append).
* :func:`stream_dedup` — URL dedup over an unbounded stream: exact mode is ``dropDuplicates``
  on the scheme-insensitive key; smart mode keeps state per base path (canonical parameter set and
  a map entry per key seen) with ``transformWithState``, which needs the RocksDB state store.
* :func:`stream_keyword_totals` — running match totals per keyword (update/complete mode).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from trawl.functions.urls import scheme_key
from trawl.operators import grep as G
from trawl.operators.dedup import query_tokens
from trawl.session import ship_code


def stream_grep_lines(spark: SparkSession, source_dir: str, schema: str, keyword: str, mode: str = "default",
                      text_col: str = "text", id_cols=("doc_id",), fmt: str = "parquet",
                      max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    docs = reader.load(source_dir)
    return G.grep_lines(docs, keyword, mode, text_col=text_col, id_cols=id_cols)


def stream_keyword_totals(stream: DataFrame, keywords: Sequence[tuple[str, str]], text_col: str = "text",
                          id_cols=("doc_id",)) -> DataFrame:
    hits = G.multi_keyword_grep(stream, keywords, text_col=text_col, id_cols=id_cols, with_snippet=False)
    return hits.groupBy("keyword", "mode").agg(
        F.sum("count").cast("long").alias("total_matches"), F.count(F.lit(1)).cast("long").alias("matching_lines")
    )


def stream_window_totals(stream: DataFrame, keywords: Sequence[tuple[str, str]], time_col: str, window: str, lateness: str,
                         text_col: str = "text", id_cols=("doc_id",)) -> DataFrame:
    """Match totals per keyword and event-time window.  A window's state is dropped once the watermark (the latest event
    time less ``lateness``) has passed its end; rows that come later than that are not counted."""
    hits = G.multi_keyword_grep(stream.withWatermark(time_col, lateness), keywords, text_col=text_col, id_cols=(*id_cols, time_col), with_snippet=False)
    return hits.groupBy(F.window(time_col, window).alias("_w"), "keyword", "mode").agg(
        F.sum("count").cast("long").alias("total_matches"), F.count(F.lit(1)).cast("long").alias("matching_lines")
    ).select(F.col("_w.start").alias("window_start"), "keyword", "mode", "total_matches", "matching_lines")


class BatchTable:
    """A sink of micro-batches: one folder per batch id, written anew if that batch runs again.  So every batch counts once,
    also after a restart that repeats the last one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def write(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.folder)

    def latest(self, keys: Sequence[str]) -> DataFrame:
        """The table that update-mode batches describe: the last row of each key."""
        rows = self.read()
        values = [c for c in rows.columns if c not in (*keys, "batch")]
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
        return newest.select(*keys, "_v.*")


def run_available(stream: DataFrame, sink: BatchTable, checkpoint: str, mode: str = "append"):
    """Processes what has arrived since the last run with this checkpoint folder, and stops; returns the ended query."""
    query = (stream.writeStream.foreachBatch(sink.write).outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query


_OUT = "seq long, url string, accepted boolean"


class SmartDedup(StatefulProcessor):
    """Smart dedup of one base path: its canonical parameters, and a map entry per key seen, so a batch reads and writes
    only the entries of its own keys however many URLs the base path has."""

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.canon = handle.getValueState("canon", "params array<string>")
        self.seen = handle.getMapState("seen", "key string", "accepted boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        canon = frozenset(self.canon.get()[0]) if self.canon.exists() else None
        accepted = []
        for has_q, k, params in zip(batch["has_q"], batch["key"], batch["params"], strict=True):
            if self.seen.containsKey((k,)):
                accepted.append(False)
                continue
            own = frozenset(params)
            if canon is None:  # the first URL on the base path
                canon, ok = own, True
                self.canon.update((sorted(own),))
            else:
                ok = not (canon and canon <= own) if has_q else bool(canon)
            self.seen.updateValue((k,), (ok,))
            accepted.append(ok)
        if self.keep_ms is not None:  # one timer, after the latest event of the base path
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            latest = max(int(batch["time"].max().timestamp() * 1000), timer_values.getCurrentWatermarkInMs())
            self.handle.registerTimer(latest + self.keep_ms)
        yield pd.DataFrame({"seq": batch["seq"].astype("int64"), "url": batch["url"], "accepted": accepted})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.canon.clear()
        self.seen.clear()
        yield pd.DataFrame({"seq": [], "url": [], "accepted": []}).astype({"seq": "int64", "url": str, "accepted": bool})

    def close(self) -> None:
        pass


def stream_dedup(stream: DataFrame, url_col: str = "url", seq_col: str = "seq", all_urls: bool = False, time_col: str | None = None,
                 lateness: str = "0 seconds", keep_ms: int | None = None) -> DataFrame:
    """Accept/reject every arriving URL.  Within a micro-batch rows are taken in ``seq`` order;
    across batches arrival order is the batch order.  With ``time_col`` and ``keep_ms``, a base path is forgotten once the
    watermark has passed its latest event by ``keep_ms``, so the state holds active base paths only; exact mode forgets a
    key once the watermark has passed it.  Smart mode needs a session whose
    ``spark.sql.streaming.stateStore.providerClass`` is the RocksDB provider (``local_session`` sets it)."""
    if (time_col is None) != (keep_ms is None):
        raise ValueError("give both time_col and keep_ms, or neither")
    key = scheme_key(F.col(url_col))
    time = [] if time_col is None else [F.col(time_col).alias("time")]
    if time_col is not None:
        stream = stream.withWatermark(time_col, lateness)
    keyed = stream.select(*time, F.col(seq_col).cast("long").alias("seq"), F.col(url_col).alias("url"), key.alias("key"))
    if all_urls:
        once = keyed.dropDuplicates(["key"]) if time_col is None else keyed.dropDuplicatesWithinWatermark(["key"])
        return once.select("seq", "url", F.lit(True).alias("accepted"))
    q = F.instr(F.col("key"), "?")
    parts = keyed.select(
        *(["time"] if time_col else []), "seq", "url", "key", (q > 0).alias("has_q"),
        F.when(q > 0, F.expr("substring(key, 1, instr(key, '?') - 1)")).otherwise(F.col("key")).alias("base"),
        F.when(q > 0, query_tokens(F.expr("substring(key, instr(key, '?') + 1)"))).otherwise(
            F.array().cast("array<string>")).alias("params"),
    )
    ship_code(stream.sparkSession)
    return parts.groupBy("base").transformWithStateInPandas(
        SmartDedup(keep_ms), StructType.fromDDL(_OUT), "Append", "None" if keep_ms is None else "EventTime")
