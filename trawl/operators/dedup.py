"""Order-dependent URL deduplication expressed as aggregations.

Rules (sequence order given by an explicit ``seq`` column):
  * key = URL with ``http://`` read as ``https://``; a URL whose key appeared earlier is a
    duplicate (exact mode stops here);
  * smart mode: the *first* URL seen on a base path (URL before ``?``) fixes that base's
    canonical parameter set.  A later URL with a query is a duplicate when its ``&``-separated
    token set contains every canonical token and the canonical set is non-empty; a later bare
    URL is a duplicate only when the canonical set is empty.

Both "first per key" and "first per base" are ``min`` aggregations, which Spark combines
map-side, so a base path or key holding a large share of all rows does not land in one task;
the final join against one canonical row per base is re-planned by AQE (broadcast when small,
skew-split when a base is hot).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.urls import scheme_key


def query_tokens(q: Column) -> Column:
    """Token set of a query string split on ``&`` with trailing empty tokens dropped:
    ``''`` -> {''}, ``'&'`` -> {}, ``'a=1&'`` -> {'a=1'}."""
    trimmed = F.regexp_replace(q, "&+$", "")
    return (
        F.when(q == "", F.array(F.lit("")))
        .when(trimmed == "", F.array().cast("array<string>"))
        .otherwise(F.array_distinct(F.split(trimmed, "&", -1)))
    )


def url_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    key = scheme_key(F.col(url_col))
    q = F.instr(key, "?")
    return df.withColumn("key", key).select(
        "*",
        (q > 0).alias("has_q"),
        F.when(q > 0, F.expr("substring(key, 1, instr(key, '?') - 1)")).otherwise(F.col("key")).alias("base"),
        F.when(q > 0, query_tokens(F.expr("substring(key, instr(key, '?') + 1)"))).otherwise(
            F.array().cast("array<string>")
        ).alias("params"),
    )


def first_per_key(df: DataFrame, url_col: str = "url", seq_col: str = "seq") -> DataFrame:
    """Exact (scheme-insensitive) dedup: the first URL of every key, as (seq, url, key).  ``seq`` is unique.

    The minimum is a long, so it is a hash aggregate that is combined before the shuffle; the URLs of the
    survivors are joined back on ``seq``."""
    keyed = df.select(F.col(seq_col).alias("seq"), F.col(url_col).alias("url")).withColumn("key", scheme_key(F.col("url")))
    firsts = keyed.groupBy("key").agg(F.min("seq").alias("seq")).select("seq")
    return keyed.join(firsts, "seq", "left_semi").select("seq", "url", "key")


def smart_dedup(df: DataFrame, url_col: str = "url", seq_col: str = "seq", all_urls: bool = False) -> DataFrame:
    """Accepted URLs (seq, url, key) under smart dedup, or exact dedup when ``all_urls``."""
    firsts = first_per_key(df, url_col, seq_col)
    if all_urls:
        return firsts
    parts = url_parts(firsts.drop("key"), "url")
    first_seq = parts.groupBy("base").agg(F.min("seq").alias("canon_seq"))
    canon = parts.select("seq", F.col("params").alias("canon")).join(first_seq, F.col("seq") == F.col("canon_seq")).select("base", "canon_seq", "canon")
    j = parts.join(canon, "base")
    dup = (F.col("seq") != F.col("canon_seq")) & (
        (F.col("has_q") & (F.size("canon") > 0) & (F.size(F.array_except("canon", "params")) == 0))
        | (~F.col("has_q") & (F.size("canon") == 0))
    )
    return j.filter(~dup).select("seq", "url", "key")


def dedup_flags(df: DataFrame, url_col: str = "url", seq_col: str = "seq", all_urls: bool = False) -> DataFrame:
    """Every input row with ``duplicate`` = not accepted (left join of the accepted set)."""
    acc = smart_dedup(df, url_col, seq_col, all_urls).select(F.col("seq").alias("_acc_seq"))
    return (
        df.join(acc, F.col(seq_col) == F.col("_acc_seq"), "left")
        .withColumn("duplicate", F.col("_acc_seq").isNull())
        .drop("_acc_seq")
    )


def dedup_size(df: DataFrame, url_col: str = "url", seq_col: str = "seq", all_urls: bool = False) -> DataFrame:
    return smart_dedup(df, url_col, seq_col, all_urls).agg(F.count(F.lit(1)).cast("long").alias("accepted"))
