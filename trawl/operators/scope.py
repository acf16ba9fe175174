"""Site scope against a table of seeds, as equality joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.functions import urls as U


def in_scope_of(pages: DataFrame, seeds: DataFrame) -> DataFrame:
    """Every (page, seed) pair where the page's host is in the seed's scope.

    ``pages`` has host, ``seeds`` has seed_host.  A seed ``www.x`` admits x and all its subdomains, another seed x only x
    and www.x.  A host's candidates are itself, its parent domains and its form without ``www.``, so the
    condition is an equality on one of a few names per host."""
    names = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.struct(
        F.array_join(F.slice(names, i, F.size(names)), ".").alias("name"), F.lit("www").alias("kind")))
    bare = F.array_distinct(F.array(F.col("host"), U.scope_root(F.col("host"))))
    plain = F.transform(bare, lambda h: F.struct(h.alias("name"), F.lit("plain").alias("kind")))
    candidates = pages.withColumn("_c", F.explode(F.concat(parents, plain))).select("*", "_c.*").drop("_c")
    roots = seeds.withColumn("name", U.scope_root(F.col("seed_host"))).withColumn(
        "kind", F.when(F.col("seed_host").startswith("www."), "www").otherwise("plain"))
    return candidates.filter(F.col("host") != "").join(roots, ["name", "kind"]).drop("name", "kind")
