"""Paths and small helpers of the tests."""

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def one(spark, col_expr, **values):
    """Evaluate one Column expression over a one-row DataFrame built from ``values``."""
    import pandas as pd  # noqa: F401

    names = list(values)
    df = spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} string" for n in names))
    return df.select(col_expr.alias("v")).first()["v"]
