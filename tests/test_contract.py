from helpers import SF001

import __spark_entry__ as E


def test_entry_runs_on_smoke_data(spark):
    df = E.entry(spark)
    assert df.columns == ["doc_id", "total_matches", "matching_lines", "has_pages"]
    assert df.count() > 0


def test_every_search_query_has_an_oracle_statement():
    from trawl.plans.queries import QUERIES

    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert set(QUERIES) <= set(o)


def test_queries_read_given_tables(spark):
    for name in ("grep_lines", "dedup_smart", "fetch_outcomes", "link_graph"):
        df = E.queries()[name](spark, SF001)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "parquet" in plan.lower(), name
