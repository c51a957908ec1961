"""Queries against their SQL on the smallest tables."""

import os

import pytest

D = "/root/testdata/sf0.001"
NAMES = ["flagship_alerts", "a7_ecdf", "a17_average_precision", "w6_segments", "ml18_alert_policy_study", "ml18_winner_traces", "ml18_winner_events", "ml18_winner_engines", "ml18_complementarity", "ml18_targets"]


@pytest.mark.skipif(not os.path.isdir(D), reason="tables aren't here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    import duckdb

    from tidewatch.plans import catalog

    con = duckdb.connect()
    for t in ("events", "lineitem", "documents", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    got, want = catalog.queries()[name](spark, D), con.execute(catalog.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    key = lambda r: tuple((x is None, str(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)) for x in r)
    assert sorted(map(key, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(key, want.fetchall()))


