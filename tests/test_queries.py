"""Queries against DuckDB on the small tables."""

import os

import duckdb
import numpy as np
import pytest

from marketlab.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["bars_events_daily", "panel_locf", "asof_bar_lookup", "bars_invalid_rules", "schedule_change", "tsmom_weights", "xsmom_weights", "bollinger_state", "metrics_all", "position_avg_cost", "pbo_logits", "purged_kfold", "vector_equity", "event_engine_run", "rebalance_orders", "round_trips", "trade_stats", "chart_points", "cpcv_select", "block_lengths", "allocation_ew", "allocation_iv", "day_orders_run"])
def test_against_sql(spark, duck, name):
    got, want = QUERIES[name](spark, FOLDER).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in columns:
        if got[c].dtype.kind in "fiu":
            assert np.allclose(got[c].astype(float), want[c].astype(float), rtol=0, atol=2e-6, equal_nan=True), c
        else:
            assert got[c].astype(str).tolist() == want[c].astype(str).tolist(), c
