"""Queries against SQL on the driver's tables; the whole catalogue runs with GATE_ALL=1."""
import os

import pytest

from gate.catalog import QUERIES
from gate.compare import connect, differences
from gate.oracle import ORACLE

QUICK = ["daily_fare", "weekly_fare_detailed", "route_analysis", "index_daily", "index_route_daily_sparse", "market_features",
         "outlier_route_iqr", "dedup_records", "record_fingerprint", "quality_filtered", "paginate", "booking_window",
         "search_spine", "backtest_metrics", "filtered_dashboard"]


def test_every_query_has_sql():
    assert sorted(QUERIES) == sorted(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("GATE_ALL") else QUICK)
def test_query_equals_sql(spark, sf_dir, name):
    assert differences(spark, connect(sf_dir), sf_dir, name) == ""
