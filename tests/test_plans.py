"""Shapes of physical plans: what is read, pushed, broadcast and never done."""
import contextlib
import io

import pytest
from pyspark.sql import functions as F

from fareloom.operators import aggregates as agg, identity as ident, market, price_index as idx, serving
from fareloom.session import attach
from tests.test_storage import _observed


def plan(df):
    """Formatted physical plan."""
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.fixture()
def table(spark, tmp_path):
    path = str(tmp_path / "observations")
    _observed(spark).write.parquet(path)
    return spark.read.parquet(path)


def test_aggregates_read_only_their_columns(table):
    text = plan(agg.daily_fare(table))
    reads = [line for line in text.splitlines() if line.startswith("ReadSchema")]
    assert reads and all("collection_timestamp" not in r and "record_id" not in r for r in reads)


def test_filters_reach_the_scan(table):
    text = plan(serving.filter_observations(table, travel_date="2024-01-02"))
    assert "EqualTo(outbound_date,2024-01-02)" in text
    assert "EqualTo(route,A-B)" in plan(serving.flights_query(table, "a-b", upper_routes=True))


def test_wide_rows_are_not_shuffled_for_route_context(table):
    for df in (market.market_features(table), market.outlier_route_iqr(table)):
        text = plan(df)
        assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_large_context_falls_back_to_a_shuffle_join(spark, table):
    stats = table.groupBy("route").agg(F.count("*").alias("n"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small, large = attach(table, stats, ["route"]), attach(table, stats, ["route"], rows=1)
        assert "BroadcastHashJoin" in plan(small) and "SortMergeJoin" in plan(large)
        assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_copies_combine_before_the_shuffle(table):
    text = plan(ident.keep_last(table, ["record_id"], ["collection_timestamp"]))
    assert "partial_max" in text and "Window" not in text


def test_listing_is_a_top_k(table):
    assert "TakeOrderedAndProject" in plan(serving.flights_query(table))


def test_no_pairwise_products(table):
    for df in (idx.index_daily(idx.index_route_daily(table, {"A-B": 1.0})), market.outlier_global_iqr(table),
               agg.route_analysis(table), idx.backtest_series(table, {"A-B": 1.0})):
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_results_do_not_depend_on_partitioning(table):
    a = sorted(map(tuple, agg.daily_fare(table.repartition(1)).collect()))
    b = sorted(map(tuple, agg.daily_fare(table.repartition(7)).collect()))
    assert [r[:2] for r in a] == [r[:2] for r in b]
    assert all(x[2:] == pytest.approx(y[2:], nan_ok=True) or None in x for x, y in zip(a, b))
