"""Known results, replayed by arithmetic."""
import pytest
from pyspark.sql import functions as F

from fareloom.operators import aggregates as agg, price_index as idx
from tests.helpers import DAY, fares, rows

D1, D2 = DAY(2026, 9, 12), DAY(2026, 9, 13)


def test_daily_index_of_one_weighted_route(spark):
    data = [("BLR-DEL", D1, "A", 20649.375), ("BLR-DEL", D2, "A", 14283.0), ("AMD-BLR", D2, "A", 5.0)]
    routes = idx.index_route_daily(fares(spark, data), {"BLR-DEL": 0.2, "X-Y": 0.8})
    got = {(r.outbound_date, r.route): r for r in routes.collect()}
    row = got[(D2, "BLR-DEL")]
    assert row.route_index == pytest.approx(69.16916371560883)
    assert row.weighted_contribution == pytest.approx(13.833832743121768)
    bare = got[(D2, "AMD-BLR")]
    assert (bare.base_fare, bare.route_index, bare.weighted_contribution, bare.route_weight) == (None, None, None, 0.0)


def test_week_and_month_average_the_rounded_days(spark):
    daily = spark.createDataFrame([(D1, 100.0, 85), (D2, 77.11, 74)],
                                  "outbound_date date, price_index double, route_count long")
    assert rows(idx.index_weekly(daily), "week_start", "price_index", "observations") == [(DAY(2026, 9, 7), 88.555, 159)]
    assert rows(idx.index_monthly(daily), "month", "price_index", "observations") == [("2026-09", 88.555, 159)]
    changed = rows(idx.index_changes(daily), "index_change", "index_change_pct")
    assert changed == [(None, None), (-22.89, -22.89)]


def test_change_range_and_volatility(spark):
    data = [("AMD-BLR", D1, "A", x) for x in (19025.0, 27324.0, 36383.0)] + [("AMD-BLR", D2, "B", 16437.615384615383)]
    first, second = agg.daily_fare(fares(spark, data)).collect()
    assert first.average_fare == pytest.approx(27577.333333333332)
    assert first.fare_std == pytest.approx(8681.772534070064)
    assert first.volatility_pct == pytest.approx(31.481552001897928)
    assert (first.median_fare, first.fare_range, first.fare_change_pct) == (27324.0, 17358.0, None)
    assert second.fare_change_pct == pytest.approx(-40.39447111897917)


def test_single_observation_has_no_spread_and_ranks_are_dense(spark):
    data = [("COK-MAA", D1, "A", 72786.0), ("P-Q", D1, "A", 10.0), ("R-S", D1, "A", 10.0), ("T-U", D1, "A", 5.0)]
    got = rows(agg.route_analysis(fares(spark, data)), "route", "fare_std", "volatility_pct", "rank_by_average_fare")
    assert got == [("COK-MAA", 0.0, 0.0, 1), ("P-Q", 0.0, 0.0, 2), ("R-S", 0.0, 0.0, 2), ("T-U", 0.0, 0.0, 3)]


def test_distribution_edges(spark):
    edges = (5000.0, 5000.01, 7500.0, 10000.0, 15000.0, 25000.0, 50000.0, 50000.01)
    df = fares(spark, [("A-B", D1, "A", x) for x in edges])
    right = [("<=5K", 1), ("5K-7.5K", 2), ("7.5K-10K", 1), ("10K-15K", 1), ("15K-25K", 1), ("25K-50K", 1), ("50K+", 1)]
    assert rows(agg.fare_distribution(df)) == right
    left = [("<=5K", 0), ("5K-7.5K", 2), ("7.5K-10K", 1), ("10K-15K", 1), ("15K-25K", 1), ("25K-50K", 1), ("50K+", 2)]
    assert rows(agg.fare_distribution(df, "left", keep_empty=True)) == left
    total = agg.fare_distribution(df).agg(F.sum("observations")).first()[0]
    assert total == len(edges)
