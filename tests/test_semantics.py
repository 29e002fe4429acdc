"""Missing values, ties, edges and order rules on small tables."""
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fareloom import fixed
from fareloom.functions import columns as C
from fareloom.operators import aggregates as agg, airports as air, cleaning as clean, collection as col
from fareloom.operators import features as feat, identity as ident, market, price_index as idx, quality, serving
from tests.helpers import DAY, TS, fares, rows

D1, D2, D3 = DAY(2024, 1, 5), DAY(2024, 1, 6), DAY(2024, 1, 8)


def test_bad_numbers_and_dates_turn_null(spark):
    df = spark.createDataFrame([("x", "2024-13-01"), ("nan", "2024-01-05"), (" 12.5 ", None)], "price string, outbound_date string")
    out = clean.coerce_types(df, ["price"], ["outbound_date"], [])
    assert rows(out) == [(None, None), (None, D1), (12.5, None)]


def test_nan_is_missing_in_statistics(spark):
    df = fares(spark, [("A-B", D1, "X", 10.0), ("A-B", D1, None, 20.0), (None, D1, "X", 99.0)])
    df = df.unionByName(df.limit(1).withColumn("total_fare", F.lit(float("nan")))).withColumn("total_fare", C.number("total_fare"))
    got = rows(agg.daily_fare(df), "route", "average_fare", "median_fare", "observations", "airlines")
    assert got == [("A-B", 15.0, 15.0, 2, 1)]


def test_zero_divisors_give_null_or_zero(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (1.0, 2.0)], "a double, b double")
    got = rows(df.select(C.share("a", "b"), C.change_pct("a", "b"), C.volatility("a", "b")))
    assert got == [(None, None, 0.0), (None, None, 0.0), (50.0, -50.0, 50.0)]


def test_all_missing_contributions_sum_to_zero(spark):
    routes = spark.createDataFrame([(D1, "A-B", None, 0.4), (D2, "A-B", 50.0, 0.4), (D2, "C-D", None, 0.6)],
                                   "outbound_date date, route string, weighted_contribution double, route_weight double")
    kept = rows(idx.index_daily(routes), "weighted_index", "available_weight", "price_index")
    assert kept == [(0.0, 0.4, 0.0), (50.0, 1.0, 50.0)]
    strict = rows(idx.index_daily(routes, strict_weights=True), "available_weight", "price_index")
    assert strict == [(0.0, None), (0.4, 125.0)]


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([(0.125,), (0.135,), (2769.805,), (2769.8050000000003,)], "x double")
    assert rows(df.select(C.half_even("x", 2))) == [(0.12,), (0.14,), (2769.8,), (2769.8,)]


@pytest.mark.parametrize("days,label,limited,lenient", [
    (-2, None, None, "0-3 days"), (-1, None, None, "0-3 days"), (0, "0-3 days", "0-3 days", "0-3 days"),
    (3, "0-3 days", "0-3 days", "0-3 days"), (4, "4-7 days", "4-7 days", "4-7 days"), (7, "4-7 days", "4-7 days", "4-7 days"),
    (14, "8-14 days", "8-14 days", "8-14 days"), (30, "15-30 days", "15-30 days", "15-30 days"),
    (60, "31-60 days", "31-60 days", "31-60 days"), (61, "60+ days", "60+ days", "60+ days"),
    (9999, "60+ days", "60+ days", "60+ days"), (10000, "60+ days", None, "60+ days"), (None, None, None, None),
])
def test_booking_windows(spark, days, label, limited, lenient):
    df = spark.createDataFrame([(days, "")], "advance_purchase_days int, booking_window string")
    out = df.select(C.booking_window("advance_purchase_days"), C.booking_window("advance_purchase_days", 9999),
                    agg.lenient_window(df))
    assert rows(out) == [(label, limited, lenient)]


def test_existing_label_wins_in_lenient_form(spark):
    df = spark.createDataFrame([(1, "60+ days")], "advance_purchase_days int, booking_window string")
    assert rows(df.select(agg.lenient_window(df))) == [("60+ days",)]


def test_fare_bands(spark):
    df = spark.createDataFrame([(x,) for x in (3000.0, 3000.01, 15000.0, 20000.0, 25000.01, 0.0)], "price double")
    seven = [r[0] for r in rows(feat.fare_features(df), "fare_band")]
    assert seven == ["0-3000", "3001-5000", "10001-15000", "15001-25000", "25000+", None]
    six = [r[0] for r in rows(feat.fare_features(df.withColumnRenamed("price", "total_fare"), True), "fare_band")]
    assert six == ["0-3000", "3001-5000", "10001-15000", "15000+", "15000+", None]


def test_calendar(spark):
    df = spark.createDataFrame([(DAY(2024, 12, 30), TS(2024, 12, 1, 23, 5)), (DAY(2023, 1, 1), None)],
                               "outbound_date date, collection_timestamp timestamp")
    got = rows(feat.time_features(df), "travel_week", "travel_day_of_week", "is_weekend", "travel_day_name",
               "travel_month_name", "collection_hour")
    assert got == [(1, 0, False, "Monday", "December", 23), (52, 6, True, "Sunday", "January", None)]
    keys = df.select(C.week_start("outbound_date"), C.month_key("outbound_date"), C.month_start("outbound_date"))
    assert rows(keys)[1] == (DAY(2022, 12, 26), "2023-01", DAY(2023, 1, 1))


def test_lead_days_are_floored_and_null_safe(spark):
    df = spark.createDataFrame([(D2, TS(2024, 1, 5, 23)), (D1, TS(2024, 1, 9)), (None, TS(2024, 1, 9)), (D1, None)],
                               "outbound_date date, collection_timestamp timestamp")
    assert [r[0] for r in rows(feat.advance_days(df), "advance_purchase_days")] == [1, 0, None, None]


def test_text_rules(spark):
    df = spark.createDataFrame([("\t a  b\n",), (None,), ("",)], "airline string")
    assert rows(df.select(C.squash_text("airline"), C.text_or_empty("airline"))) == [("a b", "a b"), (None, ""), ("", "")]
    assert rows(clean.normalize_airlines(df.filter("airline is null or airline = ''"))) == [("UNKNOWN",), ("UNKNOWN",)]
    routes = spark.createDataFrame([(" del-bom ",), ("DEL",), (None,)], "route string")
    assert rows(clean.parse_route(routes), "route_origin", "route_destination") == [("DEL", "BOM"), ("DEL", ""), ("", "")]


def test_keep_last_is_total_and_nulls_are_equal(spark):
    data = [(1, None, "a", 1), (1, None, "b", 2), (1, "x", "c", 1), (1, "x", "d", 1)]
    df = spark.createDataFrame(data, "k int, n string, v string, t int")
    for parts in (1, 3):
        got = sorted(rows(ident.keep_last(df.repartition(parts), ["k", "n"], ["t"])), key=str)
        assert got == [(1, "x", "d", 1), (1, None, "b", 2)]
    assert sorted(rows(ident.keep_first(df, ["k", "n"], ["t"])), key=str) == [(1, "x", "c", 1), (1, None, "a", 1)]


def test_record_id_treats_missing_as_empty_and_depends_on_the_day(spark):
    data = [("1", TS(2024, 1, 5, 1), "A", None), ("1", TS(2024, 1, 5, 9), "A", ""), ("1", TS(2024, 1, 6, 1), "A", "")]
    df = spark.createDataFrame(data, "search_id string, collection_timestamp timestamp, origin string, airline string")
    ids = [r[0] for r in rows(ident.record_id(df), "record_id")]
    assert ids[0] == ids[1] != ids[2] and len(ids[0]) == 64
    assert ident.dedup_observations(df).count() == 3  # null and empty differ as duplicate keys


def test_fingerprint_ignores_time_but_not_price(spark):
    schema = ", ".join(f"{c} string" for c in ident.FINGERPRINT_FIELDS) + ", collection_timestamp string"
    base = ["DEL", "BOM", "2024-01-05", None, "A", "AI-1", "8", "9", "60", "0", "Y", "100.0", "INR", "s", "e"]
    dear = [*base]
    dear[ident.FINGERPRINT_FIELDS.index("total_fare")] = "101.0"
    df = spark.createDataFrame([(*base, "t1"), (*base, "t2"), (*dear, "t3")], schema)
    ids = [r[0] for r in rows(ident.record_fingerprint(df), "record_id")]
    assert ids[0] == ids[1] != ids[2]
    kept = ident.dedup_response(df, ["collection_timestamp"])
    assert sorted(r[0] for r in rows(kept, "collection_timestamp")) == ["t1", "t3"]


def test_snapshot_hash_ignores_the_calculation_time(spark):
    df = spark.createDataFrame([("a", 1.0, "t1"), ("a", 1.0, "t2"), ("a", 2.0, "t1")], "route string, v double, calculated_at string")
    h = [r[0] for r in rows(ident.index_snapshot_hash(df), "snapshot_hash")]
    assert h[0] == h[1] != h[2]


def test_validation_reports_what_it_drops(spark):
    from pyspark.sql import Observation

    report = Observation()
    df = fares(spark, [("A-B", D1, "X", 1.0), (None, D1, "X", 1.0), ("A-B", None, "X", 1.0), ("A-B", D1, "X", -1.0), ("A-B", D1, "X", None)])
    assert clean.validate_dataset(df, report).count() == 1
    assert report.get == {"rows": 5, "excluded": 4}
    with pytest.raises(ValueError, match="outbound_date, route"):
        clean.validate_dataset(df.select("total_fare"))


def test_handle_missing_imputes(spark):
    df = spark.createDataFrame(
        [("1", "A", 10.0, None, None, ""), ("2", "B", 30.0, 2.0, 5.0, None), ("3", "C", None, 1.0, 1.0, "USD"), ("4", None, 50.0, 1.0, 1.0, "USD")],
        "record_id string, airline string, duration_minutes double, stops double, advance_purchase_days double, currency string")
    got = sorted(rows(clean.handle_missing(df)))
    assert got == [("1", "A", 10.0, 0, 0, "INR"), ("2", "B", 30.0, 2, 5, "INR"), ("3", "C", 20.0, 1, 1, "USD")]


def test_outliers_of_small_and_constant_routes(spark):
    data = [("A-B", D1, "X", v) for v in (1.0, 1.0, 100.0)] + [("C-D", D1, "X", v) for v in (5.0, 5.0, 5.0, 5.0, 5.0, 9.0)]
    data += [(None, D1, "X", v) for v in (1.0, 2.0, 3.0, 4.0, 50.0)] + [("C-D", D1, "X", None)]
    live = {(r.route, r.total_fare) for r in market.outlier_route_iqr(fares(spark, data)).collect() if r.fare_outlier}
    assert live == {("C-D", 9.0), (None, 50.0)}
    guarded = market.outlier_route_iqr(fares(spark, data), min_group=4, skip_zero_iqr=True)
    assert guarded.count() == len(data)
    assert {(r.route, r.total_fare) for r in guarded.collect() if r.fare_outlier} == {(None, 50.0)}


def test_global_outliers_start_at_zero(spark):
    data = [("A-B", D1, "X", v) for v in (1.0, 2.0, 3.0, 4.0, 100.0, None)]
    flags = [r.fare_outlier for r in market.outlier_global_iqr(fares(spark, data)).orderBy("total_fare").collect()]
    assert flags == [False, False, False, False, False, True]


def test_market_features_leave_null_routes_bare(spark):
    df = fares(spark, [("A-B", D1, "X", 10.0), ("A-B", D1, "Y", 30.0), (None, D1, "X", 5.0)])
    got = sorted(rows(market.market_features(df), "route", "total_fare", "route_average_fare", "fare_vs_route_average_pct",
                      "route_airline_count", "route_observation_count"), key=str)
    assert got == [("A-B", 10.0, 20.0, -50.0, 2, 2), ("A-B", 30.0, 20.0, 50.0, 2, 2), (None, 5.0, None, None, None, None)]


def test_weights_are_checked(spark):
    for bad in ({}, {"A-B": -1.0}, {"A-B": 0.0}):
        with pytest.raises(ValueError):
            idx.weights_table(spark, bad)
    assert sorted(rows(idx.weights_table(spark, {" a-b ": 1.0, "C-D": 3.0}))) == [("A-B", 0.25), ("C-D", 0.75)]
    table = spark.createDataFrame([("a-b", 1.0), ("C-D", -0.5)], "route string, weight double")
    with pytest.raises(PySparkException):
        idx.normalize_weights(table).collect()
    assert sum(r.weight for r in idx.weights_table(spark, fixed.DEFAULT_ROUTE_WEIGHTS).collect()) == pytest.approx(1)


def _series(spark, values):
    return spark.createDataFrame([(DAY(2024, 1, i + 1), x) for i, x in enumerate(values)], "date date, value double")


@pytest.mark.parametrize("a,b,expected", [
    ([100.0, 110.0, 99.0], [100.0, 100.0, 100.0], (3.6667, 5.8023, 3.6667, None, 0.0)),
    ([1.0], [2.0], (1.0, 1.0, 50.0, None, None)),
    ([1.0, 2.0], [0.0, 4.0], (1.5, 1.5811, 50.0, 1.0, None)),
    ([1.0, 2.0, 4.0], [2.0, 3.0, 2.0], (1.3333, 1.4142, 61.1111, -0.189, 50.0)),
    ([], [], (None,) * 5),
])
def test_backtest_metrics(spark, a, b, expected):
    got = rows(idx.backtest_metrics(_series(spark, a), _series(spark, b)))[0]
    assert got == expected


def test_backtest_needs_two_dates(spark):
    one = fares(spark, [("A-B", D1, "X", 10.0)])
    two = fares(spark, [("A-B", D1, "X", 10.0), ("A-B", D2, "X", 11.0), ("C-D", D2, "X", 9.0)])
    assert idx.backtest_series(one, {"A-B": 1.0}).count() == 0
    got = rows(idx.backtest_series(two, {"A-B": 1.0}), "outbound_date", "price_index", "route_count")
    assert got == [(D1, 100.0, 1), (D2, 110.0, 1)]


def test_trend_signal_and_latest(spark):
    trend = spark.createDataFrame([(D1, 100.0), (D2, 103.0), (D3, 112.0), (DAY(2024, 1, 9), 90.0)], "date date, price_index double")
    got = rows(idx.market_signal(trend), "signal", "direction", "meter_pct")
    assert got == [("STABLE", "STABLE", 37.5), ("RISING", "RISING", 45.0), ("ELEVATED", "RISING", 67.5), ("BELOW BASE", "EASING", 12.5)]
    latest = idx.index_latest(trend, "date").collect()[0]
    assert (latest.price_index, latest.previous, latest.minimum, latest.maximum) == (90.0, 112.0, 90.0, 112.0)
    first = idx.index_latest(trend.limit(1), "date").collect()[0]
    assert (first.previous, first.change_pct) == (None, 0.0)


def test_route_status(spark):
    df = spark.createDataFrame([(15.0, 1.0), (14.9, 10000.0), (None, None)], "volatility_pct double, average_fare double")
    assert [r.status for r in idx.route_status(df).collect()] == ["HIGH VOLATILITY", "HIGH FARE", "NORMAL"]


def test_booking_premium(spark):
    df = spark.createDataFrame([("0-3 days", 30.0), ("15-30 days", 20.0), ("31-60 days", 10.0)], "booking_window string, average_fare double")
    assert rows(agg.booking_premium(df)) == [(10.0, 30.0, 200.0)]


def _listing(spark, n):
    data = [(str(i).zfill(4), "A-B" if i % 2 else "c-d", "Air", TS(2024, 1, 1, 0, i % 7, i % 60), D1, float(i)) for i in range(n)]
    return spark.createDataFrame(data, "record_id string, route string, airline string, collection_timestamp timestamp, outbound_date date, total_fare double")


def test_flights_query_limits_and_case(spark):
    df = _listing(spark, 30)
    assert serving.flights_query(df, "a-b", "AIR").count() == 15
    assert serving.flights_query(df, "all", None, 0).count() == 1
    assert serving.flights_query(df, limit=5000).count() == 30


@pytest.mark.parametrize("page,size", [(1, 7), (3, 7), (5, 7), (99, 7), (0, 7), (1, 100)])
def test_pages_equal_slices_of_the_full_order(spark, page, size):
    df = _listing(spark, 33)
    everything = [r.record_id for r in df.orderBy(*serving._newest_first(df)).collect()]
    last = -(-33 // size)
    start = (min(max(page, 1), last) - 1) * size
    assert [r.record_id for r in serving.paginate(df, page, size).collect()] == everything[start:start + size]


def test_filters_and_search(spark):
    df = _listing(spark, 10).withColumn("advance_purchase_days", F.col("total_fare").cast("int"))
    assert serving.filter_observations(df, origin="A", destination="ALL", window="0-3 days").count() == 2
    assert serving.filter_observations(df, travel_date="2024-01-05", airline="AIR").count() == 10
    assert serving.text_search(df, "  B AIR ", ["route", "airline"]).count() == 5


def test_quality_counts(spark):
    data = [("1", "A-B", "X", D1, -1.0, None), ("1", "A-B", None, D1, None, True), (None, "C-D", "", None, 5.0, False)]
    df = spark.createDataFrame(data, "record_id string, route string, airline string, outbound_date date, total_fare double, fare_outlier boolean")
    assert rows(quality.quality_report(df)) == [(3, 6, 1, 1, 1, 1, 2, 2)]
    assert rows(quality.quality_summary(df)) == [(3, 1, 1, 1, 1, 2, 2, round(13 / 18 * 100, 2))]
    stamped = df.withColumn("collection_timestamp", F.lit(None).cast("timestamp"))
    assert rows(quality.quality_filtered(stamped)) == [(3, 0, 1, 1, pytest.approx(8 / 15 * 100, abs=1e-6))]
    assert rows(quality.quality_filtered(stamped.limit(0))) == [(0, 0, 0, 0, 0.0)]


def test_summary_falls_back_to_the_trend_and_to_the_base(spark):
    df = fares(spark, [("A-B", D1, "X", 10.0), ("A-B", D2, "Y", 12.0)])
    got = quality.fare_summary(df).collect()[0]
    assert (got.price_index, got.price_index_change, got.routes, got.airlines, got.travel_dates) == (120.0, 20.0, 1, 2, 2)
    empty = quality.fare_summary(df.limit(0)).collect()[0]
    assert (empty.price_index, empty.price_index_change, empty.average_fare, empty.observations) == (100.0, 0.0, 0.0, 0)


def test_directory_and_lookup(spark):
    routes = spark.createDataFrame([("DEL-BOM", 10.0), ("BOM-XXX", 20.0), ("DEL", 30.0)], "route string, average_fare double")
    got = rows(air.airport_directory(routes, air.airport_master(spark)), "code", "city", "name", "state", "origin_routes",
               "destination_routes", "routes", "average_fare")
    assert got == [
        ("BOM", "Mumbai", "Chhatrapati Shivaji Maharaj International Airport", "Maharashtra", 1, 1, 2, 15.0),
        ("DEL", "Delhi", "Indira Gandhi International Airport", "Delhi", 2, 0, 2, 20.0),
        ("XXX", "XXX", "XXX Airport", "—", 0, 1, 1, 20.0)]
    assert rows(air.airport_totals(routes)) == [(3, 2, 2, 3)]
    linked = air.connected_airports(air.airport_master(spark), routes).filter("connected")
    assert sorted(r.code for r in linked.collect()) == ["BOM", "DEL"]


def test_spine_rejects_malformed_routes(spark):
    texts = spark.createDataFrame([(" del-bom ,DELBOM, A-B-C,-X,blr-blr,del-bom,",)], "routes string")
    got = rows(col.search_spine(texts, F.lit("2024-01-30"), 3, 2).orderBy("outbound_date"))
    days = [(DAY(2024, 1, 30), DAY(2024, 2, 1)), (DAY(2024, 1, 31), DAY(2024, 2, 2)), (DAY(2024, 2, 1), DAY(2024, 2, 3))]
    assert got == [("DEL", "BOM", *d) for d in days for _ in range(2)]


BODIES = {
    1: '{"best_flights":null,"other_flights":[{"price":100.125,"total_duration":95,"extensions":["Sold  OUT","x"],"flights":['
       '{"airline":" Air  X ","flight_number":"ax 1","travel_class":"Economy","departure_airport":{"id":"del","time":"8"},'
       '"arrival_airport":{"id":"hyd","time":"9"}},{"flight_number":"","arrival_airport":{"time":"11"}}]}]}',
    2: '{"best_flights":[{"price":0,"flights":[{}]},{"price":-5,"flights":[{}]},{"price":"abc","flights":[{}]},'
       '{"price":null,"flights":[{}]},{"price":50,"flights":[]},{"price":50},{"price":"7","extensions":"No seats left","flights":[{}]}]}',
    3: "not json",
    4: None,
}


def test_flattening_of_awkward_responses(spark):
    data = [(i, "bom", "maa", "2024-01-10", None, "inr", "2024-01-05 10:00:00", b) for i, b in BODIES.items()]
    from fareloom import schema

    got = col.flatten_responses(spark.createDataFrame(data, schema.LANDED), "s", "e").orderBy("search_id").collect()
    assert [r.search_id for r in got] == [1, 2]
    a, b = got
    assert (a.departure_airport, a.arrival_airport, a.route, a.airline) == ("DEL", "MAA", "DEL-MAA", "Air X")
    assert (a.flight_numbers, a.stops, a.duration_minutes, a.total_fare) == (["AX 1"], 1, 95, 100.12)
    assert (a.sold_out, a.availability_details, a.advance_purchase_days, a.currency) == (True, ["Sold OUT", "x"], 5, "INR")
    assert (b.departure_airport, b.arrival_airport, b.airline, b.total_fare, b.stops) == ("BOM", "MAA", "", 7.0, 0)
    assert (b.sold_out, b.availability_details, b.duration_minutes) == (True, ["No seats left"], None)


def test_search_index_base_rules(spark):
    df = spark.createDataFrame([("DEL", "BOM", D1, "INR", 3, 90.0), ("DEL", "BOM", D1, "INR", 3, 110.0)],
                               "departure_airport string, arrival_airport string, outbound_date date, currency string, advance_purchase_days int, total_fare double")
    assert rows(col.search_index(df, 50.0), "index_value", "base_fare", "sample_size") == [(200.0, 50.0, 2)]
    assert rows(col.search_index(df), "index_value", "base_fare") == [(100.0, 100.0)]
    assert col.search_index(df, -1.0).count() == 0


def test_missing_columns_fall_back(spark):
    df = fares(spark, [("A-B", D1, "X", 10.0)]).drop("airline")
    assert rows(agg.daily_fare(df), "airlines") == [(1,)]
    assert sorted(agg.all_aggregations(df)) == ["daily", "index_input", "monthly", "route", "weekly"]
