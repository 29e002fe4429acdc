"""One roll-up against the tables made from observations, positions without a single task, bounded quantiles."""
import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fareloom.functions import columns as C
from fareloom.operators import aggregates as agg, ordering, price_index as idx, quality, serving, stats
from fareloom.operators.rollup import RollUp, partials
from fareloom.plans import analytics, dashboard
from fareloom.session import materialise
from tests.helpers import rows
from tests.test_plans import plan


def observed(spark, n=900, seed=1):
    """Observations with null keys, missing and unsound fares, one hot route and many equal fares."""
    rng = random.Random(seed)
    data = []
    for i in range(n):
        route = rng.choice(["A-B", "A-B", "A-B", "B-C", "C-A", None])
        fare = rng.choice([None, float("nan"), 4000.0, 4000.0, rng.uniform(1, 60000), rng.uniform(900, 1100)])
        when = dt.date(2024, rng.choice([1, 1, 2, 12]), rng.randint(1, 28)) if rng.random() > 0.05 else None
        data.append((route, when, rng.choice(["x", "y", "z", None]), fare, rng.choice([-3, 2, 5, 20, 90, None]),
                     rng.choice([True, False, None]), rng.choice([60.0, 90.0, None]), rng.choice([0, 1, None]),
                     dt.datetime(2023, 12, 1, rng.randint(0, 23), rng.randint(0, 59)), str(i)))
    return spark.createDataFrame(data, (
        "route string, outbound_date date, airline string, total_fare double, advance_purchase_days int, is_weekend boolean, "
        "total_duration_minutes double, stops int, collection_timestamp timestamp, record_id string")).repartition(5)


DIMS = ["route", "outbound_date", "airline", "booking_window", "is_weekend", "fare_bucket"]
GRAINS = [["outbound_date", "route"], ["week_start", "route"], ["month", "route"], ["route"], ["route", "airline"], ["airline"],
          ["route", "booking_window"], ["booking_window"], ["route", "is_weekend"], ["outbound_date"]]


def ready(df):
    return df.withColumns({"booking_window": C.booking_window("advance_purchase_days"), "fare_bucket": agg.fare_bucket()})


def rolled(df, **more):
    return RollUp(ready(df), DIMS, GRAINS, derived=agg.periods(), means=["total_duration_minutes", "stops"],
                  distinct=["airline", "route"], latest="collection_timestamp", **more)


def same(a, b):
    assert a.columns == b.columns
    a, b = sorted(map(repr, rows(a))), sorted(map(repr, rows(b)))
    assert a == b


def test_every_table_equals_the_one_from_observations(spark):
    df = materialise(observed(spark))
    roll = rolled(df)
    for make in (agg.daily_fare, agg.weekly_fare, agg.monthly_fare, agg.route_analysis):
        for detailed in ([False] if make is agg.route_analysis else [False, True]):
            same(make(roll, detailed), make(df, detailed))
    for make in (agg.airline_analysis, agg.airline_summary, agg.booking_window_by_route, agg.booking_window_summary,
                 agg.weekday_weekend, agg.fare_distribution, agg.index_input):
        same(make(roll), make(df))
    same(agg.route_summary(roll, True), agg.route_summary(df, True))
    sound = df.withColumn("total_fare", C.finite("total_fare"))
    same(idx.index_daily(idx.index_route_daily(roll, {"A-B": 1.0, "B-C": 2.0})), idx.index_daily(idx.index_route_daily(sound, {"A-B": 1.0, "B-C": 2.0})))
    index = idx.trend_simple(sound).withColumnRenamed("date", "outbound_date")
    same(idx.trend_simple(roll), idx.trend_simple(sound))
    same(quality.fare_summary(roll, index), quality.fare_summary(sound, index))


def test_partials_of_two_tables_make_the_roll_up_of_both(spark):
    a, b = materialise(observed(spark, 300, 4)), materialise(observed(spark, 200, 5))
    parts = [partials(ready(x), DIMS, means=["total_duration_minutes", "stops"], latest="collection_timestamp") for x in (a, b)]
    united = rolled(a.union(b), parts=materialise(parts[0].unionByName(parts[1])))
    whole = materialise(a.union(b))
    same(agg.daily_fare(united, True), agg.daily_fare(whole, True))
    same(agg.airline_summary(united), agg.airline_summary(whole))


def test_empty_and_all_missing(spark):
    df = observed(spark, 40)
    for part in (df.filter("false"), df.withColumn("total_fare", F.lit(None).cast("double"))):
        part = materialise(part)
        same(agg.route_analysis(rolled(part)), agg.route_analysis(part))


def scans(monkeypatch, path, job):
    """How many executed plans read the table at `path`, by their file scans."""
    from pyspark.sql import DataFrame, DataFrameWriter
    seen = []

    def note(df):
        seen.append(plan(df).count(f"Location: InMemoryFileIndex [file:{path}"))

    for kind, name in ((DataFrameWriter, "parquet"), (DataFrameWriter, "csv")):
        monkeypatch.setattr(kind, name, lambda self, *a, f=getattr(kind, name), **k: (note(self._df), f(self, *a, **k))[1])
    for name in ("collect", "first", "isEmpty"):
        monkeypatch.setattr(DataFrame, name, lambda self, *a, f=getattr(DataFrame, name), **k: (note(self), f(self, *a, **k))[1])
    job()
    monkeypatch.undo()
    return sum(seen)


def test_two_scans_for_all_result_tables(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "observations")
    data = observed(spark).withColumnRenamed("record_id", "id").withColumn("total_fare", C.finite("total_fare"))
    data.write.parquet(path)
    table = spark.read.parquet(path)
    assert scans(monkeypatch, path, lambda: analytics.run_analytics(table, str(tmp_path / "out"), {"A-B": 1.0})) == 2

    def all_of_them():
        for made in agg.all_aggregations(table.withColumn("booking_window_category", C.booking_window("advance_purchase_days"))).values():
            made.collect()

    assert scans(monkeypatch, path, all_of_them) == 2


def test_no_distinct_count_above_the_observations(spark, tmp_path, monkeypatch):
    df = observed(spark)
    roll = rolled(df)
    text = plan(agg.daily_fare(roll, True)) + plan(agg.airline_summary(roll))
    assert "distinct" not in text.lower().replace("distinct-", "") and "Expand" not in text


def test_dashboard_panels(spark):
    df = materialise(observed(spark).withColumn("total_fare", C.finite("total_fare")).withColumn("fare_outlier", F.lit(False)))
    made = dashboard.dashboard_bundle(df)
    same(made["routes"], agg.route_summary(df, detailed=True, top=25))
    same(made["airlines"], agg.airline_summary(df))


def test_positions_ranks_and_predecessors(spark):
    rng = random.Random(2)
    data = [(rng.randint(0, 40) if rng.random() > 0.1 else None, i) for i in range(700)]
    df = spark.createDataFrame(data, "v int, id int").repartition(6)
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = {r.id: r.position for r in ordering.numbered(df, [F.col("v").asc_nulls_first(), "id"]).collect()}
    assert got == {r[1]: k for k, r in enumerate(order)}
    before = {r.id: r.b for r in ordering.with_previous(df, [F.col("v").asc_nulls_first(), "id"], {"b": "id"}).collect()}
    assert before == {r[1]: order[k - 1][1] if k else None for k, r in enumerate(order)}
    known = sorted({r[0] for r in data if r[0] is not None}, reverse=True)
    ranks = {r.id: r.r for r in ordering.dense_ranks(df.dropna(), -F.col("v"), "r").collect()}
    assert ranks == {i: known.index(x) + 1 for x, i in data if x is not None}
    sums = {r.id: r.s for r in ordering.numbered_sums(df.dropna(), ["v", "id"], "v", "s").collect()}
    rest = [r for r in order if r[0] is not None]
    assert sums == {r[1]: sum(x for x, _ in rest[:k]) for k, r in enumerate(rest)}
    empty = df.filter("false")
    assert ordering.numbered(empty, ["v"]).collect() == [] and ordering.dense_ranks(empty, F.col("v"), "r").collect() == []


def test_no_single_task_in_positions(spark):
    df = observed(spark)
    for made in (ordering.numbered(df, ["collection_timestamp", "record_id"]),
                 agg.dense_rank_fare(materialise(agg.route_summary(df))),
                 idx.index_changes(materialise(idx.trend_simple(df)), order="date"), serving.paginate(df, 3)):
        text = plan(made)
        assert "SinglePartition" not in text


def test_pages_of_one_minute(spark):
    data = [(dt.datetime(2024, 1, 1, 0, 0, i % 60) if i % 5 else None, f"{i:04}") for i in range(400)]
    df = spark.createDataFrame(data, "collection_timestamp timestamp, record_id string").repartition(4)
    order = sorted((r for r in data if r[0]), key=lambda r: (-r[0].timestamp(), r[1])) + sorted(r for r in data if not r[0])
    for page in (1, 2, 20, 27, 999):
        start = (min(page, 27) - 1) * 15
        got = [(r.position, r.record_id) for r in serving.paginate(df, page).collect()]
        assert got == [(start + k + 1, r[1]) for k, r in enumerate(order[start:start + 15])]
    assert serving.paginate(df.filter("false"), 2).collect() == []


PROBS = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.999, "e": 1.0}


@pytest.mark.parametrize("limit", [3, 50, 10 ** 6])
def test_quantiles_of_large_buckets(spark, limit):
    """Buckets far above the bound: close values, values of very different gaps, and one value over and over."""
    rng = np.random.default_rng(9)
    close = 1000 + rng.random(3000) * 0.001
    uneven = 1000 + np.concatenate([[0, 100], 2.0 ** -rng.integers(10, 40, 2000)])
    frame = pd.concat([pd.DataFrame({"k": k, "x": x}) for k, x in (("close", close), ("uneven", uneven), ("one", np.full(500, 7.0)))])
    got = stats.exact_quantiles(spark.createDataFrame(frame).repartition(4), ["k"], "x", PROBS, limit).toPandas().set_index("k")
    for k, x in frame.groupby("k")["x"]:
        assert list(got.loc[k]) == pytest.approx(list(np.quantile(x, list(PROBS.values()))), rel=1e-14)


def test_no_task_ranks_more_than_the_bound(spark):
    """A million distinct doubles within one bucket: what is ranked last stays below the bound."""
    df = spark.range(1_000_000).select((F.lit(1000.0) + F.col("id") / 1e5).alias("x"))
    plain = stats.exact_quantiles(df, [], "x", {"m": 0.5, "q": 0.9}, limit=20_000)
    row = plain.first()
    assert (row.m, row.q) == pytest.approx((1000 + 499_999.5 / 1e5, 1000 + 899_999.1 / 1e5), rel=1e-13)
    ranked, limit = [], 20_000
    met = stats._meet
    try:
        stats._meet = lambda r, t, n: ranked.append(t.agg(F.max("_n")).first()[0]) or met(r, t, n)
        stats.exact_quantiles(df, [], "x", {"m": 0.5, "q": 0.9}, limit=limit).collect()
    finally:
        stats._meet = met
    assert ranked[-1] <= limit < ranked[0]
