"""Layout by month, versions behind a pointer, stored join order, rejected files, results that follow batches."""
import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fareloom import schema
from fareloom.operators import aggregates as agg, collection as col, joins, price_index as idx, serving
from fareloom.plans import analytics, dataset, incremental
from fareloom.sources import readers, versions, writers
from fareloom.streaming.ingest import ingest_stream, run_summary
from tests.helpers import DAY, TS, rows
from tests.test_plans import plan
from tests.test_storage import _observed


@pytest.fixture()
def laid_out(spark, tmp_path):
    data = [(f"{i}", "A-B" if i % 3 else "B-A", f"C{i % 2}", DAY(2024, 1 + i % 12, 1 + i % 28), 4000.0 + i,
             TS(2023, 12, 1, i % 24), i % 70 if i % 11 else None) for i in range(400)]
    data.append(("x", "A-B", "C0", None, 1.0, None, None))
    df = spark.createDataFrame(data, "record_id string, route string, airline string, outbound_date date, total_fare double, "
                               "collection_timestamp timestamp, advance_purchase_days int")
    path = str(tmp_path / "laid_out")
    writers.write_laid_out(df, path)
    return df, spark.read.parquet(path)


def test_filters_leave_out_months(laid_out):
    df, table = laid_out
    one = serving.filter_observations(table, travel_date="2024-03-03")
    text = plan(one)
    assert "travel_month_key" in text.split("PartitionFilters: ")[1].split("\n")[0] and "2024-03" in text
    assert "EqualTo(outbound_date,2024-03-03)" in text
    assert sorted(rows(one, "record_id")) == sorted(rows(df.filter("outbound_date = '2024-03-03'"), "record_id"))
    few = serving.flights_query(table, "a-b", limit=1000, travel=("2024-02-05", "2024-04-20"))
    assert "travel_month_key" in plan(few).split("PartitionFilters: ")[1].split("\n")[0]
    assert sorted(rows(few, "record_id")) == sorted(rows(df.filter(
        "route = 'A-B' AND outbound_date BETWEEN '2024-02-05' AND '2024-04-20'"), "record_id"))


def test_lead_is_a_pushed_range(laid_out):
    df, table = laid_out
    text = plan(serving.filter_observations(table, window="15-30 days"))
    assert "GreaterThan(advance_purchase_days,14)" in text and "LessThanOrEqual(advance_purchase_days,30)" in text
    odd = df.withColumn("advance_purchase_days", F.col("advance_purchase_days") - 5)  # negative ones are nearest
    for label in [*serving.fixed.BOOKING_LABELS, "no such label"]:
        by_label = odd.filter(agg.lenient_window(odd) == label)
        assert sorted(rows(serving.filter_observations(odd, window=label), "record_id")) == sorted(rows(by_label, "record_id"))


def test_files_are_clustered(spark, laid_out, tmp_path):
    _, table = laid_out
    folders = {p.name for p in (tmp_path / "laid_out").glob("travel_month_key=*")}
    assert len(folders) == 13  # twelve months, and the rows without a travel date
    for path in (tmp_path / "laid_out" / "travel_month_key=2024-05").glob("*.parquet"):
        own = [r.route for r in spark.read.parquet(str(path)).collect()]
        assert own == sorted(own)


def test_write_dataset_lays_out_a_third_copy(spark, tmp_path):
    df = _observed(spark)
    dataset.write_dataset(df, str(tmp_path / "c"), str(tmp_path / "p"), str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).count() == df.count()


def test_stored_by_key_joins_without_an_exchange(spark, tmp_path):
    searches = spark.createDataFrame([(i, "INR", TS(2024, 1, 1), f"r{i}") for i in range(0, 60, 2)],
                                     "id long, currency string, searched_at timestamp, request_id string")
    options = spark.createDataFrame([(i, i % 70, 1.0) for i in range(300)], "id long, search_id long, price double")
    want = sorted(map(repr, rows(joins.join_search_metadata(searches, options))))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = writers.write_bucketed(searches, "t_searches", str(tmp_path / "a"), "id", 4)
        b = writers.write_bucketed(options, "t_options", str(tmp_path / "b"), "search_id", 4)
        found = joins.join_search_metadata(a, b)
        assert "Exchange" not in plan(found) and "SortMergeJoin" in plan(found)
        assert sorted(map(repr, rows(found))) == want
        assert "Exchange" in plan(joins.join_search_metadata(searches, options))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS t_searches")
        spark.sql("DROP TABLE IF EXISTS t_options")


def test_a_broken_write_leaves_the_former_version(spark, tmp_path):
    folder, df = str(tmp_path / "out"), spark.createDataFrame([(1, ["a"])], "i int, t array<string>")
    with pytest.raises(FileNotFoundError):
        versions.read_published(spark, folder, "x")
    first = versions.publish(spark, folder, {"x": df, "y": df})
    broken = df.select(F.raise_error(F.lit("broken off")).cast("int").alias("i"))
    with pytest.raises(Exception, match="broken off"):
        versions.publish(spark, folder, {"x": df.union(df), "y": broken})
    assert versions.current(spark, folder) == first and len(versions.versions(spark, folder)) == 2
    assert versions.read_published(spark, folder, "x").count() == 1
    reader = versions.read_published(spark, folder, "x")  # made before the switch, read after it
    second = versions.publish(spark, folder, {"x": df.union(df), "y": df.limit(0)})
    assert reader.count() == 1 and versions.read_published(spark, folder, "x").count() == 2
    assert versions.read_published(spark, folder, "x", first).count() == 1
    assert versions.read_published(spark, folder, "y").columns == ["i", "t"]
    text = Path(folder, "versions", second)
    assert (text / "x.csv").exists() and not (text / "y.csv").exists()
    third = versions.publish(spark, folder, {"x": df})
    gone = versions.drop_versions(spark, folder, keep=2)
    assert first in gone and versions.versions(spark, folder) == [second, third] and versions.current(spark, folder) == third
    assert versions.drop_versions(spark, folder, keep=1) == [second]


def test_all_result_tables_are_of_one_run(spark, tmp_path):
    df = _observed(spark)
    made = analytics.run_analytics(df, str(tmp_path), {"A-B": 1.0}, versioned=True)
    version = versions.current(spark, str(tmp_path))
    assert sorted(p.stem for p in (tmp_path / "versions" / version).glob("*.parquet")) == sorted(made)
    assert versions.read_published(spark, str(tmp_path), "index_daily").orderBy("outbound_date").first().price_index == 100.0


def test_manifest_keeps_records_without_date_or_route(spark):
    data = [(DAY(2024, 1, 5), "A-B", DAY(2024, 2, 1), "r1"), (None, "A-B", DAY(2024, 2, 1), "r2"),
            (DAY(2024, 1, 5), None, DAY(2024, 2, 1), "r3"), (DAY(2024, 1, 5), None, DAY(2024, 2, 1), "r3"), (DAY(2024, 1, 5), None, None, "r4")]
    df = spark.createDataFrame(data, "collection_date date, route string, outbound_date date, record_id string")
    got = sorted(map(repr, rows(col.run_manifest(df, df.filter("record_id IN ('r2', 'r4')")))))
    assert got == sorted(map(repr, [("A-B", DAY(2024, 2, 1), 2, 0, 1, 1), (None, DAY(2024, 2, 1), 2, 1, 1, 0), (None, None, 1, 0, 0, 1)]))


BODY = '{"best_flights":[{"price":%d,"flights":[{"airline":"%s","departure_airport":{"id":"del"},"arrival_airport":{"id":"bom"}}]}]}'


def land(folder, k, travel="2024-02-01", day="2024-01-05", price=100, airline="A"):
    record = {"search_id": k, "departure_airport": "del", "arrival_airport": "bom", "outbound_date": travel, "currency": "inr",
              "collected_at": f"{day} 10:00:00", "body": BODY % (price, airline)}
    (folder / f"{k}.json").write_text(json.dumps(record))


def test_rejected_files_are_stored_once_and_counted(spark, tmp_path):
    landing, folder = tmp_path / "landing", str(tmp_path / "store")
    landing.mkdir()
    land(landing, 1)
    (landing / "bad.json").write_text('{"search_id": 2, "body": ')
    (landing / "worse.json").write_text("not json at all")

    def run(name, checkpoint):
        ingest_stream(spark, str(landing), folder, str(tmp_path / checkpoint), "s", "e", files_per_batch=2, run_id=name).awaitTermination()
        return sorted(map(tuple, run_summary(spark, folder).select("run_id", "total_searches", "rejected_files").collect()))

    assert run("one", "c1") == [("one", 1, 2)]
    (landing / "late.json").write_text("[")
    assert run("two", "c1") == [("one", 1, 2), ("two", 0, 1)]  # only the new file
    assert run("three", "c2") == [("one", 1, 2), ("three", 1, 0), ("two", 0, 1)]  # a replay of everything
    (landing / "bad.json").write_text('{"search_id": 3, "body": ')  # another content in a known file
    os.utime(landing / "bad.json", (2_000_000_000, 2_000_000_000))
    run("four", "c3")
    stored = spark.read.parquet(f"{folder}/rejected")
    assert sorted(r.text for r in stored.collect()) == sorted(
        ['{"search_id": 2, "body": ', "not json at all", "[", '{"search_id": 3, "body": '])
    assert {r.file.rsplit("/", 1)[1] for r in stored.collect()} == {"bad.json", "worse.json", "late.json"}


def test_runs_over_one_checkpoint_are_told_apart(spark, tmp_path):
    landing, folder = tmp_path / "landing", str(tmp_path / "store")
    landing.mkdir()
    for k in range(2):
        land(landing, k)
        ingest_stream(spark, str(landing), folder, str(tmp_path / "c"), "s", "e").awaitTermination()
    got = run_summary(spark, folder)
    assert got.count() == 2 and [r.total_searches for r in got.collect()] == [1, 1]


def test_results_follow_batches_and_late_files(spark, tmp_path, monkeypatch):
    landing, folder = tmp_path / "landing", str(tmp_path / "store")
    landing.mkdir()
    touched = []
    from fareloom.streaming import ingest
    monkeypatch.setattr(ingest, "refresh", lambda s, o, f, months: (touched.append(months), incremental.refresh(s, o, f, months)))

    def run():
        ingest_stream(spark, str(landing), folder, str(tmp_path / "c"), "s", "e", results=f"{folder}/results").awaitTermination()
        observed = spark.read.parquet(f"{folder}/observations").select("route", "outbound_date", "airline", "total_fare")
        made, weights = incremental.results(spark, f"{folder}/results", {"DEL-BOM": 1.0}), {"DEL-BOM": 1.0}
        daily, monthly = agg.daily_fare(observed, True), agg.monthly_fare(observed, True)
        for a, b in ((made["daily_fare"], daily), (made["monthly_fare"], monthly), (made["index_daily"], idx.index_daily(idx.index_route_daily(observed, weights)))):
            shared = [c for c in b.columns if c in a.columns]
            assert len(shared) >= len(b.columns) and sorted(map(repr, rows(a, *shared))) == sorted(map(repr, rows(b, *shared)))
        return {str(p): p.stat().st_mtime_ns for p in Path(folder, "results", "daily").rglob("*.parquet")}

    for k, (travel, price) in enumerate([("2024-02-01", 100), ("2024-02-03", 120), ("2024-03-05", 90), ("2024-05-01", 80)]):
        land(landing, k, travel, price=price)
    before = run()
    land(landing, 10, "2024-03-05", price=190, airline="B")
    land(landing, 11, "2024-01-20", day="2024-01-02", price=50)  # a new first date: every base fare changes
    after = run()
    assert touched == [["2024-02", "2024-03", "2024-05"], ["2024-01", "2024-03"]]
    kept = set(before) & set(after)
    assert len(kept) >= 2 and all(before[x] == after[x] for x in kept)  # February and May were not written again
    land(landing, 12, "2024-03-05", price=190, airline="B")  # the same offer again
    run()
