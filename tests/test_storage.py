"""Readers, writers, whole builds and the stream on small files."""
import hashlib
import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fareloom import schema
from fareloom.plans import analytics, dashboard, dataset
from fareloom.session import shared_folder
from fareloom.sources import readers, writers
from fareloom.streaming.ingest import ingest_stream, observations_from, process_batch
from tests.helpers import DAY, TS, rows
from tests.test_semantics import BODIES

SEARCHES = """id,origin,destination,outbound_date,return_date,currency,searched_at,provider_id
1, del ,bom,2024-01-10,,INR,2024-01-05 10:00:00.709017,r1
1,DEL,BOM,2024-01-11,,INR,2024-01-06 10:00:00,r2
2,DEL,DEL,2024-01-10,,INR,2024-01-05 10:00:00,r3
x,DEL,BOM,2024-01-10,,INR,2024-01-05 10:00:00,r4
3,DEL,NA,2024-01-10,,INR,2024-01-05 10:00:00,r5
4,DEL,BOM,soon,,INR,2024-01-05 10:00:00,r6
"""
OPTIONS = """id,search_id,origin,destination,outbound_date,return_date,price,currency,total_duration_minutes,flight_type,airline,stops,carbon_emissions_kg,booking_token,collected_at
10,1,del,bom,2024-01-10,,100.0,inr,-5,Direct, Air  X ,-1,,t,2024-01-05 10:00:00
10,1,del,bom,2024-01-10,,100.0,inr,-5,Direct, Air  X ,-1,,t,2024-01-05 11:00:00
11,9,DEL,BOM,2024-01-10,,200.0,INR,60,Direct,Air Y,1,5,t,2024-01-05 10:00:00
12,1,DEL,BOM,2024-01-10,,0,INR,60,Direct,Air Y,1,5,t,2024-01-05 10:00:00
13,1,DEL,BOM,2024-01-10,,n/a,INR,60,Direct,Air Y,1,5,t,2024-01-05 10:00:00
14,1,DEL,BOM,2024-01-10,,50,INR,60,Direct,,1,5,t,2024-01-05 10:00:00
"""


@pytest.fixture()
def tables(spark, tmp_path):
    (tmp_path / "s.csv").write_text(SEARCHES)
    (tmp_path / "o.csv").write_text(OPTIONS)
    return (readers.read_searches(spark, str(tmp_path / "s.csv"), "provider_id"),
            readers.read_options(spark, str(tmp_path / "o.csv")))


def test_csv_readers(spark, tables, tmp_path):
    searches, options = tables
    assert rows(searches, "id", "origin", "destination", "outbound_date", "request_id") == [
        (1, "DEL", "BOM", DAY(2024, 1, 11), "r2")]
    got = sorted(rows(options, "id", "airline", "currency", "stops", "total_duration_minutes", "price"))
    assert got == [(10, "Air X", "INR", 0, None, 100.0)] * 2 + [(11, "Air Y", "INR", 1, 60.0, 200.0)]
    (tmp_path / "bad.csv").write_text("id,origin\n1,DEL\n")
    with pytest.raises(ValueError, match="currency, destination"):
        readers.read_searches(spark, str(tmp_path / "bad.csv"))


def test_build_dataset(tables):
    out = dataset.build_dataset(*tables, "provider", "engine")
    assert out.columns[:5] == ["record_id", "search_id", "origin", "destination", "route"]
    got = sorted(rows(out, "search_id", "collection_timestamp", "advance_purchase_days", "route_observation_count",
                      "search_currency", "fare_band", "source", "sold_out"))
    assert got == [(1, TS(2024, 1, 5, 11), 5, 2, "INR", "0-3000", "provider", None),
                   (9, TS(2024, 1, 5, 10), 5, 2, None, "0-3000", "provider", None)]


def test_processed_table_is_written_twice(spark, tables, tmp_path):
    out = dataset.build_dataset(*tables)
    dataset.write_dataset(out, str(tmp_path / "cleaned"), str(tmp_path / "processed"))
    back = readers.read_processed(spark, str(tmp_path / "processed" / "observations_processed.parquet"))
    assert back.columns == out.columns and back.count() == 2
    text = spark.read.option("header", True).csv(str(tmp_path / "cleaned" / "observations_cleaned.csv"))
    assert text.count() == 2


def test_json_reader_takes_objects_lists_and_skips_broken_files(spark, tmp_path):
    deep = tmp_path / "collection_date=2024-01-05"
    deep.mkdir()
    (tmp_path / "a.json").write_text(json.dumps({"record_id": "1", "price": 10.5}, indent=2))
    (deep / "b.json").write_text(json.dumps([{"record_id": "2", "sold_out": True}, {"record_id": "3"}], indent=2))
    (tmp_path / "c.json").write_text("{ broken")
    (tmp_path / "d.txt").write_text("{}")
    got = sorted(rows(readers.read_observations(spark, str(tmp_path)), "record_id", "price", "sold_out"))
    assert got == [("1", "10.5", None), ("2", None, True), ("3", None, None)]


def test_clean_dataset_drops_duplicates_before_bad_rows(spark):
    data = [("1", "2024-01-05 10:00:00", "del", "bom", "2024-01-10", "A", "10"),
            ("1", "2024-01-05 11:00:00", "del", "bom", "2024-01-10", "A", "-1"),
            ("2", "2024-01-05 12:00:00", " Del", "bom ", "2024-01-10", None, "20")]
    df = spark.createDataFrame(data, "record_id string, collection_timestamp string, departure_airport string, "
                               "arrival_airport string, outbound_date string, airline string, total_fare string")
    assert rows(dataset.clean_dataset(df), "record_id", "route", "airline", "total_fare") == [("2", "DEL-BOM", "UNKNOWN", 20.0)]


def test_missing_tables(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_processed(spark, str(tmp_path / "none"))
    empty = readers.read_processed(spark, str(tmp_path / "none"), required=False)
    assert empty.columns == schema.PROCESSED.names and empty.count() == 0


def test_dual_output_and_empty_result(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"]), (2, None)], "i int, t array<string>")
    assert writers.write_dual(df, str(tmp_path), "x") and not writers.write_dual(df.limit(0), str(tmp_path), "y")
    assert spark.read.parquet(str(tmp_path / "x.parquet")).count() == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "x.csv")).count() == 2
    assert not (tmp_path / "y.parquet").exists()


def test_append_is_idempotent_and_keeps_history(spark, tmp_path):
    data = [(DAY(2024, 1, 5), "A-B", DAY(2024, 1, 9), "r", 1.0)] * 3 + [(DAY(2024, 2, 6), "A-B", DAY(2024, 1, 9), "r", 1.0)]
    df = spark.createDataFrame(data, "collection_date date, route string, outbound_date date, record_id string, total_fare double")
    path = str(tmp_path / "t")
    assert writers.append_new(df.limit(3), path) == {"uploaded": 1, "skipped_duplicates": 2}
    assert writers.append_new(df, path) == {"uploaded": 1, "skipped_duplicates": 3}
    assert writers.append_new(df.repartition(3), path) == {"uploaded": 0, "skipped_duplicates": 4}
    assert sorted(p.name for p in (tmp_path / "t").glob("collection_month=*")) == ["collection_month=2024-01", "collection_month=2024-02"]
    assert spark.read.parquet(path).count() == 2


def _landed(spark, ids=BODIES):
    data = [(i, "bom", "maa", "2024-01-10", None, "inr", "2024-01-05 10:00:00", BODIES[i] or "{}") for i in ids]
    return spark.createDataFrame(data, schema.LANDED)


def test_batch_processing_stores_everything_once(spark, tmp_path):
    folder = str(tmp_path / "store")
    first = process_batch(_landed(spark), folder, "run-1", "s", "e")
    again = process_batch(_landed(spark), folder, "run-2", "s", "e")
    assert first == {"uploaded": 2, "skipped_duplicates": 0} and again == {"uploaded": 0, "skipped_duplicates": 2}
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    assert read("raw").count() == 3 + 1  # four bodies, all different
    assert read("index").count() == 2
    assert {r.route for r in read("index").collect()} == {"BOM-MAA"}  # the searched route
    assert "calculated_at" in read("index").columns
    runs = sorted(rows(read("runs").orderBy("run_id", "search_id"), "run_id", "search_id", "extracted", "new_records",
                       "skipped_existing", "index_generated", "raw_response_uploaded"))
    assert runs == [
        ("run-1", 1, 1, 1, 0, True, True), ("run-1", 2, 1, 1, 0, True, True), ("run-1", 3, 0, 0, 0, False, True),
        ("run-1", 4, 0, 0, 0, False, True), ("run-2", 1, 1, 0, 1, True, True), ("run-2", 2, 1, 0, 1, True, True),
        ("run-2", 3, 0, 0, 0, False, True), ("run-2", 4, 0, 0, 0, False, True)]
    again = process_batch(_landed(spark), folder, "run-2", "s", "e")
    assert again["uploaded"] == 0 and read("runs").count() == 8 and read("index").count() == 2


def test_intermediate_folders_are_removed(spark, tmp_path):
    from fareloom.session import shared_folder

    place = Path(shared_folder(spark).removeprefix("file:"))
    before = set(place.glob("*")) if place.exists() else set()
    process_batch(_landed(spark), str(tmp_path / "store"), "run", "s", "e")
    assert set(place.glob("*")) == before


def test_stored_tables_do_not_depend_on_batches(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    itinerary = '{"other_flights":[%s]}'
    flight = '{"price":%d,"flights":[{"airline":"A","departure_airport":{"id":"del"},"arrival_airport":{"id":"bom"}}]}'
    fares_of = {0: [100, 100, 120], 1: [300], 2: [], 3: [100, 50], 4: [300]}
    for k, prices in fares_of.items():
        day = "2024-01-05" if k in (0, 3) else f"2024-01-0{6 + k // 4}"
        body = itinerary % ",".join(flight % p for p in prices)
        record = {"search_id": k, "departure_airport": "del", "arrival_airport": "bom", "outbound_date": "2024-02-01",
                  "currency": "inr", "collected_at": f"{day} 1{k}:00:00", "body": body}
        (landing / f"{k}.json").write_text(json.dumps(record))
        os.utime(landing / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    (landing / "9.json").write_text('{"search_id": 9, "body": ')
    seen = []
    for files in (1, 3, 10):
        folder = tmp_path / f"store{files}"
        for _ in range(2):  # the second time with another checkpoint: everything is there already
            ingest_stream(spark, str(landing), str(folder), str(tmp_path / f"c{files}-{_}"), "s", "e", base_fare=100.0,
                          files_per_batch=files, run_id="run").awaitTermination()
        read = lambda n: spark.read.parquet(f"{folder}/{n}")
        seen.append((
            sorted(rows(read("observations"), "collection_date", "record_id", "total_fare")),
            sorted(rows(read("index"), "collection_date", "route", "outbound_date", "index_value", "sample_size")),
            sorted(map(repr, rows(read("runs"), "search_id", "collection_date", "route", "extracted", "duplicates_in_response",
                                  "new_records", "skipped_existing", "index_value", "raw_response_uploaded"))),
            read("raw").filter("body IS NULL").count(), read("raw").count()))
    assert seen[0] == seen[1] == seen[2]
    observations, index, runs, broken, raw = seen[0]
    assert [x[3] for x in index] == [75.0, 110.0, 300.0, 300.0] and len(runs) == 5 and broken == 0 and raw == 5
    counts = {r.search_id: (r.extracted, r.duplicates_in_response, r.new_records, r.skipped_existing)
              for r in spark.read.parquet(str(tmp_path / "store1/runs")).collect()}
    assert counts == {0: (3, 1, 2, 0), 1: (1, 0, 1, 0), 2: (0, 0, 0, 0), 3: (2, 0, 1, 1), 4: (1, 0, 1, 0)}


def test_rejected_files_are_listed(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"search_id": 1}')
    (tmp_path / "b.json").write_text("{ broken")
    landed = readers.read_landed(spark, str(tmp_path))
    assert [r.search_id for r in landed.collect()] == [1]
    rejects = readers.rejected_files(spark, str(tmp_path), fields=schema.LANDED).collect()
    assert [(r.file.rsplit("/", 1)[1], r.text) for r in rejects] == [("b.json", "{ broken")]


def test_append_without_a_date_is_idempotent(spark, tmp_path):
    data = [(None, "A-B", None, "r", 1.0), (DAY(2024, 1, 5), "A-B", None, "r", 1.0), (DAY(1970, 1, 1), None, DAY(2024, 1, 9), None, 1.0)]
    df = spark.createDataFrame(data, "collection_date date, route string, outbound_date date, record_id string, total_fare double")
    path = str(tmp_path / "t")
    for uploaded in (3, 0, 0):
        assert writers.append_new(df, path)["uploaded"] == uploaded
    assert writers.append_new(df.filter("collection_date IS NULL"), path)["uploaded"] == 0
    assert spark.read.parquet(path).count() == 3


def test_csv_round_trip_of_quotes_breaks_and_arrays(spark, tmp_path):
    texts = ['Air "X", Ltd', 'a\\b', '"', "two\nlines", "plain", "tab\there"]
    df = spark.createDataFrame([(i, t, [t, 'q"']) for i, t in enumerate(texts)], "i int, t string, a array<string>")
    writers.write_dual(df, str(tmp_path), "x")
    back = readers._csv(spark, str(tmp_path / "x.csv"), multi_line=True)
    got = {int(r.i): (r.t, r.a) for r in back.collect()}
    assert {i: t for i, (t, _) in got.items()} == dict(enumerate(texts))
    assert all(json.loads(a) == [texts[i], 'q"'] for i, (_, a) in got.items())
    (tmp_path / "o.csv").write_text(OPTIONS.replace("Air Y", '"Air ""X"", Ltd"', 1))
    assert 'Air "X", Ltd' in [r.airline for r in readers.read_options(spark, str(tmp_path / "o.csv")).collect()]


@pytest.mark.parametrize("batch", [1, 10])
def test_stream_equals_batch_in_any_batch_size_and_after_restart(spark, tmp_path, batch):
    landing, folder, progress = (tmp_path / n for n in ("landing", "store", "progress"))
    landing.mkdir()

    def run():
        ingest_stream(spark, str(landing), str(folder), str(progress), "s", "e", files_per_batch=batch).awaitTermination()
        return sorted(r.record_id for r in spark.read.parquet(f"{folder}/observations").collect())

    records = [r.asDict() for r in _landed(spark).collect()]
    for i in (0, 2):
        (landing / f"{i}.json").write_text(json.dumps(records[i], indent=2))
    part = run()
    (landing / "1.json").write_text(json.dumps([records[1], records[0]], indent=2))  # one new, one seen before
    whole = run()
    expected = sorted(r.record_id for r in observations_from(_landed(spark), "s", "e").collect())
    assert len(part) == 1 and whole == expected and run() == expected


def _observed(spark):
    data = [(f"{i}", "A-B" if i % 3 else "B-A", f"C{i % 2}", DAY(2024, 1, 1 + i % 4), 4000.0 + 900 * i,
             TS(2024, 1, 1, i % 24), i % 70, bool(i % 2), False, 60.0, 1) for i in range(24)]
    return spark.createDataFrame(data, "record_id string, route string, airline string, outbound_date date, total_fare double, "
                                 "collection_timestamp timestamp, advance_purchase_days int, is_weekend boolean, fare_outlier boolean, "
                                 "total_duration_minutes double, stops int")


def test_run_analytics_writes_thirteen_tables(spark, tmp_path):
    made = analytics.run_analytics(_observed(spark), str(tmp_path), {"A-B": 1.0})
    assert len(made) == 13
    found = sorted(p.stem for p in tmp_path.rglob("*.parquet") if p.is_dir())
    assert found == sorted(made)
    daily = spark.read.parquet(str(tmp_path / "index" / "index_daily.parquet"))
    assert daily.orderBy("outbound_date").first().price_index == 100.0


def test_dashboard_panels(spark):
    df = _observed(spark)
    full = dashboard.dashboard_bundle(df)
    assert full["distribution"].agg(F.sum("observations")).first()[0] == 24 and full["recent_flights"].count() == 15
    part = dashboard.filtered_dashboard(df, origin="A", airline="c1")
    rows_left = df.filter("route = 'A-B' and airline = 'C1'").count()
    assert part["summary"].first().observations == rows_left
    assert [r.route for r in part["routes"].collect()] == ["A-B"] and [r.airline for r in part["airlines"].collect()] == ["C1"]
    assert part["distribution"].count() == 7
    none = dashboard.filtered_dashboard(df, origin="Z")
    assert none["trend"].count() == 0 and none["quality"].first().records == 0


def _dated(spark, low, n, month):
    name = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    data = [(DAY(2024, month, 1 + i % 28), f"A{i % 40}-B", DAY(2024, 6, 1 + i % 28), name(i), float(i)) for i in range(low, low + n)]
    return spark.createDataFrame(data, "collection_date date, route string, outbound_date date, record_id string, total_fare double")


def test_known_keys_come_from_the_index(spark, tmp_path, monkeypatch):
    """What a batch reads: the hashes of its months, and the key columns of files that are new since the last batch."""
    path, read = str(tmp_path / "t"), []
    reader = type(spark.read)
    monkeypatch.setattr(reader, "parquet", lambda self, *p, f=reader.parquet, **k: (read.append(p), f(self, *p, **k))[1])
    for low in range(0, 8000, 2000):
        assert writers.append_new(_dated(spark, low, 2000, 1), path, indexed=True)["uploaded"] == 2000
    writers.append_new(_dated(spark, 0, 500, 2), path, indexed=True)
    assert writers.append_new(_dated(spark, 0, 8000, 1), path, indexed=True) == {"uploaded": 0, "skipped_duplicates": 8000}
    read.clear()
    assert writers.append_new(_dated(spark, 100, 50, 1), path, indexed=True)["uploaded"] == 0
    assert not [p for p in read if any(x.endswith(".parquet") and "/t/" in x for x in p)]  # no stored file was opened
    size = lambda place: sum(f.stat().st_size for f in place.rglob("*.parquet"))
    stored = spark.read.parquet(path).filter("collection_month = '2024-01'")
    stored.select(*writers.OBSERVATION_KEY).write.parquet(str(tmp_path / "keys alone"))
    assert size(tmp_path / "t_keys" / "collection_month=2024-01") < size(tmp_path / "keys alone")
    assert size(tmp_path / "t_keys" / "collection_month=2024-01") < 8000 * 24


def test_index_is_only_a_memory(spark, tmp_path):
    """Files without an index are read, files that are gone count no longer, and nothing is stored twice."""
    path = tmp_path / "t"
    writers.append_new(_dated(spark, 0, 100, 1), str(path), indexed=True)
    writers.append_new(_dated(spark, 100, 100, 1), str(path), indexed=True)
    index = tmp_path / "t_keys"
    index.rename(tmp_path / "lost")
    assert writers.append_new(_dated(spark, 0, 200, 1), str(path), indexed=True)["uploaded"] == 0
    whole = spark.read.parquet(str(path)).drop("collection_month").withColumn("collection_month", F.lit("2024-01"))
    rows_left = whole.filter("total_fare < 150").collect()
    spark.createDataFrame(rows_left, whole.schema).coalesce(1).write.mode("overwrite").partitionBy("collection_month").parquet(str(path))
    assert writers.append_new(_dated(spark, 0, 200, 1), str(path), indexed=True)["uploaded"] == 50
    assert spark.read.parquet(str(path)).count() == 200


def test_a_run_reads_stored_keys_once(spark, tmp_path, monkeypatch):
    """Batches of a run look up keys in its memory: stored tables are read before the first batch only, however many follow."""
    landing, read = tmp_path / "landing", []
    landing.mkdir()
    for k in range(4):
        body = '{"best_flights":[{"price":%d,"flights":[{"airline":"A","departure_airport":{"id":"del"}}]}]}' % (100 + k % 3)
        record = {"search_id": k, "departure_airport": "del", "arrival_airport": "bom", "outbound_date": f"2024-02-0{1 + k % 3}",
                  "currency": "inr", "collected_at": "2024-01-05 10:00:00", "body": body}
        (landing / f"{k}.json").write_text(json.dumps(record))
    reader, folder = type(spark.read), tmp_path / "store"
    monkeypatch.setattr(reader, "parquet", lambda self, *p, f=reader.parquet, **k: (read.extend(p), f(self, *p, **k))[1])
    for run in range(2):
        ingest_stream(spark, str(landing), str(folder), str(tmp_path / f"c{run}"), files_per_batch=1, run_id=f"r{run}").awaitTermination()
    stored = [p.removeprefix(f"{folder}/").split("/")[0] for p in read if p.startswith(str(folder))]
    assert stored and max(stored.count(name) for name in set(stored)) <= 2  # once a run
    monkeypatch.undo()
    whole = spark.read.parquet(f"{folder}/observations")
    assert whole.count() == 3 and spark.read.parquet(f"{folder}/raw").count() == 3
    runs = {tuple(r) for r in spark.read.parquet(f"{folder}/runs").groupBy("run_id").agg(F.count("*"), F.sum("new_records")).collect()}
    assert runs == {("r0", 4, 3), ("r1", 4, 0)}


def test_memory_is_made_one_and_tells_all_keys_apart(spark, tmp_path, monkeypatch):
    from fareloom.sources import memory as m

    monkeypatch.setattr(m, "PARTS", 2)
    path = str(tmp_path / "t")
    writers.append_new(_dated(spark, 0, 10, 1), path)
    held = m.KeyMemory(path)
    for low in range(0, 60, 10):
        assert writers.append_new(_dated(spark, low, 20, 1), path, memory=held)["uploaded"] == 10
    assert writers.append_new(_dated(spark, 0, 70, 1), path, memory=held) == {"uploaded": 0, "skipped_duplicates": 70}
    stamps = [(DAY(2024, 1, 5), "r", 1, TS(2024, 1, 5, 10, 0, 0, 500), "A-B", None), (DAY(2024, 1, 5), "r", 1, TS(2024, 1, 5, 10, 0, 0, 501), "A-B", None)]
    table = spark.createDataFrame(stamps, "collection_date date, run_id string, search_id long, collection_timestamp timestamp, "
                                  "route string, outbound_date date")
    held, path = m.KeyMemory(f"{path}2"), f"{path}2"
    for rows_in in (table.limit(1), table, table.withColumn("collection_date", F.lit(None).cast("date"))):
        writers.append_new(rows_in, path, writers.MANIFEST_KEY, memory=held)
    assert writers.append_new(table, path, writers.MANIFEST_KEY, memory=held)["uploaded"] == 0
    assert spark.read.parquet(path).count() == 4


def test_large_batches_join_nothing(spark, tmp_path, monkeypatch):
    """Batch and stored keys are shuffled once each; nulls, repeats within the batch and keys of other months as before."""
    rows = [("2024-01-01", "A-B", "2024-03-01", "1", 5.0), ("2024-01-01", "A-B", "2024-03-01", "1", 4.0), (None, None, None, None, 2.0),
            (None, None, None, None, 1.0), ("2024-02-01", "A-B", None, "2", 7.0), ("2024-02-01", "A-B", None, "3", None)]
    kind = "collection_date string, route string, outbound_date string, record_id string, total_fare double"
    make = lambda picked: spark.createDataFrame(picked, kind).withColumns(
        {c: F.col(c).cast("date") for c in ("collection_date", "outbound_date")})
    small, large = str(tmp_path / "small"), str(tmp_path / "large")
    parts = [rows[:2], rows, [*rows, ("2024-02-02", "A-B", None, "4", 1.0)], rows[2:4]]
    want = [writers.append_new(make(p), small, order=["total_fare"]) for p in parts]
    monkeypatch.setattr(writers, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(writers, "stored_keys", None)  # not needed
    assert [writers.append_new(make(p), large, order=["total_fare"]) for p in parts] == want
    read = lambda path: sorted(map(repr, spark.read.parquet(path).collect()))
    assert read(large) == read(small) and len(read(large)) == 5


def test_append_leaves_no_copies(spark, tmp_path):
    """What an append writes on the way takes no disk once the rows are stored."""
    rows = spark.createDataFrame([(1, "a", "2024-01"), (1, "a", "2024-01"), (None, "b", None)], "k long, t string, collection_month string")
    folder = shared_folder(spark)
    there = lambda: {p for p in os.listdir(folder) if p.startswith(("batch-", "fresh-"))} if os.path.isdir(folder) else set()
    before = there()
    for want in (2, 0):
        found = writers.append_new(rows, f"{tmp_path}/stored", ["k"], ["t"])
        assert found == {"uploaded": want, "skipped_duplicates": 3 - want}
    assert there() == before
    assert spark.read.parquet(f"{tmp_path}/stored").count() == 2
