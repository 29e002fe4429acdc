"""One query per operator, each over the whole of the driver's tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fareloom.functions import columns as C
from fareloom.operators import aggregates as agg
from fareloom.operators import airports as air
from fareloom.operators import cleaning as clean
from fareloom.operators import collection as col
from fareloom.operators import features as feat
from fareloom.operators import identity as ident
from fareloom.operators import joins, market, quality, serving
from fareloom.operators import price_index as idx
from fareloom.operators.stats import exact_quantiles
from fareloom.plans import analytics, dashboard, dataset, incremental
from fareloom.schema import TRAVEL
from fareloom.session import fresh_path, materialise
from fareloom.sources import readers, versions, writers
from fareloom.streaming.ingest import ingest_stream as run_ingest, run_summary
from gate import views as v

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Decimals kept of computed doubles, on both sides of the comparison.
PLACES = 4


def shown(df: DataFrame) -> DataFrame:
    """Doubles rounded and timestamps as text, so that results compare across engines.

    The detour over nine decimals removes float noise, so that exact ties fall alike in both engines.
    """
    made = {}
    for name, kind in df.dtypes:
        if kind == "double":
            made[name] = F.round(F.col(name).cast("decimal(30,9)"), PLACES).cast("double")
        elif kind.startswith("timestamp"):
            made[name] = F.date_format(name, "yyyy-MM-dd HH:mm:ss")
    return df.withColumns(made) if made else df


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, sf_dir: shown(fn(spark, sf_dir))
    return fn


# --- sources and sinks ------------------------------------------------------------------------------------------


@query
def src_search_csv(s, d):
    return readers.read_searches(s, v.searches_csv(s, d)).drop("return_date")


@query
def src_option_csv(s, d):
    rows = readers.read_options(s, v.options_csv(s, d))
    return rows.select("id", "search_id", "origin", "destination", "outbound_date", "price", "currency",
                       "total_duration_minutes", "airline", "stops", "collected_at")


@query
def src_observation_json(s, d):
    rows = readers.read_observations(s, v.records_json(s, d), "*.txt.gz")
    return rows.select("record_id", "departure_airport", "arrival_airport", "outbound_date", "airline", "price",
                       "currency", "stops")


@query
def src_processed_parquet(s, d):
    v.sparse(s, d)
    path = v.written_path(s, d, "sparse", None)
    return readers.read_processed(s, path).select("record_id", "route", "outbound_date", "airline", "total_fare")


@query
def src_optional_table(s, d):
    v.sparse(s, d)
    path = v.written_path(s, d, "sparse", None)
    present = readers.read_processed(s, path, required=False).select("route", "total_fare")
    absent = readers.read_processed(s, f"{path}-absent", required=False).select("route", "total_fare")
    tagged = present.withColumn("found", F.lit("present")).unionByName(absent.withColumn("found", F.lit("absent")))
    return tagged.groupBy("found", "route").agg(F.count("*").alias("rows"))


@query
def sink_dual(s, d):
    folder = fresh_path(s, "dual")
    writers.write_dual(agg.daily_fare(v.dense(s, d)), folder, "daily_fare")
    writers.write_dual(v.dense(s, d).filter("total_fare < 0"), folder, "nothing")
    back = s.read.parquet(f"{folder}/daily_fare.parquet")
    text = s.read.schema(back.schema).option("header", True).option("escape", '"').csv(f"{folder}/daily_fare.csv")
    both = back.withColumn("format", F.lit("parquet")).unionByName(text.withColumn("format", F.lit("csv")))
    return both.select("format", "route", "outbound_date", "average_fare", "observations", "fare_change_pct")


@query
def sink_append_new(s, d):
    target, rows = fresh_path(s, "stored"), v.sparse(s, d, *writers.OBSERVATION_KEY, "total_fare").select(*writers.OBSERVATION_KEY, "total_fare")
    for part in (rows.filter(F.col("collection_date") < "1996-01-01"), rows, rows):
        writers.append_new(part, target, order=["total_fare"])
    return s.read.parquet(target).groupBy("route", F.year("collection_date").alias("year")).agg(
        F.count("*").alias("stored"), F.sum("total_fare").alias("total_fare"))


@query
def sink_raw_archive(s, d):
    target = fresh_path(s, "raw")
    writers.archive_raw(v.landed(s, d), target)
    writers.archive_raw(v.landed(s, d), target)
    return s.read.parquet(target).groupBy("year", "month").agg(F.count("response_hash").alias("responses"))


# --- flattening, projection, cleaning ------------------------------------------------------------------------------


@query
def flatten_responses(s, d):
    rows = col.flatten_responses(v.landed(s, d), "provider", "engine")
    return rows.select(
        "search_id", "collection_timestamp", "departure_airport", "arrival_airport", "route", "outbound_date",
        "advance_purchase_days", "airline", F.array_join("flight_numbers", ",").alias("flight_numbers"),
        "departure_time", "arrival_time", "duration_minutes", "stops", "total_fare", "currency", "sold_out",
        F.array_join("availability_details", ",").alias("availability_details"))


@query
def normalize_text(s, d):
    rows = v.dirty(s, d).select("id", "airline", F.col("airline").alias("kept"))
    rows = clean.normalize_text(rows, ["airline"])
    return clean.normalize_text(rows, ["kept"], empty_for_null=False)


@query
def coerce_types(s, d):
    rows = v.dirty(s, d).select("id", "price", "outbound_date", F.col("collected_at").cast("string").alias("collected_at"))
    return clean.coerce_types(rows, ["price"], ["outbound_date"], ["collected_at"])


@query
def normalize_airports(s, d):
    rows = v.dirty_records(s, d).select("record_id", "departure_airport", "arrival_airport")
    return clean.normalize_airports(rows)


@query
def normalize_airlines(s, d):
    return clean.normalize_airlines(v.dirty(s, d).select("id", "airline"))


@query
def build_route(s, d):
    return clean.build_route(v.dirty(s, d).select("id", "origin", "destination"))


@query
def parse_route(s, d):
    return clean.parse_route(v.sparse(s, d).select("record_id", "route"))


@query
def validate_fares(s, d):
    rows = v.dirty(s, d).select("id", C.number("price").alias("price"), C.number("price").alias("total_fare"))
    return clean.validate_fares(rows)


@query
def resolve_fare(s, d):
    rows = v.dirty(s, d).select("id", "search_id", C.number("price").alias("price"))
    rows = clean.resolve_fare(rows)
    fares = F.when(F.col("search_id") % 2 == 0, F.col("price"))
    rows = rows.withColumnRenamed("total_fare", "column_fare").withColumns({"total_fare": fares, "average_fare": F.lit(1.0)})
    return clean.resolve_fare(rows, per_row=True).select("id", "column_fare", "total_fare")


def _typed_dirty(s, d, once=False):
    rows = clean.coerce_types(v.dirty(s, d, once=once), ["price"], ["outbound_date"], [])
    return clean.build_route(rows.withColumn("total_fare", F.col("price")))


@query
def validate_dataset(s, d):
    return clean.validate_dataset(_typed_dirty(s, d)).select("id", "route", "outbound_date", "total_fare")


@query
def normalize_dataset(s, d):
    rows = clean.normalize_dataset(v.dirty(s, d).drop("copy"))
    return rows.select("id", "route", "airline", "outbound_date", "total_fare", "stops")


@query
def handle_missing(s, d):
    rows = clean.coerce_types(v.dirty_records(s, d))
    rows = rows.withColumn("duration_minutes", C.positive("duration_minutes"))
    rows = rows.withColumn("stops", F.when(F.col("l_partkey") % 7 != 0, F.col("stops")))
    return clean.handle_missing(rows).select("record_id", "airline", "outbound_date", "duration_minutes", "stops",
                                             "advance_purchase_days", "currency", "total_fare")


@query
def search_spine(s, d):
    found = v.searches(s, d).select(F.concat_ws("-", F.lower("origin"), "destination").alias("r")).distinct()
    texts = found.select(F.concat("r", F.lit(" , bad route,"), "r").alias("routes"))
    first = v.searches(s, d).select(F.min("outbound_date")).scalar()
    return col.search_spine(texts, first, 7, 3)


@query
def organize_columns(s, d):
    rows = v.sparse(s, d).select("stops", "l_partkey", "total_fare", "route", "record_id")
    rows = clean.organize_columns(rows, {"travel_class": "string", "base_fare": "double"}, {"source": "provider"})
    order = F.lit(",".join(rows.columns))
    return rows.groupBy(order.alias("column_order"), "route", "source", "travel_class", "base_fare").agg(
        F.count("*").alias("rows"))


# --- features ----------------------------------------------------------------------------------------------------


@query
def advance_days(s, d):
    rows = feat.advance_days(v.options(s, d), "collected_at")
    return rows.select("id", "outbound_date", "advance_purchase_days")


@query
def booking_window(s, d):
    rows = v.sparse(s, d).select("record_id", "advance_purchase_days", F.lit(None).cast("string").alias("booking_window"))
    rows = feat.booking_window(rows)
    wide = F.col("advance_purchase_days") * 200 - 300
    rows = feat.booking_window(rows.withColumn("wide", wide), "wide", "limited_window", limited=True)
    shifted = rows.withColumn("advance_purchase_days", F.col("wide"))
    return shifted.withColumn("lenient_window", agg.lenient_window(shifted)).drop("booking_window", "advance_purchase_days")


@query
def fare_band(s, d):
    rows = feat.fare_features(v.options(s, d).select("id", "price"))
    return feat.fare_features(rows.withColumnRenamed("fare_band", "band7"), six_bands=True)


@query
def time_features(s, d):
    rows = v.options(s, d).select("id", "outbound_date", F.col("collected_at").alias("collection_timestamp"))
    return feat.time_features(rows)


# --- identity and duplicates -----------------------------------------------------------------------------------------


@query
def record_fingerprint(s, d):
    rows = ident.record_fingerprint(col.flatten_responses(v.landed(s, d), "provider", None))
    return rows.select("search_id", "record_id")


@query
def record_id(s, d):
    return ident.record_id(feat.booking_features(v.options(s, d))).select("id", "record_id")


@query
def dedup_response(s, d):
    rows = v.sparse(s, d).select("search_id", "route", "airline", "total_fare",
                                 F.concat_ws("/", "airline", "route").alias("record_id"), "id")
    kept = ident.dedup_response(rows, ["total_fare", "id"], ["search_id"])
    counts = ident.dedup_counts(rows, ["search_id"])
    return kept.join(counts, "search_id").drop("unique_records")


@query
def dedup_observations(s, d):
    rows = v.dirty(s, d).withColumn("collection_timestamp", F.col("collected_at"))
    rows = rows.select("search_id", "collection_timestamp", "origin", "destination", "airline", "currency", "stops",
                       "l_partkey", "l_suppkey", "price")
    rows = rows.withColumnRenamed("price", "fare_text")
    return ident.dedup_observations(rows, ["collection_timestamp", "fare_text", "l_partkey", "l_suppkey"])


@query
def dedup_records(s, d):
    seen = v.sparse(s, d, "record_id", "collection_timestamp", "total_fare", "l_partkey", "l_suppkey", "origin", "destination",
                    "outbound_date", "airline", "price")
    rows = seen.select("record_id", "collection_timestamp", "total_fare", "l_partkey", "l_suppkey")
    order = ["collection_timestamp", "total_fare", "l_partkey", "l_suppkey"]
    by_id = ident.dedup_records(rows, order).withColumn("key", F.lit("id"))
    plain = seen.select(F.col("origin").alias("departure_airport"), F.col("destination").alias("arrival_airport"),
                        "outbound_date", "airline", F.floor(F.col("price") / 10000).alias("price"),
                        "collection_timestamp", "total_fare", "l_partkey", "l_suppkey", "record_id")
    fallback = ident.dedup_records(plain.drop("record_id"), order).withColumn("key", F.lit("fallback"))
    fallback = fallback.select(F.concat_ws("/", "departure_airport", "arrival_airport", "airline", "price")
                               .alias("record_id"), "collection_timestamp", "total_fare", "l_partkey", "l_suppkey", "key")
    return by_id.unionByName(fallback)


@query
def index_snapshot_hash(s, d):
    rows = v.dense(s, d, once=True).groupBy("route", "outbound_date").agg(F.count("*").alias("sample_size"))
    rows = rows.withColumn("calculated_at", F.current_timestamp())
    return ident.index_snapshot_hash(rows).drop("calculated_at")


# --- joins -----------------------------------------------------------------------------------------------------------


@query
def join_search_metadata(s, d):
    return joins.join_search_metadata(v.searches(s, d), v.options(s, d)).select(
        "id", "search_id", "search_currency", "search_timestamp", "search_request_id")


@query
def join_search_metadata_bucketed(s, d):
    """The same join of two tables that are stored by search id."""
    return joins.join_search_metadata(*v.bucketed(s, d)).select(
        "id", "search_id", "search_currency", "search_timestamp", "search_request_id")


@query
def semi_base_routes(s, d):
    rows = v.sparse(s, d)
    return idx.semi_base_routes(rows, idx.base_fares(rows)).select("record_id", "route", "total_fare")


@query
def semi_selected_routes(s, d):
    routes = serving.filter_observations(v.sparse(s, d).select("route").distinct(), origin="ASIA")
    return joins.semi_selected_routes(v.sparse(s, d), routes).select("record_id", "route", "total_fare")


def _master(s, d):
    n, r = v.table(s, d, "nation"), v.table(s, d, "region")
    rows = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    code = F.when(F.col("r_regionkey") < 3, F.col("r_name")).otherwise(F.concat(F.lit("X"), "r_name"))  # some codes are unknown
    return rows.groupBy(code.alias("code")).agg(
        F.min("n_name").alias("city"), F.max("n_name").alias("name"), F.min("n_regionkey").cast("string").alias("state"))


@query
def airport_lookup(s, d):
    codes = v.sparse(s, d).select(F.col("origin").alias("code")).distinct()
    return air.airport_lookup(codes, _master(s, d))


@query
def trend_activity(s, d):
    return idx.trend_activity(idx.trend_simple(v.sparse(s, d)), v.sparse(s, d))


# --- aggregates --------------------------------------------------------------------------------------------------------


@query
def daily_fare(s, d):
    return agg.daily_fare(v.dense(s, d))


@query
def daily_fare_sparse(s, d):
    return agg.daily_fare(v.sparse(s, d), detailed=True)


@query
def weekly_fare(s, d):
    return agg.weekly_fare(v.sparse(s, d))


@query
def weekly_fare_detailed(s, d):
    return agg.weekly_fare(v.sparse(s, d), detailed=True)


@query
def monthly_fare(s, d):
    return agg.monthly_fare(v.sparse(s, d))


@query
def monthly_fare_detailed(s, d):
    return agg.monthly_fare(v.sparse(s, d), detailed=True)


@query
def route_analysis(s, d):
    return agg.route_analysis(v.sparse(s, d))


@query
def route_analysis_detailed(s, d):
    return agg.route_analysis(v.sparse(s, d), detailed=True)


@query
def airline_analysis(s, d):
    return agg.airline_analysis(v.sparse(s, d, "route", "airline", "total_fare", "stops", "total_duration_minutes"))


@query
def airline_summary(s, d):
    return agg.airline_summary(v.sparse(s, d))


@query
def airline_summary_one_route(s, d):
    return agg.airline_summary(v.sparse(s, d), "asia-Europe")


@query
def route_summary(s, d):
    return agg.route_summary(v.sparse(s, d))


@query
def route_summary_detailed(s, d):
    return agg.route_summary(v.sparse(s, d), detailed=True, top=25)


@query
def booking_window_by_route(s, d):
    return agg.booking_window_by_route(v.sparse(s, d))


@query
def booking_window_by_route_preset(s, d):
    return agg.booking_window_by_route(v.sparse(s, d), "booking_window_category")


@query
def booking_window_summary(s, d):
    return agg.booking_window_summary(v.sparse(s, d))


@query
def booking_premium(s, d):
    return agg.booking_premium(agg.booking_window_summary(v.sparse(s, d), lenient=True))


@query
def weekday_weekend(s, d):
    return agg.weekday_weekend(v.sparse(s, d))


@query
def fare_distribution(s, d):
    return agg.fare_distribution(v.sparse(s, d))


@query
def fare_distribution_left(s, d):
    """Fares moved up, so that the lowest bucket is empty."""
    return agg.fare_distribution(v.sparse(s, d).withColumn("total_fare", F.col("total_fare") + 5000), "left", keep_empty=True)


@query
def index_input(s, d):
    return agg.index_input(v.dense(s, d))


@query
def fare_summary(s, d):
    return quality.fare_summary(v.sparse(s, d, "route", "airline", "outbound_date", "total_fare", "collection_timestamp"))


@query
def fare_summary_indexed(s, d):
    rows = v.dense(s, d)
    return quality.fare_summary(rows, idx.index_daily(idx.index_route_daily(rows, v.WEIGHTS)))


@query
def national_snapshot(s, d):
    rows = v.dense(s, d)
    daily = idx.index_daily(idx.index_route_daily(rows, v.WEIGHTS))
    return quality.national_snapshot(rows, daily, agg.route_analysis(rows)).drop("generated_at")


@query
def quality_report(s, d):
    return quality.quality_report(_typed_dirty(s, d).withColumn("record_id", F.col("id")))


@query
def quality_summary(s, d):
    rows = _typed_dirty(s, d).select(F.col("id").alias("record_id"), "route", "airline", "outbound_date", "total_fare",
                                     "return_date", (F.col("total_fare") > 90000).alias("fare_outlier"))
    return quality.quality_summary(rows)


@query
def quality_filtered(s, d):
    rows = _typed_dirty(s, d, once=True).withColumns({"collection_timestamp": F.col("collected_at"),
                                           "fare_outlier": F.col("total_fare") > 90000})
    return quality.quality_filtered(serving.filter_observations(rows.drop("origin"), origin="ASIA"))


@query
def search_index(s, d):
    return col.search_index(v.flattened(s, d, once=True), base_fare=40000.0)


@query
def search_index_own_base(s, d):
    return col.search_index(v.flattened(s, d, once=True))


@query
def run_manifest(s, d):
    rows = v.sparse(s, d).select(*writers.OBSERVATION_KEY, "total_fare")
    rows = rows.withColumn("outbound_date", F.trunc("outbound_date", "month"))
    before = rows.filter(F.col("collection_date") < "1995-01-01")
    index = agg.index_input(rows.withColumn("airline", F.lit("x"))).select(
        "route", "outbound_date", F.col("current_average_fare").alias("index_value"))
    return col.run_manifest(rows, before, index)


@query
def run_manifest_gaps(s, d):
    """Records without a route, a travel date or a collection date among the others."""
    k = F.col("l_partkey")
    rows = v.sparse(s, d).select(*writers.OBSERVATION_KEY, "total_fare", "l_partkey").withColumns({
        "route": F.when(k % 11 != 0, F.col("route")), "collection_date": F.when(k % 13 != 0, F.col("collection_date")),
        "outbound_date": F.when(k % 7 != 0, F.trunc("outbound_date", "year"))}).drop("l_partkey")
    before = rows.filter("collection_date < '1995-01-01' OR collection_date IS NULL")
    index = rows.groupBy("route", "outbound_date").agg(F.avg("total_fare").alias("index_value"))
    return col.run_manifest(rows, before, index.filter("route IS NULL OR outbound_date > '1994-06-01'"))


@query
def run_totals(s, d):
    rows = v.sparse(s, d).select(*writers.OBSERVATION_KEY)
    return col.run_totals(col.run_manifest(rows, rows.filter(F.col("collection_date") < "1995-01-01")))


@query
def airport_directory(s, d):
    return air.airport_directory(agg.route_summary(v.sparse(s, d)), _master(s, d))


@query
def airport_totals(s, d):
    return air.airport_totals(agg.route_summary(v.sparse(s, d)))


# --- windows and route context ---------------------------------------------------------------------------------------


@query
def pct_change(s, d):
    rows = v.dense(s, d).groupBy("route", "outbound_date").agg(F.avg("total_fare").alias("average_fare"))
    return agg.pct_change(rows, "average_fare", ["outbound_date"], ["route"])


@query
def index_changes(s, d):
    daily = idx.index_daily(idx.index_route_daily(v.dense(s, d), v.WEIGHTS))
    return idx.index_changes(daily.select("outbound_date", idx.INDEX))


@query
def dense_rank_fare(s, d):
    rows = v.sparse(s, d).groupBy("airline").agg(F.floor(F.avg("total_fare") / 100).alias("average_fare"))
    return agg.dense_rank_fare(rows)


@query
def market_features(s, d):
    return market.market_features(v.sparse(s, d)).select(
        "record_id", "route", "total_fare", "route_average_fare", "fare_vs_route_average_pct", "route_airline_count",
        "route_observation_count")


def _heavy_tailed(s, d):
    """Fares with a long upper tail, so that there are outliers to find; some are missing, some routes are null."""
    rows = v.sparse(s, d).select("record_id", "route", "price", "l_partkey")
    fare = F.when(F.col("l_partkey") % 40 == 0, F.col("price") * 9).when(F.col("l_partkey") % 43 != 0, F.col("price"))
    return rows.withColumns({"total_fare": fare, "route": F.when(F.col("l_partkey") % 31 != 0, F.col("route"))})


@query
def outlier_route_iqr(s, d):
    return market.outlier_route_iqr(_heavy_tailed(s, d)).select("record_id", "route", "total_fare", "fare_outlier")


@query
def outlier_route_iqr_guarded(s, d):
    small = F.concat_ws("/", "route", F.floor(F.col("l_partkey") / 50).cast("string"))
    rows = _heavy_tailed(s, d).withColumn("route", small)
    return market.outlier_route_iqr(rows, min_group=4, skip_zero_iqr=True).select(
        "record_id", "route", "total_fare", "fare_outlier")


@query
def outlier_global_iqr(s, d):
    return market.outlier_global_iqr(_heavy_tailed(s, d)).select("record_id", "total_fare", "fare_outlier")


# --- price index --------------------------------------------------------------------------------------------------------


@query
def normalize_weights(s, d):
    sums = v.sparse(s, d).groupBy("route").agg(F.sum("stops").alias("weight"))
    padded = sums.select(F.concat(F.lit(" "), F.lower("route")).alias("route"), (F.col("weight") + 1).alias("weight"))
    both = sums.withColumn("n", F.lit(1)).unionByName(padded.withColumn("n", F.lit(2)))
    return idx.normalize_weights(both.withColumn("weight", F.col("weight").cast("double")), "n")


@query
def base_fares(s, d):
    return idx.base_fares(v.sparse(s, d))


@query
def index_route_daily(s, d):
    return idx.index_route_daily(v.dense(s, d), v.WEIGHTS)


@query
def index_route_daily_sparse(s, d):
    return idx.index_route_daily(v.sparse(s, d), v.WEIGHTS, detailed=True)


def _daily(s, d, **kw):
    return idx.index_daily(idx.index_route_daily(v.dense(s, d), v.WEIGHTS), **kw)


@query
def index_daily(s, d):
    return _daily(s, d)


@query
def index_daily_strict(s, d):
    return idx.index_daily(idx.index_route_daily(v.sparse(s, d), v.WEIGHTS), strict_weights=True)


@query
def index_weekly(s, d):
    return idx.index_weekly(idx.index_daily(idx.index_route_daily(v.sparse(s, d), v.WEIGHTS)))


@query
def index_monthly(s, d):
    return idx.index_monthly(idx.index_daily(idx.index_route_daily(v.sparse(s, d), v.WEIGHTS)))


def _sectioned(tables: dict[str, tuple[str, str, str]], made: dict[str, DataFrame]) -> DataFrame:
    """Several result tables as (section, label, observations, value) rows."""
    out = None
    for name, (label, count, value) in tables.items():
        part = made[name].select(
            F.lit(name).alias("section"), F.expr(label).cast("string").alias("label"),
            F.expr(count).cast("double").alias("observations"), F.expr(value).cast("double").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def index_bundle(s, d):
    return _sectioned({
        "base_period": ("base_period", "1", "0"),
        "daily_route": ("concat(outbound_date, '/', route)", "observation_count", "weighted_contribution"),
        "daily": ("outbound_date", "total_observations", "index_change"),
        "weekly": ("week_start", "observations", "price_index"),
        "monthly": ("month", "route_count", "average_fare"),
    }, idx.index_bundle(v.dense(s, d), v.WEIGHTS))


# Columns that result tables are made from, and those that all result tables of a run take besides.
_AGGREGATED = ("route", "outbound_date", "total_fare", "airline", "advance_purchase_days", "is_weekend", "stops")
_ANALYSED = (*_AGGREGATED, "total_duration_minutes", "collection_timestamp")


@query
def all_aggregations(s, d):
    return _sectioned({
        "daily": ("concat(outbound_date, '/', route)", "airlines", "median_fare"),
        "weekly": ("concat(week_start, '/', route)", "airlines", "fare_volatility_pct"),
        "monthly": ("concat(month, '/', route)", "observations", "monthly_fare_change_pct"),
        "route": ("route", "average_stops", "average_duration_minutes"),
        "airline": ("concat(route, '/', airline)", "average_stops", "median_fare"),
        "booking_window": ("concat(route, '/', booking_window_category)", "observations", "median_fare"),
        "weekday_weekend": ("concat(route, '/', day_type)", "observations", "median_fare"),
        "index_input": ("concat(outbound_date, '/', route)", "sample_size", "fare_volatility_pct"),
    }, agg.all_aggregations(v.dense(s, d, *_AGGREGATED, "duration_minutes", "booking_window_category")))


@query
def backtest_series(s, d):
    return idx.backtest_series(v.sparse(s, d), v.WEIGHTS)


@query
def backtest_metrics(s, d):
    actual = _daily(s, d).select(F.col("outbound_date").alias("date"), F.col(idx.INDEX).alias("value"))
    bench = idx.trend_simple(v.dense(s, d)).withColumnRenamed(idx.INDEX, "value")
    return idx.backtest_metrics(actual, bench)


@query
def trend_simple(s, d):
    return idx.trend_simple(v.sparse(s, d))


@query
def trend_rollup(s, d):
    trend = idx.trend_simple(v.sparse(s, d))
    weeks = idx.trend_rollup(trend, "week").withColumn("mode", F.lit("week"))
    return weeks.unionByName(idx.trend_rollup(trend, "month").withColumn("mode", F.lit("month")))


@query
def index_latest(s, d):
    return idx.index_latest(_daily(s, d))


@query
def market_signal(s, d):
    return idx.market_signal(idx.trend_simple(v.dense(s, d)))


@query
def route_status(s, d):
    rows = agg.daily_fare(v.dense(s, d)).select("route", "outbound_date", "average_fare", "volatility_pct")
    return idx.route_status(rows)


# --- query layer ----------------------------------------------------------------------------------------------------------

_LISTED = ["record_id", "route", "airline", "outbound_date", "total_fare", "collection_timestamp"]


def _listed(s, d):
    return v.sparse(s, d).select(*_LISTED)


@query
def flights_query(s, d):
    return serving.flights_query(_listed(s, d), "asia-europe", "brand#12", 5000, upper_routes=True)


@query
def recent_flights(s, d):
    return serving.recent_flights(_listed(s, d))


@query
def filter_values(s, d):
    return serving.filter_values(v.sparse(s, d), "ASIA")


_CONDITIONS = {"origin": "ASIA", "destination": "ALL", "window": "15-30 days", "airline": "BRAND#12"}


@query
def filter_observations(s, d):
    return serving.filter_observations(v.sparse(s, d), **_CONDITIONS).select(*_LISTED)


_PANELS = {
    "summary": ("concat(routes, '/', airlines, '/', travel_dates)", "observations", "average_fare"),
    "trend": ("date", "0", "price_index"),
    "routes": ("route", "observations", "volatility_pct"),
    "airlines": ("airline", "observations", "median_fare"),
    "booking_window": ("booking_window", "observations", "median_fare"),
    "distribution": ("fare_bucket", "observations", "0"),
    "quality": ("concat(duplicates, '/', missing_fare)", "records", "completeness_pct"),
    "recent_flights": ("record_id", "1", "total_fare"),
}


def _cells(s, d):
    return v.sparse(s, d).select(*_LISTED, "advance_purchase_days", "fare_outlier")


@query
def filter_observations_laid_out(s, d):
    """Observations of one travel date, and of one carrier and booking lead, from the table laid out by month."""
    rows = v.laid_out(s, d)
    day = serving.filter_observations(rows, travel_date="1995-03-14").withColumn("asked", F.lit("day"))
    lead = serving.filter_observations(rows, window="15-30 days", airline="BRAND#12").withColumn("asked", F.lit("lead"))
    return day.unionByName(lead).select("asked", *_LISTED)


@query
def flights_query_laid_out(s, d):
    """The newest observations of one route that travel within two months."""
    rows = v.laid_out(s, d).select(*_LISTED, TRAVEL)
    found = serving.flights_query(rows, "asia-europe", limit=40, upper_routes=True, travel=("1995-02-10", "1995-03-20"))
    return found.select(*_LISTED)


@query
def filtered_dashboard(s, d):
    return _sectioned(_PANELS, dashboard.filtered_dashboard(_cells(s, d), **_CONDITIONS))


@query
def dashboard_bundle(s, d):
    return _sectioned(_PANELS, dashboard.dashboard_bundle(_cells(s, d), _daily(s, d)))


@query
def text_search(s, d):
    rows = v.sparse(s, d).select("record_id", "route", "airline")
    return serving.text_search(rows, " rope brand#1", ["route", "airline"])


@query
def paginate(s, d):
    third = serving.paginate(_listed(s, d), 3).withColumn("asked", F.lit(3))
    past = serving.paginate(_listed(s, d), 10**9, 12).withColumn("asked", F.lit(10**9))
    return third.unionByName(past)


@query
def top_routes(s, d):
    routes = agg.route_summary(v.sparse(s, d))
    top = serving.top_routes(routes, 3).select("route", "average_fare", "share_of_max_pct")
    ends = serving.route_extremes(routes)
    return top.withColumns({c: ends.select(c).scalar() for c in ends.columns})


@query
def top_airlines(s, d):
    return serving.top_airlines(agg.airline_summary(v.sparse(s, d))).select("airline", "observations", "share_of_max_pct")


@query
def connected_airports(s, d):
    routes = v.sparse(s, d).filter("origin = 'ASIA' AND airline = 'Brand#12'").select("route").distinct()
    airports = v.table(s, d, "region").select(F.col("r_name").alias("code"))
    return air.connected_airports(airports, routes)


@query
def status_summary(s, d):
    full = quality.status_summary(v.sparse(s, d), "healthy")
    return full.unionByName(quality.status_summary(v.sparse(s, d).filter("total_fare < 0")))


# --- whole builds ------------------------------------------------------------------------------------------------------------


@query
def clean_dataset(s, d):
    rows = v.dirty_records(s, d)
    out = dataset.clean_dataset(rows)
    return out.select("record_id", "collection_timestamp", "route", "airline", "outbound_date", "total_fare",
                      "duration_minutes", "stops", "currency", "fare_outlier")


@query
def preprocess_dataset(s, d):
    rows = v.sparse(s, d).select("record_id", "route", "airline", "outbound_date", "collection_timestamp", "total_fare",
                                 "advance_purchase_days")
    return dataset.preprocess_dataset(rows)


@query
def build_dataset(s, d):
    searches = readers.read_searches(s, v.searches_csv(s, d))
    options = readers.read_options(s, v.options_csv(s, d))
    out = dataset.build_dataset(searches, options, "provider", "engine")
    return out.select("record_id", "search_id", "route", "outbound_date", "return_date", "collection_timestamp",
                      "advance_purchase_days", "booking_window_category", "airline", "total_fare", "stops",
                      "is_weekend", "fare_band", "log_fare", "fare_outlier", "route_average_fare",
                      "fare_vs_route_average_pct", "route_airline_count", "route_observation_count",
                      "search_currency", "source", "base_fare")


@query
def run_analytics(s, d):
    folder = fresh_path(s, "results")
    names = analytics.run_analytics(v.dense(s, d, *_ANALYSED), folder, v.WEIGHTS)
    made = {n: s.read.parquet(f"{folder}/index/{n}.parquet" if n in analytics.INDEX_TABLES else f"{folder}/{n}.parquet")
            for n in names}
    return _sectioned({
        "daily_fare": ("concat(outbound_date, '/', route)", "observations", "median_fare"),
        "weekly_fare": ("concat(week_start, '/', route)", "observations", "volatility_pct"),
        "monthly_fare": ("concat(month, '/', route)", "observations", "fare_change_pct"),
        "route_analysis": ("route", "rank_by_average_fare", "median_fare"),
        "fare_distribution": ("fare_bucket", "observations", "0"),
        "airline_analysis": ("concat(route, '/', airline)", "observations", "median_fare"),
        "booking_window_analysis": ("concat(route, '/', booking_window)", "observations", "median_fare"),
        "weekday_weekend_analysis": ("concat(route, '/', day_type)", "observations", "median_fare"),
        "index_route_daily": ("concat(outbound_date, '/', route)", "0", "weighted_contribution"),
        "index_daily": ("outbound_date", "route_count", "price_index"),
        "index_weekly": ("week_start", "observations", "price_index"),
        "index_monthly": ("month", "observations", "price_index"),
        "national_snapshot": ("concat(highest_average_fare_route, '/', lowest_average_fare_route)", "observations",
                              "price_index"),
    }, made)


@query
def sink_published(s, d):
    """Result tables published twice; between the two a run breaks off, and readers follow the first version then."""
    folder, rows = fresh_path(s, "published"), v.dense(s, d, *_ANALYSED)
    analytics.run_analytics(rows.filter("route = 'ASIA-EUROPE'"), folder, v.WEIGHTS, versioned=True)
    first = versions.current(s, folder)
    broken = rows.select(F.when(F.col("total_fare") > 0, F.raise_error(F.lit("broken off")).cast("int")).alias("x"))
    try:
        versions.publish(s, folder, {"route_analysis": agg.route_analysis(rows), "broken": broken})
    except Exception:  # the run that is meant to fail
        pass
    between = versions.read_published(s, folder, "route_analysis").withColumn("seen", F.lit("between"))
    assert versions.current(s, folder) == first
    analytics.run_analytics(rows, folder, v.WEIGHTS, versioned=True)
    after = versions.read_published(s, folder, "route_analysis").withColumn("seen", F.lit("after"))
    return between.unionByName(after).select("seen", "route", "average_fare", "median_fare", "observations")


@query
def sink_index_snapshot(s, d):
    """The same index results stored twice, then all but those of one route with other values."""
    target = fresh_path(s, "snapshots")
    index = materialise(col.search_index(v.flattened(s, d, once=True), 40000.0), "index")  # stored three times below
    index = index.withColumns({"collection_date": F.col("outbound_date"), "calculated_at": F.current_timestamp()})
    changed = index.withColumn("base_fare", F.when(F.col("route") == "ASIA-EUROPE", F.col("base_fare")).otherwise(1.0))
    for part in (index, index, changed):
        writers.store_snapshots(part, target)
    return s.read.parquet(target).groupBy("route").agg(
        F.count("*").alias("stored"), F.count_distinct("snapshot_hash").alias("hashes"))


@query
def ingest_stream(s, d):
    """Two runs of the stream over the same landed files, in small batches; nothing may be stored twice."""
    folder = fresh_path(s, "ingested")
    for run in range(2):
        job = run_ingest(s, v.landed_json(s, d), folder, fresh_path(s, f"progress{run}"), "provider", "engine",
                         files_per_batch=5, pattern="*.txt")
        job.awaitTermination()
    rows = s.read.parquet(f"{folder}/observations")
    return rows.groupBy("route", F.month("collection_date").alias("month")).agg(
        F.count("*").alias("stored"), F.sum("total_fare").alias("total_fare"))


def _ingested(s, d, table):
    """A table that the stream stores from the landed files in small batches, and from a second run over them."""
    folder = fresh_path(s, "ingested")
    for run in range(2):
        run_ingest(s, v.landed_json(s, d), folder, fresh_path(s, f"progress{run}"), "provider", "engine", 40000.0,
                   files_per_batch=5, pattern="*.txt", run_id="gate").awaitTermination()
    return s.read.parquet(f"{folder}/{table}")


@query
def ingest_stream_index(s, d):
    return _ingested(s, d, "index").select(
        "route", "outbound_date", "collection_date", "index_value", "base_fare", "average_fare", "median_fare",
        "minimum_fare", "maximum_fare", "sample_size", "currency", "advance_purchase_days")


@query
def ingest_stream_runs(s, d):
    return _ingested(s, d, "runs").select(
        "run_id", "search_id", "route", "outbound_date", "collection_date", "extracted", "duplicates_in_response",
        "new_records", "skipped_existing", "index_value", "index_generated", "raw_response_uploaded")


@query
def ingest_stream_rejects(s, d):
    """Broken files among the landed ones, met by two runs: files with every fifth search cut off in the middle."""
    folder = fresh_path(s, "ingested")
    for run in range(2):
        run_ingest(s, v.damaged_json(s, d), folder, fresh_path(s, f"progress{run}"), "provider", "engine", 40000.0,
                   files_per_batch=25, pattern="*.txt", run_id=f"run {run}").awaitTermination()
    return run_summary(s, folder)


@query
def ingest_results(s, d):
    """Result tables brought up to date after every small batch of landed files, then after late ones, which repeat some."""
    folder = fresh_path(s, "ingested")
    for run in range(2):
        run_ingest(s, v.landed_json(s, d), folder, fresh_path(s, f"progress{run}"), "provider", "engine", files_per_batch=12,
                   pattern="*.txt", results=f"{folder}/results").awaitTermination()
    made = incremental.results(s, f"{folder}/results", v.WEIGHTS)
    return _sectioned({
        "daily_fare": ("concat(outbound_date, '/', route)", "airlines", "median_fare"),
        "monthly_fare": ("concat(month, '/', route)", "observations", "monthly_fare_change_pct"),
        "index_route_daily": ("concat(outbound_date, '/', route)", "0", "weighted_contribution"),
        "index_daily": ("outbound_date", "route_count", "price_index"),
    }, made)


@query
def sink_append_undated(s, d):
    """Rows with missing dates, appended three times."""
    target, rows = fresh_path(s, "undated"), v.sparse(s, d, *writers.OBSERVATION_KEY, "total_fare").select(*writers.OBSERVATION_KEY, "total_fare")
    rows = rows.withColumn("collection_date", F.when(F.month("collection_date") > 3, F.col("collection_date")))
    for part in (rows, rows.filter(F.col("collection_date").isNull()), rows):
        writers.append_new(part, target, order=["total_fare"])
    return s.read.parquet(target).groupBy("route", F.year("collection_date").alias("year")).agg(
        F.count("*").alias("stored"), F.sum("total_fare").alias("total_fare"))


def _unsound(s, d):
    """Observations with NaN and infinite fares among the others."""
    rows = v.sparse(s, d)
    k = F.col("l_partkey")
    fare = F.when(k % 17 == 0, float("nan")).when(k % 19 == 0, float("inf")).when(k % 23 == 0, float("-inf"))
    return rows.withColumn("total_fare", fare.otherwise(F.col("total_fare")))


@query
def unsound_fares(s, d):
    return agg.route_analysis(_unsound(s, d)).select(
        "route", "average_fare", "median_fare", "minimum_fare", "maximum_fare", "observations")


@query
def unsound_quartiles(s, d):
    return exact_quantiles(_unsound(s, d), ["route"], "total_fare", {"q1": 0.25, "q2": 0.5, "q3": 0.75})


__all__ = ["QUERIES"]
