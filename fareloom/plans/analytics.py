"""All result tables of the processed observations."""
from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame

from fareloom.functions import columns as C
from fareloom.operators import aggregates as agg, price_index as idx, quality
from fareloom.operators.cleaning import normalize_dataset, validate_dataset
from fareloom.operators.rollup import RollUp
from fareloom.sources.versions import publish
from fareloom.sources.writers import write_dual

INDEX_TABLES = ("index_route_daily", "index_daily", "index_weekly", "index_monthly")


def analytics_tables(df: DataFrame, weights=None, index_column: str = idx.INDEX) -> dict[str, DataFrame]:
    """The thirteen result tables by name, as plans over one stored roll-up; the observations are read twice in all."""
    data = validate_dataset(normalize_dataset(df))
    grains = [["outbound_date", "route"], ["week_start", "route"], ["month", "route"], ["route"]]
    derived = agg.periods()
    data = data.withColumn("fare_bucket", agg.fare_bucket())
    if "airline" in data.columns:
        grains.append(["route", "airline"])
    if "advance_purchase_days" in data.columns:
        data = data.withColumn("booking_window", C.booking_window("advance_purchase_days"))
        grains.append(["route", "booking_window"])
    if "is_weekend" in data.columns:
        grains.append(["route", "is_weekend"])
    dims = [c for c in ("route", "outbound_date", "airline", "booking_window", "is_weekend", "fare_bucket") if c in data.columns]
    means = [c for c in ("total_duration_minutes", "stops") if c in data.columns]
    latest = "collection_timestamp" if "collection_timestamp" in data.columns else None
    data = RollUp(data, dims, grains, derived=derived, means=means, distinct=["airline"], latest=latest)
    tables = {
        "daily_fare": agg.daily_fare(data),
        "weekly_fare": agg.weekly_fare(data),
        "monthly_fare": agg.monthly_fare(data),
        "route_analysis": agg.route_analysis(data),
        "fare_distribution": agg.fare_distribution(data),
    }
    if ["route", "airline"] in grains:
        tables["airline_analysis"] = agg.airline_analysis(data)
    if ["route", "booking_window"] in grains:
        tables["booking_window_analysis"] = agg.booking_window_by_route(data)
    if ["route", "is_weekend"] in grains:
        tables["weekday_weekend_analysis"] = agg.weekday_weekend(data)
    routes = idx.index_route_daily(data, weights)
    daily = idx.index_daily(routes, index_column=index_column)
    tables["index_route_daily"] = routes
    tables["index_daily"] = daily
    tables["index_weekly"] = idx.index_weekly(daily, index_column=index_column)
    tables["index_monthly"] = idx.index_monthly(daily, index_column=index_column)
    tables["national_snapshot"] = quality.national_snapshot(data, daily, tables["route_analysis"], index_column)
    return tables


def run_analytics(df: DataFrame, folder: str, weights=None, versioned: bool = False) -> dict[str, DataFrame]:
    """Write every result table as Parquet and CSV, index tables in their own subfolder.

    The tables are independent jobs and are submitted side by side, so small ones fill the gaps of large ones.
    `versioned` publishes them as one version instead (`sources.versions`): readers get all tables of one run or none.
    """
    tables = analytics_tables(df, weights)

    def write(name: str) -> None:
        write_dual(tables[name], f"{folder}/index" if name in INDEX_TABLES else folder, name)

    with ThreadPoolExecutor(max_workers=4) as pool:
        if versioned:
            publish(df.sparkSession, folder, tables, pool.map)
        else:
            list(pool.map(write, tables))
    return tables
