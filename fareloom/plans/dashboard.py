"""The dashboard's panels, unfiltered and under a filter."""
from __future__ import annotations

from pyspark.sql import DataFrame

from fareloom import fixed
from fareloom.functions import columns as C
from fareloom.operators import aggregates as agg, price_index as idx, quality, serving
from fareloom.operators.rollup import RollUp


def dashboard_bundle(df: DataFrame, index: DataFrame | None = None, index_column: str = idx.INDEX,
                     top: int | None = fixed.TOP_ROUTES, recent: int = fixed.RECENT_ROWS) -> dict[str, DataFrame]:
    """All panels over all normalised observations; the trend comes from the index table if there is one.

    `top` is the number of routes shown, None for all; `recent` the number of newest observations. All fare panels come
    from one roll-up, which reads the observations twice; quality (which compares record ids) and the newest rows read
    them themselves.
    """
    labels = fixed.FARE_BUCKET_DISPLAY
    rows = df.withColumns({"fare_bucket": agg.fare_bucket("right", labels),
                           "booking_window": C.booking_window("advance_purchase_days"),
                           "outbound_date": C.day("outbound_date")})
    roll = RollUp(
        rows, ["route", "outbound_date", "airline", "booking_window", "fare_bucket"],
        [["route"], ["airline"], ["booking_window"], ["outbound_date"]], distinct=["airline", "route"],
        latest="collection_timestamp" if "collection_timestamp" in df.columns else None)
    if index is None:
        trend = idx.trend_simple(roll, index_column=index_column)
        table = trend.withColumnRenamed("date", "outbound_date")
    else:
        table = index.filter(C.present(["outbound_date", index_column]))
        trend = table.selectExpr("outbound_date AS date", index_column).orderBy("date")
    return {
        "summary": quality.fare_summary(roll, table, index_column),
        "trend": trend,
        "routes": agg.route_summary(roll, detailed=True, top=top),
        "airlines": agg.airline_summary(roll),
        "booking_window": agg.booking_window_summary(roll),
        "distribution": agg.fare_distribution(roll, labels=labels),
        "quality": quality.quality_summary(df),
        "recent_flights": serving.recent_flights(df, recent),
    }


def filtered_dashboard(df: DataFrame, index: DataFrame | None = None, index_column: str = idx.INDEX,
                       **conditions: str | None) -> dict[str, DataFrame]:
    """All panels over the observations that meet the conditions of `filter_observations`.

    Route, carrier and booking panels follow origin and destination only (plus the carrier, for carriers); the other
    panels follow every condition, and the trend then runs over collection dates.
    """
    active = {k: v for k, v in conditions.items() if v and v.upper() != "ALL"}
    rows = serving.filter_observations(df, **active)
    places = {k: v for k, v in active.items() if k in ("origin", "destination")}
    scoped = serving.filter_observations(df, **places)
    if active:
        trend = idx.trend_simple(rows, "collection_timestamp", index_column)
    elif index is not None:
        trend = index.selectExpr("outbound_date AS date", index_column).orderBy("date")
    else:
        trend = idx.trend_simple(df, index_column=index_column)
    carriers = {k: v for k, v in active.items() if k in ("origin", "destination", "airline")}
    return {
        "summary": quality.fare_summary(rows, trend.withColumnRenamed("date", "outbound_date"), index_column),
        "trend": trend,
        "routes": agg.route_summary(scoped, detailed=True),
        "airlines": agg.airline_summary(serving.filter_observations(df, **carriers), skip_blank=True),
        "booking_window": agg.booking_window_summary(scoped, lenient=True),
        "distribution": agg.fare_distribution(rows, "left", True, fixed.FARE_BUCKET_DISPLAY),
        "quality": quality.quality_filtered(rows),
        "recent_flights": serving.recent_flights(rows),
    }
