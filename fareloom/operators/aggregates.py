"""Descriptive fare aggregates by period, route, carrier, booking lead, day type and fare bucket."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from fareloom import fixed
from fareloom.functions import columns as C
from fareloom.operators.ordering import dense_ranks
from fareloom.operators.rollup import RollUp
from fareloom.operators.stats import fare_stats
from fareloom.schema import has_columns


def pct_change(df: DataFrame, value: str, order: list[str], group: list[str] | None = None,
               output: str = "change_pct") -> DataFrame:
    """Change in percent against the previous row in `order`, within `group` if given.

    Meant for aggregates: without `group`, all rows pass through one task, so `df` must hold one row per period.
    """
    window = W.partitionBy(*(group or [])).orderBy(*order)
    return df.withColumn(output, C.change_pct(value, F.lag(value).over(window)))


def _spread(df: DataFrame, volatility: str, with_range: bool = False) -> DataFrame:
    if with_range:
        df = df.withColumn("fare_range", F.col("maximum_fare") - F.col("minimum_fare"))
    return df.withColumn(volatility, C.volatility("fare_std", "average_fare"))


def _stats(df: DataFrame | RollUp, keys: list[str], derived: dict | None = None, **wanted) -> DataFrame:
    """Fare statistics of observations, or of a roll-up that has the grain."""
    if isinstance(df, RollUp):
        return df.fare_stats(keys, **wanted)
    return fare_stats(df.withColumns(derived or {}), keys, **wanted)


def periods() -> dict:
    """The columns that grains derive from observations."""
    return {"week_start": C.week_start("outbound_date"), "month": C.month_key("outbound_date")}


def _period_fare(df, period, detailed, airlines, with_range):
    derived = {period: periods()[period]} if period in periods() else {}
    out = _stats(df, [period, "route"], derived, std=True, distinct={"airlines": "airline"} if airlines else None)
    out = _spread(out, "fare_volatility_pct" if detailed else "volatility_pct", with_range)
    return out, [period]


def daily_fare(df: DataFrame | RollUp, detailed: bool = False) -> DataFrame:
    """Fare statistics per travel date and route, with the change against the route's previous date.

    Like its siblings below it takes observations, or a `RollUp` of them that has the grain.
    """
    out, order = _period_fare(df, "outbound_date", detailed, True, True)
    name = "daily_fare_change_pct" if detailed else "fare_change_pct"
    return pct_change(out, "average_fare", order, ["route"], name).orderBy("route", "outbound_date")


def weekly_fare(df: DataFrame | RollUp, detailed: bool = False) -> DataFrame:
    """Same per Monday week; `detailed` adds the number of carriers."""
    out, order = _period_fare(df, "week_start", detailed, detailed, False)
    name = "weekly_fare_change_pct" if detailed else "fare_change_pct"
    return pct_change(out, "average_fare", order, ["route"], name).orderBy("route", "week_start")


def monthly_fare(df: DataFrame | RollUp, detailed: bool = False) -> DataFrame:
    """Same per calendar month; `detailed` adds the number of carriers."""
    out, order = _period_fare(df, "month", detailed, detailed, False)
    name = "monthly_fare_change_pct" if detailed else "fare_change_pct"
    return pct_change(out, "average_fare", order, ["route"], name).orderBy("route", "month")


def dense_rank_fare(routes: DataFrame, output: str = "rank_by_average_fare") -> DataFrame:
    """Dense rank of routes by average fare, dearest first. Takes one row per route, never observations."""
    return dense_ranks(routes, -F.col("average_fare"), output).select(*routes.columns, output)


def route_analysis(df: DataFrame | RollUp, detailed: bool = False) -> DataFrame:
    """Fare statistics per route; the default ranks routes, `detailed` adds mean duration and stops instead."""
    means = {"average_duration_minutes": "duration_minutes", "average_stops": "stops"} if detailed else None
    out = _spread(_stats(df, ["route"], std=True, distinct={"airlines": "airline"}, means=means), "volatility_pct")
    if not detailed:
        out = dense_rank_fare(out.withColumn("fare_range", F.col("maximum_fare") - F.col("minimum_fare")))
    return out.orderBy(F.col("average_fare").desc(), "route")


def airline_analysis(df: DataFrame | RollUp, duration: str = "total_duration_minutes") -> DataFrame:
    """Fare statistics, mean duration and mean stops per route and carrier."""
    means = {"average_duration_minutes": duration, "average_stops": "stops"}
    return _stats(df, ["route", "airline"], means=means).orderBy("route", "average_fare", "airline")


def airline_summary(df: DataFrame | RollUp, route: str | None = None, skip_blank: bool = False) -> DataFrame:
    """Fare statistics per carrier with the number of routes it serves, optionally on one route.

    The conditions are for observations; a roll-up is of all of them.
    """
    data = df
    if route and route.lower() != "all":
        data = data.filter(F.upper("route") == route.upper())
    if skip_blank:
        data = data.filter(F.col("airline") != "")
    return _stats(data, ["airline"], distinct={"routes": "route"}).orderBy(F.col("average_fare").desc(), "airline")


def route_summary(df: DataFrame | RollUp, detailed: bool = False, top: int | None = None) -> DataFrame:
    """Fare statistics per route, dearest first; `detailed` adds deviation, volatility and range."""
    out = _stats(df, ["route"], std=detailed, distinct={"airlines": "airline"})
    if detailed:
        out = _spread(out, "volatility_pct", True)
    out = out.orderBy(F.col("average_fare").desc(), "route")
    return out.limit(top) if top else out


def booking_window_by_route(df: DataFrame | RollUp, preset: str | None = None) -> DataFrame:
    """Fare statistics per route and booking lead, far to near; `preset` names an existing label column to use."""
    if preset:
        return _stats(df, ["route", preset]).orderBy("route", C.label_rank(preset, fixed.BOOKING_LABELS))
    out = _stats(df, ["route", "booking_window"], {"booking_window": C.booking_window("advance_purchase_days")})
    return out.orderBy("route", C.far_first("booking_window"))


def booking_window_summary(df: DataFrame | RollUp, lenient: bool = False) -> DataFrame:
    """Fare statistics per booking lead.

    `lenient` is the filtered-view form: an existing label wins, negative leads count as nearest, far to near.
    """
    if not lenient:
        out = _stats(df, ["booking_window"], {"booking_window": C.booking_window("advance_purchase_days")})
        return out.orderBy(C.label_rank("booking_window", fixed.BOOKING_LABELS))
    data = df.withColumn("booking_window", lenient_window(df))
    return fare_stats(data, ["booking_window"]).orderBy(C.far_first("booking_window"))


def lenient_window(df: DataFrame):
    """Booking-lead label: an existing non-empty label, else by days with no lower bound."""
    label = C.label_right_closed("advance_purchase_days", [float("-inf"), *fixed.BOOKING_EDGES[1:]], fixed.BOOKING_LABELS)
    if "booking_window" in df.columns:
        return F.coalesce(C.blank_to_null("booking_window"), label)
    return label


def booking_premium(booking: DataFrame) -> DataFrame:
    """Change in percent from the farthest to the nearest non-empty booking lead, from a booking summary."""
    rank = C.label_rank("booking_window", fixed.BOOKING_LABELS)
    fares = booking.agg(
        F.max_by("average_fare", rank).alias("early_fare"), F.min_by("average_fare", rank).alias("late_fare")
    )
    change = F.when(F.col("early_fare") > 0, C.change_pct("late_fare", "early_fare"))
    return fares.withColumn("booking_premium_pct", change)


def weekday_weekend(df: DataFrame | RollUp) -> DataFrame:
    """Average, median and count per route, weekdays against weekends."""
    out = _stats(df, ["route", "is_weekend"], extremes=False)
    label = F.when(F.col("is_weekend"), "Weekend").otherwise("Weekday")
    return out.withColumn("day_type", label).orderBy("route", "is_weekend")


def fare_bucket(closed: str = "right", labels: list[str] | None = None):
    """Label of the fare's bucket; `closed` says which end belongs to it."""
    label = C.label_right_closed if closed == "right" else C.label_left_closed
    return label("total_fare", fixed.FARE_BUCKET_EDGES, labels or fixed.FARE_BUCKET_LABELS)


def fare_distribution(df: DataFrame | RollUp, closed: str = "right", keep_empty: bool = False,
                      labels: list[str] | None = None) -> DataFrame:
    """Number of fares per fare bucket; `closed` says which end belongs to a bucket.

    A roll-up has the buckets as a dimension, with the closed end and labels of its own.
    """
    labels = labels or fixed.FARE_BUCKET_LABELS
    if isinstance(df, RollUp):
        counts = df.combinations(["fare_bucket"]).dropna(subset=["fare_bucket"]).select("fare_bucket", F.col("n").alias("observations"))
    else:
        counts = df.select(fare_bucket(closed, labels).alias("fare_bucket")).dropna().groupBy("fare_bucket").agg(
            F.count("*").alias("observations"))
    if keep_empty:
        every = counts.sparkSession.createDataFrame([(x,) for x in labels], "fare_bucket string")
        counts = every.join(counts, "fare_bucket", "left").select(
            "fare_bucket", F.coalesce("observations", F.lit(0)).alias("observations")
        )
    return counts.orderBy(C.label_rank("fare_bucket", labels))


def index_input(df: DataFrame | RollUp) -> DataFrame:
    """Per travel date and route: the statistics an index is built from."""
    names = {"average_fare": "current_average_fare", "median_fare": "current_median_fare", "observations": "sample_size"}
    out = _spread(_stats(df, ["outbound_date", "route"], std=True, distinct={"airlines": "airline"}),
                  "fare_volatility_pct")
    return out.withColumnsRenamed(names).orderBy("outbound_date", "route")


def all_aggregations(df: DataFrame) -> dict[str, DataFrame]:
    """The eight detailed aggregates of one prepared table; those whose columns are missing are left out.

    All come from one roll-up, which reads the observations twice, whatever the number of aggregates.
    """
    dated, grains = has_columns(df, "outbound_date"), []
    if not has_columns(df, "route", "total_fare"):
        return {}
    if dated:
        grains += [["outbound_date", "route"], ["week_start", "route"], ["month", "route"]]
    grains.append(["route"])
    if has_columns(df, "airline"):
        grains.append(["route", "airline"])
    if has_columns(df, "advance_purchase_days", "booking_window_category"):
        grains.append(["route", "booking_window_category"])
    if has_columns(df, "is_weekend"):
        grains.append(["route", "is_weekend"])
    derived = periods() if dated else {}
    dims = [c for c in ("route", "outbound_date", "airline", "booking_window_category", "is_weekend") if c in df.columns]
    means = [c for c in ("duration_minutes", "stops") if c in df.columns]
    roll = RollUp(df, dims, grains, derived=derived, means=means, distinct=["airline"])
    made = {}
    if dated:
        made.update(daily=daily_fare(roll, True), weekly=weekly_fare(roll, True), monthly=monthly_fare(roll, True))
    made["route"] = route_analysis(roll, True)
    if ["route", "airline"] in grains:
        made["airline"] = airline_analysis(roll, "duration_minutes")
    if ["route", "booking_window_category"] in grains:
        made["booking_window"] = booking_window_by_route(roll, "booking_window_category")
    if ["route", "is_weekend"] in grains:
        made["weekday_weekend"] = weekday_weekend(roll)
    if dated:
        made["index_input"] = index_input(roll)
    return made
