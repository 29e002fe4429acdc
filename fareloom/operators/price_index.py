"""Base-period weighted price index: route, day, week and month grain, changes, trends and signals."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from fareloom import fixed
from fareloom.functions import columns as C
from fareloom.operators.aggregates import pct_change
from fareloom.operators.ordering import with_previous
from fareloom.operators.rollup import RollUp
from fareloom.operators.stats import fare_stats

INDEX = "price_index"


def normalize_weights(weights: DataFrame, order: str | None = None, strict: bool = True) -> DataFrame:
    """Scale (route, weight) rows to sum to one.

    `strict` upper-cases and trims routes, keeps the last of equal ones (by `order`, else the largest) and fails on a
    negative weight. A total of zero or less always fails.
    """
    rows = weights
    if strict:
        rows = rows.withColumn("route", F.upper(F.trim("route")))
        keep = F.max_by("weight", order) if order else F.max("weight")
        rows = rows.groupBy("route").agg(keep.alias("weight"))
    total = rows.select(F.sum("weight")).scalar()
    scaled = F.when(total <= 0, F.raise_error(F.lit("Route weights must sum to more than zero.")).cast("double"))
    if strict:
        lowest = rows.select(F.min("weight")).scalar()
        scaled = scaled.when(lowest < 0, F.raise_error(F.lit("Negative route weight.")).cast("double"))
    return rows.select("route", scaled.otherwise(F.col("weight") / total).alias("weight"))


def weights_table(spark: SparkSession, weights: dict[str, float], strict: bool = True) -> DataFrame:
    """Weights given as a dict, checked here because they are a parameter, as a small table."""
    if not weights:
        raise ValueError("Route weights cannot be empty.")
    cleaned: dict[str, float] = {}
    for route, weight in weights.items():
        if strict and float(weight) < 0:
            raise ValueError(f"Negative weight for route: {route}")
        cleaned[route.upper().strip() if strict else route] = float(weight)
    total = sum(cleaned.values())
    if total <= 0:
        raise ValueError("Route weights must sum to more than zero.")
    rows = [(route, weight / total) for route, weight in cleaned.items()]
    return spark.createDataFrame(rows, "route string, weight double")


def _weights(spark: SparkSession, weights: DataFrame | dict[str, float] | None) -> DataFrame:
    if isinstance(weights, DataFrame):
        return weights
    # A table made from a parameter is small, so neither side of its join is shuffled.
    return F.broadcast(weights_table(spark, weights or fixed.DEFAULT_ROUTE_WEIGHTS))


def base_period(df: DataFrame) -> DataFrame:
    """One row: the earliest travel date."""
    return df.select(F.min("outbound_date").alias("base_period"))


def base_fares(df: DataFrame, base_date=None) -> DataFrame:
    """Mean fare per route on the base date (the earliest travel date unless given)."""
    when = F.lit(base_date).cast("date") if base_date is not None else base_period(df).scalar()
    data = df.filter(F.col("outbound_date") == when).filter(C.present(["route"]))
    return data.groupBy("route").agg(F.avg("total_fare").alias("base_fare"))


def index_route_daily(df: DataFrame | RollUp, weights: DataFrame | dict[str, float] | None = None, detailed: bool = False,
                      base_date=None) -> DataFrame:
    """Per travel date and route: fare, base fare, index, weight and weighted contribution.

    A route without a fare on the base date gets no index and no contribution but keeps its weight. The base fare is
    read off the daily averages, so observations are aggregated once. Rows come in no order: the daily index sums them up.
    A roll-up with the grain serves as well as observations.
    """
    keys = ["outbound_date", "route"]
    rolled = isinstance(df, RollUp)
    if detailed:
        count = {"observations": "observation_count"}
        daily = df.fare_stats(keys, names=count) if rolled else fare_stats(df, keys, names=count)
    elif rolled:
        daily = df.fare_stats(keys).select(*keys, "average_fare")
    else:
        daily = df.filter(C.present(keys)).groupBy(*keys).agg(F.avg("total_fare").alias("average_fare"))
    return index_of_daily(daily, weights, base_period(df.parts if rolled else df).scalar() if base_date is None else base_date)


def index_of_daily(daily: DataFrame, weights: DataFrame | dict[str, float] | None = None, base_date=None) -> DataFrame:
    """`index_route_daily` from average fares per travel date and route; the base date is the first unless given."""
    if base_date is None:
        base_date = base_period(daily).scalar()
    when = base_date if isinstance(base_date, Column) else F.lit(base_date).cast("date")
    based = daily.withColumn("_base", when).withColumn(
        "base_fare",
        F.max(F.when(F.col("outbound_date") == F.col("_base"), F.col("average_fare"))).over(W.partitionBy("route")),
    )
    return (
        based.drop("_base")
        .withColumn("route_index", C.share("average_fare", "base_fare"))
        .join(_weights(daily.sparkSession, weights).withColumnRenamed("weight", "route_weight"), "route", "left")
        .withColumn("route_weight", F.coalesce("route_weight", F.lit(0.0)))
        .withColumn("weighted_contribution", F.col("route_index") * F.col("route_weight"))
        .select(*daily.columns, "base_fare", "route_index", "route_weight", "weighted_contribution")
    )


def index_daily(routes: DataFrame, detailed: bool = False, strict_weights: bool = False,
                index_column: str = INDEX) -> DataFrame:
    """Weighted mean of the route indices per travel date, rounded to 2 decimals.

    Weights of routes without an index stay in the denominator unless `strict_weights` is set. The default adds the
    change in percent; `detailed` gives mean route fare and observations instead. Rows come in no order.
    """
    weight = F.col("route_weight")
    if strict_weights:
        weight = F.when(F.col("weighted_contribution").isNotNull(), weight)
    aggs = [
        F.coalesce(F.sum("weighted_contribution"), F.lit(0.0)).alias("weighted_index"),
        F.coalesce(F.sum(weight), F.lit(0.0)).alias("available_weight"),
        F.count_distinct("route").alias("route_count"),
    ]
    if detailed:
        aggs += [F.avg("average_fare").alias("average_fare"), F.sum("observation_count").alias("total_observations")]
    value = F.when(F.col("available_weight") > 0, C.half_even(F.try_divide("weighted_index", "available_weight"), 2))
    out = routes.groupBy("outbound_date").agg(*aggs).withColumn(index_column, value)
    if detailed:
        out = out.select("outbound_date", index_column, F.col("available_weight").alias("total_route_weight"),
                         "average_fare", "route_count", "total_observations")
    else:
        out = pct_change(out, index_column, ["outbound_date"], None, f"{index_column}_change_pct")
    return out


def _index_period(daily: DataFrame, period: str, key: Column, detailed: bool, index_column: str) -> DataFrame:
    value = F.avg(index_column)
    if detailed:
        aggs = [C.half_even(value, 2).alias(index_column), F.avg("average_fare").alias("average_fare"),
                F.avg("route_count").alias("route_count"), F.sum("total_observations").alias("observations")]
    else:
        aggs = [value.alias(index_column), F.sum("route_count").alias("observations")]
    return daily.groupBy(key.alias(period)).agg(*aggs)


def index_weekly(daily: DataFrame, detailed: bool = False, index_column: str = INDEX) -> DataFrame:
    """Mean of the daily index per Monday week; the default adds the change in percent."""
    out = _index_period(daily, "week_start", C.week_start("outbound_date"), detailed, index_column)
    if not detailed:
        out = pct_change(out, index_column, ["week_start"], None, f"{index_column}_change_pct")
    return out.orderBy("week_start")


def index_monthly(daily: DataFrame, detailed: bool = False, index_column: str = INDEX) -> DataFrame:
    """Mean of the daily index per calendar month."""
    return _index_period(daily, "month", C.month_key("outbound_date"), detailed, index_column).orderBy("month")


def index_changes(df: DataFrame, index_column: str = INDEX, order: str = "outbound_date") -> DataFrame:
    """First difference and change in percent of an index with one row per period."""
    rows = with_previous(df, [order], {"_before": index_column})
    return rows.withColumn("index_change", F.col(index_column) - F.col("_before")).withColumn(
        "index_change_pct", C.change_pct(index_column, "_before")
    ).drop("_before")


def index_bundle(df: DataFrame, weights: DataFrame | dict[str, float] | None = None,
                 index_column: str = INDEX) -> dict[str, DataFrame]:
    """All index tables of the detailed form plus the base period."""
    routes = index_route_daily(df, weights, detailed=True)
    daily = index_daily(routes, detailed=True, index_column=index_column)
    return {
        "base_period": base_period(df),
        "daily_route": routes,
        "daily": index_changes(daily, index_column),
        "weekly": index_weekly(daily, True, index_column),
        "monthly": index_monthly(daily, True, index_column),
    }


def trend_simple(df: DataFrame | RollUp, date_column: str = "outbound_date", index_column: str = INDEX) -> DataFrame:
    """Unweighted index: mean fare of a date as a percentage of the mean fare of the first date."""
    if isinstance(df, RollUp):
        daily = df.fare_stats([date_column]).select(F.col(date_column).alias("date"), F.col("average_fare").alias("_fare"))
        daily = daily.dropna()
    else:
        daily = (
            df.select(C.day(date_column).alias("date"), "total_fare").dropna()
            .groupBy("date").agg(F.avg("total_fare").alias("_fare"))
        )
    first = daily.select(F.min_by("_fare", "date")).scalar()
    out = daily.withColumn("_base", first).filter(F.col("_base") > 0)
    return out.select("date", C.half_even(C.share("_fare", "_base"), 2).alias(index_column)).orderBy("date")


def trend_rollup(trend: DataFrame, mode: str = "week", index_column: str = INDEX) -> DataFrame:
    """Re-average a trend to Monday weeks (`week`) or month starts (`month`), rounded to 2 decimals."""
    key = C.week_start("date") if mode == "week" else C.month_start("date")
    value = C.half_even(F.avg(F.coalesce(index_column, F.lit(0.0))), 2)
    return trend.groupBy(key.alias("date")).agg(value.alias(index_column)).orderBy("date")


def trend_activity(trend: DataFrame, observations: DataFrame, date_column: str = "collection_timestamp") -> DataFrame:
    """Trend rows with the number of observations on their date, zero if none."""
    when = C.day(date_column)
    if date_column != "outbound_date" and "outbound_date" in observations.columns:
        when = F.coalesce(when, C.day("outbound_date"))
    counts = observations.select(when.alias("date")).dropna().groupBy("date").agg(F.count("*").alias("activity"))
    out = trend.join(counts, "date", "left")
    return out.select(*trend.columns, F.coalesce("activity", F.lit(0)).alias("activity")).orderBy("date")


def index_latest(daily: DataFrame, date_column: str = "outbound_date", index_column: str = INDEX) -> DataFrame:
    """One row: latest index, the one before, change in percent (0 if there is none) and the range of the series."""
    rows = daily.filter(C.present([date_column, index_column])).withColumn(
        "_before", F.lag(index_column).over(W.orderBy(date_column))
    )
    out = rows.agg(
        F.max_by(index_column, date_column).alias(index_column),
        F.max_by("_before", date_column).alias("previous"),
        F.min(index_column).alias("minimum"),
        F.max(index_column).alias("maximum"),
    )
    change = F.coalesce(C.change_pct(index_column, "previous"), F.lit(0.0))
    return out.select(index_column, "previous", change.alias("change_pct"), "minimum", "maximum")


def market_signal(trend: DataFrame, date_column: str = "date", index_column: str = INDEX) -> DataFrame:
    """Per trend row: change, signal, direction and meter position."""
    before = F.lag(index_column).over(W.orderBy(date_column))
    rows = trend.withColumn("change_pct", F.coalesce(C.change_pct(index_column, before), F.lit(0.0)))
    value, change = F.col(index_column), F.col("change_pct")
    signal = (
        F.when(value >= 110, "ELEVATED").when(change > 2, "RISING").when(value < 95, "BELOW BASE").otherwise("STABLE")
    )
    direction = F.when(change > 0.25, "RISING").when(change < -0.25, "EASING").otherwise("STABLE")
    meter = F.greatest(F.lit(5.0), F.least(F.lit(100.0), (value - 85) / 40 * 100))
    return rows.select(
        date_column, index_column, "change_pct", signal.alias("signal"), direction.alias("direction"),
        meter.alias("meter_pct"),
    ).orderBy(date_column)


def route_status(routes: DataFrame) -> DataFrame:
    """Status of each row of a route summary by volatility, then by average fare."""
    vol, fare = F.coalesce("volatility_pct", F.lit(0.0)), F.coalesce("average_fare", F.lit(0.0))
    status = F.when(vol >= 15, "HIGH VOLATILITY").when(fare >= 10000, "HIGH FARE").otherwise("NORMAL")
    return routes.withColumn("status", status)


def semi_base_routes(df: DataFrame, base: DataFrame) -> DataFrame:
    """Observations of routes that have a base fare."""
    return df.join(base.select("route"), "route", "left_semi")


def backtest_series(df: DataFrame, weights: DataFrame | dict[str, float] | None = None,
                    index_column: str = INDEX) -> DataFrame:
    """Daily index over routes with a base fare, with changes; empty when there are fewer than two travel dates."""
    data = semi_base_routes(df, base_fares(df))
    when = base_period(df).scalar()
    daily = index_daily(index_route_daily(data, weights, detailed=True), detailed=True, index_column=index_column)
    # Two distinct dates exist exactly when the last one lies after the first.
    last = df.select(F.max("outbound_date")).scalar()
    return index_changes(daily, index_column).filter(last > when).orderBy("outbound_date")


def backtest_metrics(actual: DataFrame, benchmark: DataFrame, date_column: str = "date",
                     value_column: str = "value") -> DataFrame:
    """One row of error, correlation and direction measures for two dated series.

    Dates missing on either side are left out. Correlation needs two dates and some variation on both sides,
    direction three dates; otherwise they are null.
    """
    a = actual.select(F.col(date_column).alias("date"), C.number(value_column).alias("a"))
    b = benchmark.select(F.col(date_column).alias("date"), C.number(value_column).alias("b"))
    pairs = a.join(b, "date").dropna()
    order = W.orderBy("date")
    err = F.col("a") - F.col("b")
    rows = pairs.withColumn("_da", F.signum(F.col("a") - F.lag("a").over(order))).withColumn(
        "_db", F.signum(F.col("b") - F.lag("b").over(order))
    )
    out = rows.agg(
        F.count("*").alias("n"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.avg(F.abs(F.try_divide(err, F.col("b")))) * 100).alias("mape"),
        F.covar_samp("a", "b").alias("_cov"),
        F.stddev_samp("a").alias("_sa"),
        F.stddev_samp("b").alias("_sb"),
        (F.avg((F.col("_da") == F.col("_db")).cast("double")) * 100).alias("_dir"),
    )
    corr = F.when(F.col("n") >= 2, F.try_divide("_cov", F.col("_sa") * F.col("_sb")))
    direction = F.when(F.col("n") >= 3, F.col("_dir"))
    return out.select(
        *[C.half_even(c, 4).alias(c) for c in ("mae", "rmse", "mape")],
        C.half_even(corr, 4).alias("correlation"),
        C.half_even(direction, 2).alias("directional_accuracy_pct"),
    )
