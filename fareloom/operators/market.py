"""Route context and outlier flags attached to every observation."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fareloom.functions import columns as C
from fareloom.operators.stats import exact_quantiles
from fareloom.session import attach


def market_features(df: DataFrame, carriers: str = "route_airline_count", counted: str = "record_id") -> DataFrame:
    """Attach mean fare, carriers and rows of the route, and the fare's deviation from that mean in percent.

    The statistics are aggregated per route and joined back, so wide rows are not moved to their route's task.
    """
    rows = F.count(counted if counted in df.columns else "total_fare")
    stats = df.filter(C.present(["route"])).groupBy("route").agg(
        F.avg("total_fare").alias("route_average_fare"),
        F.count_distinct("airline").alias(carriers),
        rows.alias("route_observation_count"),
    )
    return attach(df, stats, ["route"]).withColumn(
        "fare_vs_route_average_pct", C.change_pct("total_fare", "route_average_fare")
    )


def outlier_route_iqr(df: DataFrame, min_group: int = 0, skip_zero_iqr: bool = False) -> DataFrame:
    """Flag fares more than 1.5 interquartile ranges outside the quartiles of their route; rows are kept.

    `min_group` and `skip_zero_iqr` exempt small and constant routes.
    """
    bounds = exact_quantiles(df, ["route"], "total_fare", {"_q1": 0.25, "_q3": 0.75})
    reach = 1.5 * (F.col("_q3") - F.col("_q1"))
    bounds = bounds.withColumns({"_lower": F.col("_q1") - reach, "_upper": F.col("_q3") + reach})
    if skip_zero_iqr:
        bounds = bounds.filter(F.col("_q3") > F.col("_q1"))
    if min_group:
        sizes = df.groupBy("route").agg(F.count("*").alias("_rows")).filter(F.col("_rows") >= min_group)
        bounds = bounds.join(sizes, bounds["route"].eqNullSafe(sizes["route"]), "left_semi")
    flagged = attach(df, bounds.select("route", "_lower", "_upper"), ["route"])
    flag = (F.col("total_fare") < F.col("_lower")) | (F.col("total_fare") > F.col("_upper"))
    return flagged.withColumn("fare_outlier", F.coalesce(flag, F.lit(False))).drop("_lower", "_upper")


def outlier_global_iqr(df: DataFrame) -> DataFrame:
    """Same with the quartiles of the whole table and a lower bound of at least zero."""
    q = exact_quantiles(df, [], "total_fare", {"q1": 0.25, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    low, high = F.greatest(F.lit(0.0), F.col("q1") - reach), F.col("q3") + reach
    bounds = q.select(F.struct(low.alias("low"), high.alias("high"))).scalar()
    flag = (F.col("total_fare") < bounds.getField("low")) | (F.col("total_fare") > bounds.getField("high"))
    return df.withColumn("fare_outlier", F.coalesce(flag, F.lit(False)))
