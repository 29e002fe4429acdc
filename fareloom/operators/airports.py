"""Airport master data, directory and endpoints of routes. All inputs hold one row per route or airport."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fareloom import fixed
from fareloom.functions import columns as C


def airport_master(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixed.AIRPORTS, "code string, city string, name string, state string")


def airport_lookup(codes: DataFrame, master: DataFrame) -> DataFrame:
    """City, name and state of each airport code, with defaults for unknown ones."""
    known = master.select("code", F.col("city").alias("_c"), F.col("name").alias("_n"), F.col("state").alias("_s"))
    return codes.join(known, "code", "left").withColumns({
        "city": F.coalesce("_c", "code"),
        "name": F.coalesce("_n", F.concat("code", F.lit(" Airport"))),
        "state": F.coalesce("_s", F.lit("—")),
    }).drop("_c", "_n", "_s")


def endpoints(routes: DataFrame) -> DataFrame:
    """Each route once per non-empty endpoint, with `code` and `role`."""
    ends = F.array(
        F.struct(C.route_part("route", 1).alias("code"), F.lit("origin").alias("role")),
        F.struct(C.route_part("route", 2).alias("code"), F.lit("destination").alias("role")),
    )
    return routes.select("*", F.inline(ends)).filter(F.col("code") != "")


def airport_directory(routes: DataFrame, master: DataFrame) -> DataFrame:
    """Per airport: routes from it, routes to it, distinct routes and the mean of their average fares."""
    per_code = endpoints(routes).groupBy("code").agg(
        F.count_if(F.col("role") == "origin").alias("origin_routes"),
        F.count_if(F.col("role") == "destination").alias("destination_routes"),
        F.count_distinct("route").alias("routes"),
        F.coalesce(F.avg("average_fare"), F.lit(0.0)).alias("average_fare"),
    )
    columns = ["code", "city", "name", "state", "origin_routes", "destination_routes", "routes", "average_fare"]
    return airport_lookup(per_code, master).select(*columns).orderBy("code")


def airport_totals(routes: DataFrame) -> DataFrame:
    """One row: airports, airports with departures, with arrivals, and distinct routes."""
    ends = endpoints(routes)
    by_role = lambda role: F.count_distinct(F.when(F.col("role") == role, F.col("code")))
    return ends.agg(
        F.count_distinct("code").alias("airports"), by_role("origin").alias("origins"),
        by_role("destination").alias("destinations"), F.count_distinct("route").alias("routes"),
    )


def connected_airports(airports: DataFrame, routes: DataFrame) -> DataFrame:
    """Airports with a flag telling whether any of the routes touches them."""
    touched = endpoints(routes.select("route")).select(F.col("code").alias("_code")).distinct()
    return airports.join(touched, F.col("code") == F.col("_code"), "left").withColumn(
        "connected", F.col("_code").isNotNull()
    ).drop("_code")
