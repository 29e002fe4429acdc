"""Data-quality reports and one-row fare summaries."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fareloom import fixed
from fareloom.functions import columns as C
from fareloom.operators.price_index import INDEX, index_latest
from fareloom.operators.rollup import RollUp


def _duplicates(df: DataFrame, key: str = "record_id"):
    """Rows beyond the first of their key, a null key counting as one value."""
    per_key = df.groupBy(key).agg(F.count("*").alias("n"))
    return per_key.select(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).scalar()


def _by_group(df: DataFrame, groups: list[str], aggs: dict):
    """Pre-aggregate by the columns to be counted distinct, so distinct counting sees one row per combination."""
    return df.groupBy(*groups).agg(*[a.alias(n) for n, a in aggs.items()])


def quality_report(df: DataFrame) -> DataFrame:
    """One row: rows, columns, duplicate ids, missing fares and carriers, negative fares, distinct routes, carriers."""
    counted = _by_group(df, ["route", "airline"], {
        "rows": F.count("*"),
        "no_fare": F.count_if(F.col("total_fare").isNull()),
        "negative": F.count_if(F.col("total_fare") < 0),
    })
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = counted.agg(
        total("rows").alias("rows"),
        F.lit(len(df.columns)).cast("long").alias("columns"),
        total("no_fare").alias("missing_total_fare"),
        total(F.when(F.col("airline").isNull(), F.col("rows"))).alias("missing_airline"),
        total("negative").alias("negative_fares"),
        F.count_distinct("route").alias("unique_routes"),
        F.count_distinct("airline").alias("unique_airlines"),
    )
    dup = _duplicates(df) if "record_id" in df.columns else F.lit(None).cast("long")
    return out.withColumn("duplicate_record_ids", dup).select(
        "rows", "columns", "duplicate_record_ids", "missing_total_fare", "missing_airline", "negative_fares",
        "unique_routes", "unique_airlines",
    )


def quality_summary(df: DataFrame) -> DataFrame:
    """One row: records, duplicates by id, outliers, missing values, distinct counts, completeness over all cells."""
    filled = sum((F.count(c) for c in df.columns[1:]), F.count(df.columns[0]))
    outlier = F.count_if("fare_outlier") if "fare_outlier" in df.columns else F.lit(0).cast("long")
    counted = _by_group(df, ["route", "airline"], {
        "records": F.count("*"), "outliers": outlier,
        "no_fare": F.count_if(F.col("total_fare").isNull()), "filled": filled,
    })
    out = counted.agg(
        F.coalesce(F.sum("records"), F.lit(0)).alias("records"),
        F.coalesce(F.sum("outliers"), F.lit(0)).alias("outliers"),
        F.coalesce(F.sum("no_fare"), F.lit(0)).alias("missing_fare"),
        F.coalesce(F.sum(F.when(F.col("airline").isNull(), F.col("records"))), F.lit(0)).alias("missing_airline"),
        F.count_distinct("route").alias("routes"),
        F.count_distinct("airline").alias("airlines"),
        F.sum("filled").alias("_filled"),
    )
    cells = F.col("records") * len(df.columns)
    dup = _duplicates(df) if "record_id" in df.columns else F.lit(0).cast("long")
    return out.select(
        "records", dup.alias("duplicates"), "outliers", "missing_fare", "missing_airline", "routes", "airlines",
        F.coalesce(C.half_even(C.share("_filled", cells), 2), F.lit(0.0)).alias("completeness_pct"),
    )


# Fields whose presence makes up the completeness of a filtered view.
KEY_FIELDS = ["route", "airline", "outbound_date", "total_fare", "collection_timestamp"]


def quality_filtered(df: DataFrame) -> DataFrame:
    """One row for a filtered view: duplicates by route, carrier, date and fare; completeness over five key fields."""
    present = {c: F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in KEY_FIELDS if c in df.columns}
    filled = sum((F.count_if(p) for p in present.values()), F.lit(0).cast("long"))
    outlier = F.count_if("fare_outlier") if "fare_outlier" in df.columns else F.lit(0).cast("long")
    keyed = df.groupBy("route", "airline", C.day("outbound_date").alias("_d"), "total_fare").agg(
        F.count("*").alias("n"), outlier.alias("outliers"), filled.alias("filled")
    )
    zero = F.lit(0)
    out = keyed.agg(
        F.coalesce(F.sum("n"), zero).alias("records"),
        F.coalesce(F.sum(F.col("n") - 1), zero).alias("duplicates"),
        F.coalesce(F.sum("outliers"), zero).alias("outliers"),
        F.coalesce(F.sum(F.when(F.col("total_fare").isNull(), F.col("n"))), zero).alias("missing_fare"),
        F.sum("filled").alias("_filled"),
    )
    cells = F.col("records") * len(KEY_FIELDS)
    return out.select("records", "duplicates", "outliers", "missing_fare",
                      F.coalesce(C.share("_filled", cells), F.lit(0.0)).alias("completeness_pct"))


def status_summary(df: DataFrame, ok: str = "operational") -> DataFrame:
    """One row: record count and a label, `no-data` when there are none."""
    return df.agg(F.count("*").alias("records")).withColumn(
        "status", F.when(F.col("records") > 0, ok).otherwise("no-data")
    )


def _fare_counts(df: DataFrame | RollUp) -> DataFrame:
    groups = ["route", "airline", "outbound_date"]
    combos = df.combinations(groups) if isinstance(df, RollUp) else _by_group(df, groups, {
        "n": F.count("*"), "fares": F.count("total_fare"), "total": F.sum("total_fare"),
        "low": F.min("total_fare"), "high": F.max("total_fare"),
        "latest": F.max("collection_timestamp") if "collection_timestamp" in df.columns
        else F.lit(None).cast("timestamp"),
    })
    # Distinct values are counted over the combinations, a far smaller table than the observations.
    return combos.agg(
        F.try_divide(F.sum("total"), F.sum("fares")).alias("average_fare"),
        F.min("low").alias("minimum_fare"), F.max("high").alias("maximum_fare"),
        F.count_distinct("route").alias("routes"), F.count_distinct("airline").alias("airlines"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("observations"),
        F.count_distinct("outbound_date").alias("travel_dates"), F.max("latest").alias("updated_at"),
    )


def fare_summary(df: DataFrame | RollUp, index: DataFrame | None = None, index_column: str = INDEX,
                 rounded: bool = True) -> DataFrame:
    """One row: fares, distinct counts, latest collection, current index and its change.

    Without an index table the index is the unweighted trend of the observations. A roll-up needs an index table, and
    route, carrier and travel date as dimensions.
    """
    if index is None:
        source, when = _unrounded_trend(df, index_column), "date"
    else:
        source, when = index, "outbound_date"
    latest = index_latest(source, when, index_column).select(F.struct("*")).scalar()
    current = F.coalesce(latest.getField(index_column), F.lit(fixed.BASE_INDEX))
    change = F.coalesce(latest.getField("change_pct"), F.lit(0.0))
    out = _fare_counts(df).withColumns({index_column: current, f"{index_column}_change": change})
    decimals = [index_column, f"{index_column}_change", "average_fare", "minimum_fare", "maximum_fare"]
    if rounded:
        out = out.withColumns({c: F.coalesce(C.half_even(c, 2), F.lit(0.0)) for c in decimals})
    return out.select(*decimals, "routes", "airlines", "observations", "travel_dates", "updated_at")


def _unrounded_trend(df: DataFrame, index_column: str) -> DataFrame:
    daily = df.select(C.day("outbound_date").alias("date"), "total_fare").dropna()
    daily = daily.groupBy("date").agg(F.avg("total_fare").alias("_fare"))
    base = daily.select(F.min_by("_fare", "date")).scalar()
    return daily.select("date", C.share(F.col("_fare"), base).alias(index_column))


def national_snapshot(df: DataFrame | RollUp, daily: DataFrame, routes: DataFrame, index_column: str = INDEX) -> DataFrame:
    """One row: generation time, index and change, fares, counts, dearest and cheapest route."""
    latest = index_latest(daily, "outbound_date", index_column).select(F.struct("*")).scalar()
    change = F.when(latest.getField("previous") != 0, latest.getField("change_pct"))
    # Equal averages are told apart by route name: the first name wins on both ends.
    ends = routes.select(F.struct(
        F.min_by("route", F.struct(-F.col("average_fare"), F.col("route"))).alias("highest"),
        F.min_by("route", F.struct(F.col("average_fare"), F.col("route"))).alias("lowest"),
    )).scalar()
    return _fare_counts(df).select(
        F.current_timestamp().alias("generated_at"),
        latest.getField(index_column).alias(index_column),
        change.alias(f"{index_column}_change_pct"),
        "average_fare", "minimum_fare", "maximum_fare", "routes", "airlines", "observations", "travel_dates",
        ends.getField("highest").alias("highest_average_fare_route"),
        ends.getField("lowest").alias("lowest_average_fare_route"),
    )
