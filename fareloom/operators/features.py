"""Row-wise derived features."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fareloom import fixed
from fareloom.functions import columns as C


def advance_days(df: DataFrame, collected: str = "collection_timestamp", travel: str = "outbound_date",
                 output: str = "advance_purchase_days") -> DataFrame:
    """Days from collection to travel, at least 0."""
    return df.withColumn(output, C.lead_days(travel, collected))


def booking_window(df: DataFrame, days: str = "advance_purchase_days", output: str = "booking_window_category",
                   limited: bool = False) -> DataFrame:
    """Booking-lead label; `limited` leaves leads beyond 9999 days unlabelled."""
    return df.withColumn(output, C.booking_window(days, fixed.BOOKING_UPPER_LIMIT if limited else None))


def booking_features(df: DataFrame) -> DataFrame:
    """Collection timestamp and date, lead days and booking-lead label from `collected_at`."""
    df = df.withColumns({"collection_timestamp": F.col("collected_at"), "collection_date": C.day("collected_at")})
    return booking_window(advance_days(df))


def time_features(df: DataFrame, month_name: str = "travel_month_name", day_name: bool = True) -> DataFrame:
    """Calendar parts of the travel date and the collection time; Monday is day 0."""
    made = {}
    if "outbound_date" in df.columns:
        d = F.col("outbound_date")
        made = {
            "travel_year": F.year(d), "travel_month": F.month(d), "travel_week": F.weekofyear(d),
            "travel_day": F.day(d), "travel_day_of_week": F.weekday(d), "is_weekend": F.weekday(d) >= 5,
            month_name: F.date_format(d, "MMMM"),
        }
        if day_name:
            made["travel_day_name"] = F.date_format(d, "EEEE")
    if "collection_timestamp" in df.columns:
        made["collection_date"] = C.day("collection_timestamp")
        made["collection_hour"] = F.hour("collection_timestamp")
    return df.withColumns(made)


def fare_features(df: DataFrame, six_bands: bool = False) -> DataFrame:
    """Fare band and log fare. The seven-band form first sets the total fare to the price rounded to 2 decimals."""
    if six_bands:
        edges, labels = fixed.FARE_BAND6_EDGES, fixed.FARE_BAND6_LABELS
    else:
        edges, labels = fixed.FARE_BAND_EDGES, fixed.FARE_BAND_LABELS
        df = df.withColumn("total_fare", C.half_even("price", 2))
    return df.withColumns({
        "fare_band": C.label_right_closed("total_fare", edges, labels), "log_fare": F.log1p("total_fare"),
    })
