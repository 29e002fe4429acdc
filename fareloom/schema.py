"""Canonical schemas and the driver-side column checks."""
from __future__ import annotations

from pyspark.sql import DataFrame, types as T

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
DAY, TS, TEXTS = T.DateType(), T.TimestampType(), T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SEARCH = _struct(
    id=L, origin=S, destination=S, outbound_date=DAY, return_date=DAY, currency=S, searched_at=TS, request_id=S
)

OPTION = _struct(
    id=L, search_id=L, origin=S, destination=S, outbound_date=DAY, return_date=DAY, price=D, currency=S,
    total_duration_minutes=D, flight_type=S, airline=S, stops=I, carbon_emissions_kg=D, booking_token=S,
    collected_at=TS,
)

# A collected observation as stored one-per-file; every field arrives as text or number and is coerced later.
OBSERVATION = _struct(
    record_id=S, collection_timestamp=S, source=S, source_engine=S, departure_airport=S, arrival_airport=S,
    route=S, outbound_date=S, return_date=S, advance_purchase_days=S, airline=S, flight_numbers=TEXTS,
    departure_time=S, arrival_time=S, duration_minutes=S, stops=S, travel_class=S, base_fare=S, taxes_fees=S,
    total_fare=S, price=S, currency=S, seats_available=S, sold_out=B, availability_details=TEXTS,
)

PROCESSED = _struct(
    record_id=S, search_id=L, origin=S, destination=S, route=S, outbound_date=DAY, return_date=DAY,
    collection_timestamp=TS, collection_date=DAY, advance_purchase_days=I, booking_window_category=S, airline=S,
    flight_type=S, currency=S, price=D, total_fare=D, stops=I, total_duration_minutes=D, is_weekend=B,
    fare_outlier=B,
)

_AIRPORT_END = _struct(id=S, time=S)
_SEGMENT = _struct(
    airline=S, flight_number=S, travel_class=S, departure_airport=_AIRPORT_END, arrival_airport=_AIRPORT_END
)
# `price`, `total_duration` and `extensions` stay text: bad values turn to null instead of failing the row.
_ITINERARY = _struct(price=S, total_duration=S, extensions=S, flights=T.ArrayType(_SEGMENT))
RESPONSE = _struct(best_flights=T.ArrayType(_ITINERARY), other_flights=T.ArrayType(_ITINERARY))

# A landed response: the search it answers plus the untouched body.
LANDED = _struct(
    search_id=L, departure_airport=S, arrival_airport=S, outbound_date=S, return_date=S, currency=S,
    collected_at=S, body=S,
)


# Partition column of observations that are laid out by month of travel.
TRAVEL = "travel_month_key"


def require_columns(df: DataFrame, required: list[str], what: str = "input") -> DataFrame:
    """Return `df` unchanged, or raise naming the columns it lacks."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"Missing {what} columns: {', '.join(missing)}")
    return df


def has_columns(df: DataFrame, *names: str) -> bool:
    return set(names) <= set(df.columns)
