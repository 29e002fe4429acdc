"""Coercion, normalisation and row validation."""
from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from fareloom import fixed
from fareloom.functions import columns as C
from fareloom.operators.identity import keep_last
from fareloom.operators.stats import median
from fareloom.schema import has_columns, require_columns

# Columns by treatment; a table is touched only where it has them.
TEXT_COLUMNS = ["source", "source_engine", "departure_airport", "arrival_airport", "route", "airline", "travel_class",
                "currency"]
DATE_COLUMNS = ["outbound_date", "return_date"]
INSTANT_COLUMNS = ["collection_timestamp"]
NUMBER_COLUMNS = ["advance_purchase_days", "duration_minutes", "stops", "base_fare", "taxes_fees", "total_fare",
                  "price", "seats_available"]
SERVED_DATES = ["collection_date", "outbound_date", "return_date"]
SERVED_INSTANTS = ["collection_timestamp", "search_timestamp", "searched_at"]
SERVED_NUMBERS = ["total_fare", "price", "base_fare", "taxes_fees", "advance_purchase_days", "stops",
                  "total_duration_minutes", "duration_minutes", "carbon_emissions_kg", "seats_available",
                  "route_average_fare", "fare_vs_route_average_pct", "route_airline_count", "route_observation_count"]
CRITICAL_COLUMNS = ["record_id", "departure_airport", "arrival_airport", "outbound_date", "airline", "total_fare"]


def _apply(df: DataFrame, names: list[str], rule) -> DataFrame:
    return df.withColumns({c: rule(c) for c in names if c in df.columns})


def normalize_text(df: DataFrame, columns: list[str] | None = None, empty_for_null: bool = True) -> DataFrame:
    """Trim and collapse white space in text columns."""
    return _apply(df, columns or TEXT_COLUMNS, C.text_or_empty if empty_for_null else C.squash_text)


def coerce_types(df: DataFrame, numbers: list[str] | None = None, dates: list[str] | None = None,
                 instants: list[str] | None = None) -> DataFrame:
    """Cast numeric, date and timestamp columns; unreadable values become null."""
    df = _apply(df, NUMBER_COLUMNS if numbers is None else numbers, C.number)
    df = _apply(df, DATE_COLUMNS if dates is None else dates, C.day)
    return _apply(df, INSTANT_COLUMNS if instants is None else instants, C.instant)


def normalize_airports(df: DataFrame, columns: tuple[str, ...] = ("departure_airport", "arrival_airport")) -> DataFrame:
    """Upper-case and trim airport codes; null becomes empty."""
    return _apply(df, list(columns), C.code)


def normalize_airlines(df: DataFrame) -> DataFrame:
    """Trim carrier names; null or empty becomes UNKNOWN."""
    return _apply(df, ["airline"], lambda c: F.coalesce(C.blank_to_null(F.trim(c)), F.lit("UNKNOWN")))


def build_route(df: DataFrame, origin: str = "origin", destination: str = "destination",
                only_if_absent: bool = False) -> DataFrame:
    """Add `route` as ORIGIN-DESTINATION."""
    if not has_columns(df, origin, destination) or (only_if_absent and "route" in df.columns):
        return df
    return df.withColumn("route", C.route_of(origin, destination))


def parse_route(df: DataFrame, route: str = "route") -> DataFrame:
    """Add `route_origin` and `route_destination`, empty where the route lacks the part."""
    return df.withColumns({"route_origin": C.route_part(route, 1), "route_destination": C.route_part(route, 2)})


def validate_fares(df: DataFrame) -> DataFrame:
    """Null out fares and prices that are not positive."""
    return _apply(df, ["total_fare", "price"], C.positive)


def resolve_fare(df: DataFrame, per_row: bool = False) -> DataFrame:
    """Fill `total_fare` from `price` when the column is absent, or per row from price, then average fare."""
    if per_row:
        sources = [c for c in ("total_fare", "price", "average_fare") if c in df.columns]
        return df.withColumn("total_fare", F.coalesce(*[C.number(c) for c in sources]))
    if "total_fare" not in df.columns and "price" in df.columns:
        return df.withColumn("total_fare", F.col("price"))
    return df


def validate_dataset(df: DataFrame, report: Observation | None = None) -> DataFrame:
    """Keep rows with route, travel date and a positive fare; counts of rows in and excluded go to `report`."""
    require_columns(df, ["route", "outbound_date", "total_fare"], "analytical")
    valid = F.col("route").isNotNull() & F.col("outbound_date").isNotNull() & F.coalesce(
        F.col("total_fare") > 0, F.lit(False)
    )
    if report is not None:
        df = df.observe(report, F.count("*").alias("rows"), F.count_if(~valid).alias("excluded"))
    return df.filter(valid)


def normalize_dataset(df: DataFrame) -> DataFrame:
    """Coerce what is present, resolve fare and route, trim the carrier and keep positive fares."""
    df = coerce_types(df, SERVED_NUMBERS, SERVED_DATES, SERVED_INSTANTS)
    df = build_route(resolve_fare(df), only_if_absent=True)
    df = _apply(df, ["airline"], lambda c: F.trim(F.col(c).cast("string")))
    return df.filter(F.col("total_fare") > 0) if "total_fare" in df.columns else df


def handle_missing(df: DataFrame) -> DataFrame:
    """Drop rows lacking a critical value; fill duration by its median, stops and lead by 0, currency by default."""
    kept = df.filter(C.present([c for c in CRITICAL_COLUMNS if c in df.columns]))
    if "duration_minutes" in df.columns:
        middle = median(kept, [], "duration_minutes", "m").scalar()
        kept = kept.withColumn("duration_minutes", F.coalesce("duration_minutes", middle))
    kept = _apply(kept, ["stops", "advance_purchase_days"], lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int"))
    return _apply(kept, ["currency"], lambda c: F.coalesce(C.blank_to_null(c), F.lit(fixed.DEFAULT_CURRENCY)))


def organize_columns(df: DataFrame, add: dict[str, str] | None = None, constants: dict[str, str] | None = None,
                     preferred: list[str] | None = None) -> DataFrame:
    """Preferred columns first, the rest after; `add` creates absent columns as null, `constants` sets texts."""
    missing = {c: F.lit(None).cast(kind) for c, kind in (add or {}).items() if c not in df.columns}
    df = df.withColumns({**missing, **{c: F.lit(v) for c, v in (constants or {}).items()}})
    first = [c for c in (preferred or fixed.PREFERRED_COLUMNS) if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


# Columns that search and option tables must have, and those without which a row is dropped.
SEARCH_COLUMNS = ["id", "origin", "destination", "outbound_date", "return_date", "currency", "searched_at"]
SEARCH_REQUIRED = ["id", "origin", "destination", "outbound_date", "searched_at"]
OPTION_COLUMNS = [
    "id", "search_id", "origin", "destination", "outbound_date", "return_date", "price", "currency",
    "total_duration_minutes", "flight_type", "airline", "stops", "carbon_emissions_kg", "booking_token", "collected_at",
]
OPTION_REQUIRED = ["id", "search_id", "origin", "destination", "outbound_date", "price", "airline", "collected_at"]


def clean_searches(df: DataFrame) -> DataFrame:
    """Clean search rows, drop incomplete ones and same-airport routes; the latest row of an id wins."""
    require_columns(df, SEARCH_COLUMNS, "search")
    df = normalize_text(df, ["origin", "destination", "currency", "request_id"], empty_for_null=False)
    df = coerce_types(df, [], ["outbound_date", "return_date"], ["searched_at"])
    df = df.withColumn("id", C.number("id").cast("long"))
    df = df.filter(C.present(SEARCH_REQUIRED))
    df = df.withColumns({"origin": F.upper("origin"), "destination": F.upper("destination")})
    return keep_last(df.filter(F.col("origin") != F.col("destination")), ["id"], ["searched_at"])


def clean_options(df: DataFrame) -> DataFrame:
    """Clean option rows: texts, codes, types; drop incomplete rows and prices that are not positive."""
    require_columns(df, OPTION_COLUMNS, "option")
    df = normalize_text(df, ["origin", "destination", "currency", "flight_type", "airline", "booking_token"],
                        empty_for_null=False)
    df = _apply(df, ["origin", "destination", "currency"], F.upper)
    df = coerce_types(df, ["id", "search_id", "price", "total_duration_minutes", "stops", "carbon_emissions_kg"],
                      ["outbound_date", "return_date"], ["collected_at"])
    df = df.filter(C.present(OPTION_REQUIRED)).filter(F.col("price") > 0)
    stops = F.when(F.col("stops") >= 0, F.col("stops"))
    return df.withColumns({
        "id": F.col("id").cast("long"),
        "search_id": F.col("search_id").cast("long"),
        "stops": F.coalesce(stops, F.lit(0)).cast("int"),
        "total_duration_minutes": C.positive("total_duration_minutes"),
    })
