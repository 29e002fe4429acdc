"""Building the processed observations."""
from __future__ import annotations

from pyspark.sql import DataFrame

from fareloom.operators import cleaning as clean, features as feat, identity, market
from fareloom.operators.joins import join_search_metadata
from fareloom.session import materialise
from fareloom.sources.writers import write_dual, write_laid_out

# Fields every processed observation has, and their types.
OPTIONAL_FIELDS = {"base_fare": "double", "taxes_fees": "double", "departure_time": "string", "arrival_time": "string",
                   "travel_class": "string", "seats_available": "int", "sold_out": "boolean"}


def clean_dataset(df: DataFrame) -> DataFrame:
    """Clean collected observations: texts, types, codes, fares, duplicates, gaps, outlier flag; oldest first.

    Duplicates go before incomplete rows do, so a bad last copy takes its good predecessors with it.
    """
    out = clean.coerce_types(clean.normalize_text(df))
    out = clean.normalize_airlines(clean.normalize_airports(out))
    out = clean.validate_fares(clean.build_route(out, "departure_airport", "arrival_airport"))
    # The unique rows are read several times below (medians, quartiles, result), so they are computed once.
    out = materialise(identity.dedup_records(out), "unique")
    out = market.outlier_global_iqr(clean.handle_missing(out))
    # Rows of one time are ordered by their identity, so that a time with very many rows is split over tasks.
    order = [c for c in ("collection_timestamp", "record_id", "route", "outbound_date", "airline") if c in out.columns]
    return out.orderBy(*order) if "collection_timestamp" in out.columns else out


def preprocess_dataset(df: DataFrame) -> DataFrame:
    """Features of cleaned observations: calendar, booking lead, fare, route context."""
    out = feat.time_features(df, month_name="month_name", day_name=False)
    if "advance_purchase_days" in out.columns:
        out = feat.booking_window(out, limited=True)
    out = feat.fare_features(out, six_bands=True)
    return market.market_features(out, carriers="airline_competition_count", counted="route")


def build_dataset(searches: DataFrame, options: DataFrame, source: str | None = None,
                  source_engine: str | None = None) -> DataFrame:
    """Processed observations from cleaned searches and options, in the preferred column order."""
    out = clean.build_route(join_search_metadata(searches, options))
    out = feat.fare_features(feat.time_features(feat.booking_features(out)))
    # Route statistics read the unique rows again, two or three columns at a time.
    out = materialise(identity.record_id(identity.dedup_observations(out)), "unique")
    out = market.market_features(market.outlier_route_iqr(out))
    constants = {k: v for k, v in (("source", source), ("source_engine", source_engine)) if v is not None}
    return clean.organize_columns(out, OPTIONAL_FIELDS, constants)


def write_dataset(df: DataFrame, cleaned_folder: str, processed_folder: str, laid_out: str | None = None) -> None:
    """Store the processed observations twice, as the cleaned and as the analytical table; they are computed once.

    `laid_out` is the path of a third copy for the query layer, by month of travel (`writers.write_laid_out`).
    """
    done = materialise(df, "observations")
    write_dual(done, cleaned_folder, "observations_cleaned", staged=True)
    write_dual(done, processed_folder, "observations_processed", staged=True)
    if laid_out:
        write_laid_out(done, laid_out)
