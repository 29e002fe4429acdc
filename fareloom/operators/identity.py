"""Deterministic keys and duplicate removal."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fareloom.functions import columns as C

# Fields that identify a collected observation (price in, collection time out).
FINGERPRINT_FIELDS = ["departure_airport", "arrival_airport", "outbound_date", "return_date", "airline",
                      "flight_numbers", "departure_time", "arrival_time", "duration_minutes", "stops", "travel_class",
                      "total_fare", "currency", "source", "source_engine"]
# Fields that identify a processed observation, the second being the collection day.
RECORD_FIELDS = ["search_id", "observation_date", "origin", "destination", "outbound_date", "return_date", "airline",
                 "price", "currency", "total_duration_minutes", "flight_type", "stops"]
# Duplicate key used when a table has no record id.
FALLBACK_FIELDS = ["departure_airport", "arrival_airport", "outbound_date", "airline", "price", "departure_time"]


def _keep(df: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    # The row itself is what is compared: order columns first, the others after.
    first = [c for c in order if c not in keys]
    ranked = F.struct(*first, *[c for c in rest if c not in first])
    best = df.groupBy(*keys).agg(pick(ranked).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns])


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by `order`, then by all other columns so that the choice is total.

    An aggregate rather than a ranked window: copies of a key combine before the shuffle, so a key holding a large
    part of all rows costs one row per task. Null keys equal each other.
    """
    return _keep(df, keys, order, F.max)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by `order`, then by all other columns."""
    return _keep(df, keys, order, F.min)


def record_fingerprint(df: DataFrame, output: str = "record_id") -> DataFrame:
    """SHA-256 of the identity fields as JSON with sorted names and null fields kept."""
    return df.withColumn(output, C.sha256_json(FINGERPRINT_FIELDS))


def record_id(df: DataFrame, output: str = "record_id") -> DataFrame:
    """SHA-256 of the identity fields present, joined by a bar; the collection day is one of them."""
    source = {"observation_date": C.day("collection_timestamp")}
    fields = [source.get(c, F.col(c)) for c in RECORD_FIELDS if c in df.columns or c in source]
    return df.withColumn(output, C.sha256_joined(fields))


def dedup_response(df: DataFrame, order: list[str], within: list[str] | None = None) -> DataFrame:
    """Keep the first of equal fingerprints, within each search if `within` names its columns."""
    if "record_id" not in df.columns:
        df = record_fingerprint(df)
    return keep_first(df, [*(within or []), "record_id"], order)


def dedup_counts(df: DataFrame, within: list[str]) -> DataFrame:
    """Rows, distinct fingerprints and duplicates per search."""
    once = df.groupBy(*within, "record_id").agg(F.count("*").alias("_n"))
    return once.groupBy(*within).agg(
        F.sum("_n").alias("extracted"), F.count("*").alias("unique_records"),
        (F.sum("_n") - F.count("*")).alias("duplicates"),
    )


def dedup_observations(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Keep the last of equal observations of one search and day; the same fare on another day is history."""
    dated = df.withColumn("observation_date", C.day("collection_timestamp"))
    keys = [c for c in RECORD_FIELDS if c in dated.columns]
    return keep_last(dated, keys, order or ["collection_timestamp"]).drop("observation_date")


def dedup_records(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Keep the last row per record id, or per fallback key when the table has no record id."""
    keys = ["record_id"] if "record_id" in df.columns else [c for c in FALLBACK_FIELDS if c in df.columns]
    return keep_last(df, keys, order or [c for c in ["collection_timestamp"] if c in df.columns])


def index_snapshot_hash(df: DataFrame, timestamp: str = "calculated_at", output: str = "snapshot_hash") -> DataFrame:
    """SHA-256 of every column but the calculation time, so that equal results hash alike."""
    return df.withColumn(output, C.sha256_json([c for c in df.columns if c != timestamp]))
