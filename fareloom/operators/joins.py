"""Look-ups that complete observations."""
from __future__ import annotations

from pyspark.sql import DataFrame

# Search columns carried over and the names they take.
LOOKUP_NAMES = {"id": "search_id", "currency": "search_currency", "searched_at": "search_timestamp",
                "request_id": "search_request_id"}


def join_search_metadata(searches: DataFrame, options: DataFrame) -> DataFrame:
    """Options with currency, time and request id of their search; options without a search are kept."""
    lookup = searches.select(*[c for c in LOOKUP_NAMES if c in searches.columns]).withColumnsRenamed(LOOKUP_NAMES)
    return options.join(lookup, "search_id", "left")


def semi_selected_routes(df: DataFrame, routes: DataFrame) -> DataFrame:
    """Observations whose route is among the selected ones."""
    return df.join(routes.select("route"), "route", "left_semi")
