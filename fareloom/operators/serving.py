"""Query layer: filters, newest-first listings, option lists, search, pages and rankings."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fareloom import fixed
from fareloom.functions import columns as C
from fareloom.operators.aggregates import lenient_window
from fareloom.operators.ordering import numbered, numbered_sums
from fareloom.schema import TRAVEL
from fareloom.session import materialise


def _chosen(value: str | None) -> bool:
    return bool(value) and value.upper() != "ALL"


def _newest_first(df: DataFrame) -> list[Column]:
    """Newest collection first, the other plain columns settling ties."""
    plain = [n for n, t in df.dtypes if n != "collection_timestamp" and not t.startswith(("map", "array", "struct"))]
    return [F.col("collection_timestamp").desc_nulls_last(), *[F.col(n) for n in plain]]


def _travel_months(df: DataFrame, first: str, last: str) -> DataFrame:
    """Leave out the folders of other months, if the table is laid out by month of travel."""
    if TRAVEL not in df.columns:
        return df
    day = lambda x: F.date_format(F.lit(x).cast("date"), "yyyy-MM")
    return df.filter(F.col(TRAVEL) == day(first) if first == last else F.col(TRAVEL).between(day(first), day(last)))


def lead_range(window: str) -> Column:
    """The booking lead of a label as a range of days, which reaches the scan; there is no lower bound to the nearest."""
    if window not in fixed.BOOKING_LABELS:
        return F.lit(False)
    k, days = fixed.BOOKING_LABELS.index(window), F.col("advance_purchase_days")
    held = days.isNotNull()
    if k:
        held = held & (days > fixed.BOOKING_EDGES[k])
    if k + 1 < len(fixed.BOOKING_EDGES):
        held = held & (days <= fixed.BOOKING_EDGES[k + 1])
    return held


def flights_query(df: DataFrame, route: str | None = None, airline: str | None = None,
                  limit: int = fixed.FLIGHTS_DEFAULT_LIMIT, upper_routes: bool = False,
                  most: int | None = fixed.FLIGHTS_MAX_LIMIT, travel: tuple[str, str] | None = None) -> DataFrame:
    """Newest observations of a route and carrier, compared without regard to case.

    `limit` is taken as between 1 and `most`; None for `most` sets no upper end.

    `upper_routes` says that stored routes are upper-case, as processed ones are; the scan can then skip by route.
    `travel` limits the travel dates to a first and last one; of a table laid out by month only those folders are read.
    """
    if travel:
        df = _travel_months(df, *travel).filter(F.col("outbound_date").between(*[F.lit(x).cast("date") for x in travel]))
    if _chosen(route):
        stored = F.col("route") if upper_routes else F.upper("route")
        df = df.filter(stored == route.upper())
    if _chosen(airline):
        df = df.filter(F.lower("airline") == airline.lower())
    return df.orderBy(*_newest_first(df)).limit(max(1, limit if most is None else min(limit, most)))


def recent_flights(df: DataFrame, limit: int = fixed.RECENT_ROWS) -> DataFrame:
    """The newest observations."""
    return df.orderBy(*_newest_first(df)).limit(limit)


def filter_values(df: DataFrame, origin: str | None = None) -> DataFrame:
    """Choices for each filter as (dimension, value); destinations are those reachable from `origin` if given.

    The four dimensions come from one pass that first reduces the rows to distinct combinations.
    """
    combos = df.select("route", "airline", C.day("outbound_date").cast("string").alias("d")).distinct()
    start, end = C.route_part("route", 1), C.route_part("route", 2)
    reachable = end if not _chosen(origin) else F.when(start == origin, end)
    pairs = {"route": F.col("route"), "airline": F.col("airline"), "travel_date": F.col("d"),
             "origin": C.blank_to_null(start), "destination": C.blank_to_null(reachable)}
    entries = F.array(*[F.struct(F.lit(k).alias("dimension"), v.alias("value")) for k, v in pairs.items()])
    return combos.select(F.inline(entries)).dropna().distinct().orderBy("dimension", "value")


def filter_observations(df: DataFrame, origin: str | None = None, destination: str | None = None,
                        travel_date: str | None = None, window: str | None = None,
                        airline: str | None = None) -> DataFrame:
    """Rows that meet every given condition; None or ALL leaves a condition out.

    Endpoints are compared on their own columns where the table has them, and a booking lead without a label of its own as
    a range of days, so that the scan can skip by them. Of a table laid out by month of travel only one folder is read.
    """
    if _chosen(origin):
        df = df.filter((F.col("origin") if "origin" in df.columns else C.route_part("route", 1)) == origin)
    if _chosen(destination):
        end = F.col("destination") if "destination" in df.columns else C.route_part("route", 2)
        df = df.filter(end == destination)
    if _chosen(travel_date):
        df = _travel_months(df, travel_date, travel_date).filter(F.col("outbound_date") == F.lit(travel_date).cast("date"))
    if _chosen(window):
        df = df.filter(lenient_window(df) == window if "booking_window" in df.columns else lead_range(window))
    if _chosen(airline):
        df = df.filter(F.lower("airline") == airline.lower())
    return df


def text_search(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows whose columns, joined by blanks, contain the query, compared without regard to case."""
    words = F.lower(F.concat_ws(" ", *columns))
    return df.filter(F.contains(words, F.lit(query.strip().lower())))


def paginate(df: DataFrame, page: int, size: int = fixed.OBSERVATION_PAGE,
             time_column: str = "collection_timestamp") -> DataFrame:
    """Rows of one page of the newest-first order, with their `position`; a page past the end means the last one.

    Row counts per minute locate the page, so only the minutes it touches are read again, however deep it lies; their
    rows are numbered over ranges of the full order, so a minute that holds very many rows is spread over tasks.
    """
    minute = F.date_trunc("minute", time_column)
    counts = materialise(df.groupBy(minute.alias("_m")).agg(F.count("*").alias("_n")), "minutes")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    last = max(1, -(-total // size))
    start = (min(max(page, 1), last) - 1) * size
    ordered = numbered_sums(counts, [F.col("_m").desc_nulls_last()], "_n", "_before")
    touched = ordered.filter((F.col("_before") + F.col("_n") > start) & (F.col("_before") < start + size))
    moment = F.unix_micros(F.col("_m").cast("timestamp"))
    low, high, before, undated = touched.agg(
        F.min(moment), F.max(moment), F.min("_before"), F.count_if(F.col("_m").isNull())).first()
    when, within = F.col(time_column), F.lit(False)
    if low is not None:
        within = (when >= F.timestamp_micros(F.lit(low))) & (when < F.timestamp_micros(F.lit(high + 60_000_000)))
    if undated:
        within = within | when.isNull()
    rows = numbered(df.filter(within), _newest_first(df), "position")
    rows = rows.withColumn("position", F.col("position") + F.lit((before or 0) + 1))
    return rows.filter((F.col("position") > start) & (F.col("position") <= start + size)).orderBy("position")


def top_routes(routes: DataFrame, k: int = fixed.TOP_ROUTES) -> DataFrame:
    """The k dearest routes of a route summary with their share of the highest average fare."""
    fare = F.coalesce("average_fare", F.lit(0.0))
    peak = routes.select(F.max(fare)).scalar()
    return routes.withColumn("share_of_max_pct", C.share(fare, peak)).orderBy(fare.desc(), "route").limit(k)


def route_extremes(routes: DataFrame) -> DataFrame:
    """One row: dearest and cheapest route; a dash when there are none."""
    fare = F.coalesce("average_fare", F.lit(0.0))
    return routes.agg(
        F.coalesce(F.min_by("route", F.struct(-fare, "route")), F.lit("—")).alias("highest_route"),
        F.coalesce(F.min_by("route", F.struct(fare, "route")), F.lit("—")).alias("lowest_route"),
    )


def top_airlines(airlines: DataFrame, k: int = fixed.TOP_AIRLINES) -> DataFrame:
    """The k carriers with most observations and their share of the largest count."""
    peak = airlines.select(F.max("observations")).scalar()
    out = airlines.withColumn("share_of_max_pct", C.share("observations", peak))
    return out.orderBy(F.col("observations").desc(), "airline").limit(k)
