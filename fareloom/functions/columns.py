"""Column helpers that pin down missing-value, division and text rules."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from fareloom import fixed


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squash_text(c: Column | str) -> Column:
    """Collapse runs of white space, then trim; null stays null."""
    return F.trim(F.regexp_replace(col(c).cast("string"), r"\s+", " "))


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(squash_text(c), F.lit(""))


def code(c: Column | str) -> Column:
    """Upper-cased, trimmed code; null becomes empty."""
    return F.upper(F.trim(F.coalesce(col(c).cast("string"), F.lit(""))))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def number(c: Column | str) -> Column:
    """Double, with unreadable text, NaN and infinity all null."""
    return finite(col(c).try_cast("double"))


def finite(c: Column | str) -> Column:
    """A double as it is, or null if it is NaN or infinite."""
    return F.when(~F.isnan(col(c)) & (F.abs(col(c)) != float("inf")), col(c))


def day(c: Column | str) -> Column:
    return col(c).try_cast("date")


def instant(c: Column | str) -> Column:
    return col(c).try_cast("timestamp")


def present(names: list[str]) -> Column:
    """All named columns have a value. One test per column, which reaches the scan."""
    test = F.lit(True)
    for name in names:
        test = test & F.col(name).isNotNull()
    return test


def positive(c: Column | str) -> Column:
    return F.when(col(c) > 0, col(c))


def share(part: Column | str, whole: Column | str) -> Column:
    """`part` as a percentage of `whole`; null when `whole` is zero or missing."""
    return F.try_divide(col(part), col(whole)) * 100


def change_pct(now: Column | str, before: Column | str) -> Column:
    return (F.try_divide(col(now), col(before)) - 1) * 100


def half_even(c: Column | str, places: int) -> Column:
    """Round with ties to even. Nine decimals are taken first, so float noise does not decide ties."""
    return F.bround(col(c).cast("decimal(30,9)"), places).cast("double")


def volatility(std: Column | str, mean: Column | str) -> Column:
    return F.coalesce(share(std, mean), F.lit(0.0))


def route_of(origin: Column | str, destination: Column | str) -> Column:
    return F.concat_ws("-", code(origin), code(destination))


def route_part(route: Column | str, position: int) -> Column:
    """Origin (1) or destination (2) of a route text, empty when absent."""
    return F.coalesce(F.try_element_at(F.split(code(route), "-"), F.lit(position)), F.lit(""))


def lead_days(travel: Column | str, collected: Column | str) -> Column:
    """Days between collection and travel, floored at zero; null when either is missing."""
    days = F.date_diff(day(travel), day(collected))
    return F.when(days.isNotNull(), F.greatest(days, F.lit(0)))


def week_start(c: Column | str) -> Column:
    return F.date_trunc("week", col(c)).cast("date")


def month_key(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM")


def month_start(c: Column | str) -> Column:
    return F.trunc(col(c), "month")


def label_right_closed(c: Column | str, edges: list, labels: list[str], limit: float | None = None) -> Column:
    """Label of the interval (a, b] that holds the value; null outside all intervals."""
    value, chosen = col(c), None
    uppers = [*edges[1:], limit]
    for upper, label in zip(uppers, labels):
        hit = (value > edges[0]) if upper is None else (value > edges[0]) & (value <= upper)
        chosen = F.when(hit, label) if chosen is None else chosen.when(hit, label)
    return chosen


def label_left_closed(c: Column | str, edges: list, labels: list[str]) -> Column:
    """Label of the interval [a, b) that holds the value; null below the first edge."""
    value, chosen = col(c), None
    for upper, label in zip([*edges[1:], None], labels):
        hit = (value >= edges[0]) if upper is None else (value >= edges[0]) & (value < upper)
        chosen = F.when(hit, label) if chosen is None else chosen.when(hit, label)
    return chosen


def label_rank(c: Column | str, labels: list[str]) -> Column:
    """Position of a label in its list, for ordering."""
    return F.array_position(F.array(*[F.lit(x) for x in labels]), col(c)).cast("int")


def booking_window(c: Column | str, limit: float | None = None) -> Column:
    return label_right_closed(c, fixed.BOOKING_EDGES, fixed.BOOKING_LABELS, limit)


def far_first(c: Column | str) -> Column:
    """Sort key that puts the longest booking lead first."""
    return -label_rank(c, fixed.BOOKING_LABELS)


def sha256_joined(columns: list[Column]) -> Column:
    """SHA-256 of the texts joined by a bar, a missing value counting as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def sha256_json(names: list[str]) -> Column:
    """SHA-256 of a JSON object with sorted names that keeps its null fields."""
    return F.sha2(F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"}), 256)
