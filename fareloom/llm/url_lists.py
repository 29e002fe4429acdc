"""URL filters by a temporal join: dated list entries become validity intervals, and every capture is evaluated against
the entries that were active when it was fetched.

An entry adds or removes a pattern of a list at an instant. A pattern is a domain (with its sub-domains), a host, or an
address. An addition holds from its instant until the next entry for the same pattern of the same list.

Captures and intervals meet by (pattern, calendar month): a capture looks up its address, its host, and every suffix of
its host, in its own month; an interval stands in every month in which it is active and captures exist. So a host with
very many captures is split by months, adaptive execution splits what is still large, and a pattern with a long history
is only met by the part of it that can matter. Only ids, addresses and times are joined, never contents.

Defined results: an address without a host, and an unknown fetch time, match nothing; entries without list, pattern or
time are ignored; of entries for one pattern at one instant a removal wins; an entry counts at its very instant; repeated
captures are evaluated each for itself; an empty list leaves all captures unlisted.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fareloom.session import materialise

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty if there is none."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), _AUTHORITY, 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r":[0-9]*$", ""), r"\.$", ""))


def address_of(url: Column) -> Column:
    """Host, path and query: the address without scheme, user, port, fragment and final slash."""
    rest = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", "")
    return F.concat(host_of(url), F.regexp_replace(rest, r"/$", ""))


def lookup_keys(url: Column) -> Column:
    """What a capture may be listed under: u:address, h:host, and d: with every suffix of the host."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    own = F.array(F.concat(F.lit("u:"), address_of(url)), F.concat(F.lit("h:"), host))
    return F.when(host != "", F.concat(own, suffixes)).otherwise(F.array().cast("array<string>"))


def pattern_key(kind: Column, pattern: Column) -> Column:
    lowered = F.lower(F.regexp_replace(pattern, r"\.$", ""))
    return (F.when(kind == "domain", F.concat(F.lit("d:"), lowered)).when(kind == "host", F.concat(F.lit("h:"), lowered))
            .when(kind == "url", F.concat(F.lit("u:"), address_of(pattern))))


def intervals(entries: DataFrame) -> DataFrame:
    """`list`, `key`, `since`, `until` (null: still active) from entries (list, kind, pattern, action, at)."""
    dated = entries.select("list", pattern_key(F.col("kind"), F.col("pattern")).alias("key"), "action", "at").dropna()
    # One row per instant before the window, however often an entry is repeated.
    dated = dated.groupBy("list", "key", "at").agg(F.max(F.col("action") == "remove").alias("removed"))
    until = F.lead("at").over(W.partitionBy("list", "key").orderBy("at"))
    return dated.withColumn("until", until).filter(~F.col("removed")).select("list", "key", F.col("at").alias("since"), "until")


def _month(at: Column) -> Column:
    return F.year(at) * 12 + F.month(at)


def evaluate(captures: DataFrame, entries: DataFrame, *, page_id: str = "page_id", url: str = "url",
             fetched: str = "fetched") -> DataFrame:
    """Per capture: its id, `n_entries` active for it, their `lists` (sorted, distinct) and whether it is `listed`."""
    own = materialise(captures.select(
        F.col(f"`{page_id}`").alias("id"), F.col(f"`{url}`").alias("url"), F.col(f"`{fetched}`").cast("timestamp").alias("t"),
        F.monotonically_increasing_id().alias("n")), "captures")
    reach = own.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
    held = intervals(entries).filter((F.col("since") <= F.lit(reach.hi)) & (
        F.col("until").isNull() | (F.col("until") > F.lit(reach.lo))))
    first, last = F.greatest("since", F.lit(reach.lo)), F.least(F.coalesce("until", F.lit(reach.hi)), F.lit(reach.hi))
    held = held.withColumn("month", F.explode(F.sequence(_month(first), _month(last))))
    asked = own.filter(F.col("t").isNotNull()).select("n", "t", _month(F.col("t")).alias("month"), F.explode(lookup_keys(F.col("url"))).alias("key"))
    active = asked.join(held, ["key", "month"]).filter(
        (F.col("since") <= F.col("t")) & (F.col("until").isNull() | (F.col("t") < F.col("until"))))
    marks = active.groupBy("n").agg(F.count("*").alias("n_entries"), F.array_sort(F.collect_set("list")).alias("lists"))
    return own.join(marks, "n", "left").select(
        F.col("id").alias(page_id), F.coalesce("n_entries", F.lit(0).cast("long")).alias("n_entries"),
        F.coalesce("lists", F.array().cast("array<string>")).alias("lists"), F.col("n_entries").isNotNull().alias("listed"))
