"""Positions, ranks and predecessors in a full order, without a task that sees all rows."""
from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fareloom.session import materialise

# `monotonically_increasing_id` holds the number of the partition above these bits, and the row's place below.
_PLACE_BITS = 33


def numbered(df: DataFrame, order: list[Column | str], name: str = "position") -> DataFrame:
    """`df` with the place of each row in the order, counted from 0; rows that tie in it are numbered in any order.

    Rows are dealt to ranges of the order, sorted within them, and stored. The driver gets one count per range, whose
    running sums are where the ranges begin. Rows that tie in the whole order share a range, so the order should tell
    rows apart.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    stored = materialise(dealt, "ordered")
    place = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return stored.withColumn(name, _begins(stored, F.count("*")) + place).drop("_at")


def _begins(stored: DataFrame, total: Column) -> Column:
    """Sum of `total` over all ranges before the row's."""
    part = F.shiftright("_at", _PLACE_BITS).cast("int")
    sums = {r["p"]: r["n"] for r in stored.groupBy(part.alias("p")).agg(total.alias("n")).collect()}
    sizes = [sums.get(k, 0) for k in range(max(sums, default=0) + 1)]
    return F.get(F.lit([0, *accumulate(sizes)]).cast("array<bigint>"), part)


def numbered_sums(df: DataFrame, order: list[Column | str], value: str, name: str) -> DataFrame:
    """`df` with the sum of `value` over all rows before it in the order, which must tell rows apart.

    As in `numbered`, with running sums in each range of the order instead of places.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    stored = materialise(dealt, "ordered")
    within = W.partitionBy(F.shiftright("_at", _PLACE_BITS)).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    inner = F.coalesce(F.sum(value).over(within), F.lit(0))
    return stored.withColumn(name, _begins(stored, F.sum(value)) + inner).drop("_at")


def with_previous(df: DataFrame, order: list[Column | str], values: dict[str, str]) -> DataFrame:
    """`df` with values of the row before in the order: `values` maps the new column to the one it is taken from."""
    rows = numbered(df, order, "_n")
    before = rows.select((F.col("_n") + 1).alias("_b"), *[F.col(c).alias(n) for n, c in values.items()])
    return rows.join(before, F.col("_n") == F.col("_b"), "left").drop("_n", "_b")


def dense_ranks(df: DataFrame, by: Column, name: str) -> DataFrame:
    """`df` with the dense rank, from 1, of a sort expression: equal values share a rank, and a range of the order."""
    dealt = df.withColumn("_v", by).repartitionByRange("_v").withColumn("_at", F.monotonically_increasing_id())
    stored = materialise(dealt, "ordered")  # also fixes the last bits of computed values, which decide ties
    within = W.partitionBy(F.shiftright("_at", _PLACE_BITS)).orderBy("_v")
    distinct = F.count_distinct(F.struct("_v"))
    rank = _begins(stored, distinct) + F.dense_rank().over(within)
    return stored.withColumn(name, rank.cast("int")).drop("_v", "_at")
