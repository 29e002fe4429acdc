"""Grouped statistics that stay exact without ever holding a whole group in one task."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fareloom.functions import columns as C
from fareloom.session import BROADCAST_ROWS, materialise

# Buckets per e-fold of magnitude: neighbouring bucket edges differ by about 13 %. Fewer buckets make the histogram
# smaller, more buckets leave fewer values to rank in each.
_DENSITY = 8
# Puts the bucket of the smallest positive double above zero, so that sign and size order the buckets.
_SHIFT = 746 * _DENSITY
# A bucket with more rows than this is cut into so many parts before its values are ranked in one task.
RANKED_ROWS, PARTS = 1_000_000, 4096


def bucket(x: Column) -> Column:
    """Whole number that never decreases as `x` grows."""
    return (
        F.when(x > 0, F.floor(F.log(x) * _DENSITY) + _SHIFT)
        .when(x < 0, -(F.floor(F.log(-x) * _DENSITY) + _SHIFT))
        .otherwise(F.lit(0))
    )


def _covers(rank: Column, upto: Column, count: Column) -> Column:
    return (upto > rank) & (upto - count <= rank)


def _positions(probs: dict[str, float]) -> dict[str, Column]:
    return {name: (F.col("_size") - 1) * F.lit(p) for name, p in probs.items()}


def _touched(probs: dict[str, float]) -> Column:
    """The bucket holds a wanted rank."""
    hit = F.lit(False)
    for position in _positions(probs).values():
        for edge in (F.floor, F.ceil):
            hit = hit | _covers(edge(position), F.col("_upto"), F.col("_n"))
    return hit


# Columns of a touched bucket: what it covers, its rows, the rows below it and those of its key.
_TARGET = ["_key", "_b", "_low", "_high", "_n", "_below", "_size"]


def _meet(rows: DataFrame, targets: DataFrame, n_targets: int) -> DataFrame:
    """The rows within the touched buckets, with the buckets' columns."""
    t = targets.select(*[F.col(c).alias(f"_t{c}") for c in _TARGET])
    if n_targets <= BROADCAST_ROWS:
        t = F.broadcast(t)
    within = F.col("_x").between(F.col("_t_low"), F.col("_t_high"))
    return rows.join(t, (F.col("_b") == F.col("_t_b")) & (F.col("_key") == F.col("_t_key")) & within)


def ranked(rows: DataFrame, counted: DataFrame, probs: dict[str, float], limit: int = RANKED_ROWS) -> DataFrame:
    """`_key` and the linearly interpolated quantiles of `_x` per key.

    `rows` has `_key` (a struct), `_x` and its `_b` (see `bucket`); `counted` has one row per key and bucket: `_n`, and the
    least and largest value `_low` and `_high`. It may hold the sums of many tables or of a finer grain.

    1. Running counts over a key's buckets, of which there are at most some thousands, show which hold a wanted rank.
    2. A bucket with one or two rows, or of one value, is settled by its least and largest value.
    3. A bucket of more than `limit` rows is cut into equal parts between its least and largest value, which are counted in
       one scan, and of which only those with a wanted rank go on. Every pass narrows a bucket at least 4,000-fold, so
       doubles of one magnitude need five passes at most, however many there are.
    4. Only rows in what is left are counted by value and ranked; no task ranks more than `limit` of them.

    Touched buckets are written to the shared folder and counted. They are broadcast when few, so the rows themselves are
    not shuffled; otherwise the join on key and bucket spreads a hot key over its buckets.
    """
    over = W.partitionBy("_key")
    targets = (
        counted.filter("_n > 0")
        .withColumn("_upto", F.sum("_n").over(over.orderBy("_b")))
        .withColumn("_size", F.sum("_n").over(over))
        .filter(_touched(probs))
        .withColumn("_below", F.col("_upto") - F.col("_n"))
    )
    targets = materialise(targets.select(*_TARGET), "ranks")
    settled = (F.col("_n") <= 2) | (F.col("_low") == F.col("_high"))
    large = ~settled & (F.col("_n") > limit)
    while True:
        n_open, n_large = targets.agg(F.count_if(~settled), F.count_if(large)).first()
        if not n_large:
            break
        cut = _meet(rows, targets.filter(large), n_large)
        share = (F.col("_x") - F.col("_t_low")) / (F.col("_t_high") - F.col("_t_low"))
        own = ["_key", "_b", "_t_low", "_t_below", "_t_size"]
        parts = cut.groupBy(*own, F.floor(share * (PARTS - 1)).alias("_part")).agg(
            F.count("*").alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
        within = W.partitionBy("_key", "_b", "_t_low").orderBy("_part")
        parts = parts.withColumns({"_upto": F.col("_t_below") + F.sum("_n").over(within), "_size": F.col("_t_size")})
        parts = parts.filter(_touched(probs)).withColumn("_below", F.col("_upto") - F.col("_n"))
        targets = materialise(targets.filter(~large).unionByName(parts.select(*_TARGET)), "ranks")
    # A settled bucket is its least value and, above it, its largest.
    ends = F.array(F.struct(F.col("_low").alias("_x"), F.lit(1).cast("long").alias("_n")),
                   F.struct(F.col("_high").alias("_x"), (F.col("_n") - 1).alias("_n")))
    known = targets.filter(settled).select("_key", "_b", "_low", "_below", "_size", F.inline(ends)).filter("_n > 0")
    if n_open:
        met = _meet(rows, targets.filter(~settled), n_open)
        known = known.unionByName(met.groupBy(
            "_key", "_b", F.col("_t_low").alias("_low"), F.col("_t_below").alias("_below"), F.col("_t_size").alias("_size"),
            "_x").agg(F.count("*").alias("_n")).select(*known.columns))
    within = W.partitionBy("_key", "_b", "_low").orderBy("_x", "_n")
    values = known.withColumn("_upto", F.col("_below") + F.sum("_n").over(within.rowsBetween(W.unboundedPreceding, 0)))
    picks, columns = [F.max("_size").alias("_size")], []
    for i, (name, pos) in enumerate(_positions(probs).items()):
        for side, edge in (("lo", F.floor), ("hi", F.ceil)):
            picks.append(F.max(F.when(_covers(edge(pos), F.col("_upto"), F.col("_n")), F.col("_x"))).alias(f"_{side}{i}"))
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        columns.append((low + (pos - F.floor(pos)) * (high - low)).alias(name))
    return values.groupBy("_key").agg(*picks).select("_key", *columns)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                    limit: int = RANKED_ROWS) -> DataFrame:
    """Linearly interpolated quantiles per key: one row per key, one column per entry of `probs`.

    Rows are counted per (key, magnitude bucket), where the counts combine before the shuffle, so a hot key costs one row
    per bucket and task; `ranked` does the rest.
    """
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    rows = (
        df.select(key.alias("_key"), C.finite(F.col(value).cast("double")).alias("_x"))
        .filter(F.col("_x").isNotNull())
        .withColumn("_b", bucket(F.col("_x")))
    )
    counted = rows.groupBy("_key", "_b").agg(F.count("*").alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    return ranked(rows, counted, probs, limit).select(*[F.col(f"_key.`{k}`").alias(k) for k in keys], *probs)


def median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    return exact_quantiles(df, keys, value, {name: 0.5})


def fare_stats(
    df: DataFrame,
    keys: list[str],
    *,
    value: str = "total_fare",
    std: bool = False,
    distinct: dict[str, str] | None = None,
    means: dict[str, str] | None = None,
    names: dict[str, str] | None = None,
    extremes: bool = True,
) -> DataFrame:
    """Average, median, extremes and count of the fare per key; rows with a null key are left out.

    NaN and infinite values count as missing in every column of the result.

    `distinct` and `means` map an output name to the column counted or averaged. A column the input lacks falls back
    to the fare itself. `names` renames output columns.
    """
    data = df.filter(C.present(keys))
    kinds = dict(df.dtypes)
    data = data.withColumns({c: C.finite(c) for c in dict.fromkeys([value, *(means or {}).values()])
                             if kinds.get(c) in ("double", "float")})
    aggs = [F.avg(value).alias("average_fare")]
    if extremes:
        aggs += [F.min(value).alias("minimum_fare"), F.max(value).alias("maximum_fare")]
    if std:
        aggs.append(F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("fare_std"))
    aggs.append(F.count(value).alias("observations"))
    for name, source in (distinct or {}).items():
        aggs.append((F.count_distinct(source) if source in df.columns else F.count(value)).alias(name))
    for name, source in (means or {}).items():
        aggs.append(F.avg(source if source in df.columns else value).alias(name))
    base = data.groupBy(*keys).agg(*aggs)
    out = base.join(median(data, keys, value, "median_fare"), keys, "left")
    order = [*keys, "average_fare", "median_fare", *[c for c in base.columns if c not in (*keys, "average_fare")]]
    return out.select(*order).withColumnsRenamed(names or {})
