"""One pass of observations for many tables: mergeable partial statistics, rolled up to every grain.

`partials` reads the observations once and keeps, per combination of all dimensions and magnitude bucket of the fare, what
can be added up: counts, sums, squared deviations, extremes. Tables of partials of different inputs are united by `union`.
A `RollUp` adds them up to all its grains in one aggregation, finds the buckets that hold the median of every key of every
grain, and reads the observations a second time, once for all grains, to rank the values of the buckets left open. What
tables ask for afterwards comes from these stored results; observations are not read again.

Distinct counts are bitmaps: values are coded by one dictionary, a combination's codes are bits of 64-bit words, and words
are united by `bit_or` on the way up.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fareloom.functions import columns as C
from fareloom.operators.ordering import numbered
from fareloom.operators.stats import bucket, ranked
from fareloom.session import materialise


def _value(df: DataFrame, name: str) -> Column:
    """A column as a double, NaN and infinity as null."""
    return C.finite(F.col(name).cast("double"))


def partials(df: DataFrame, dims: list[str], value: str = "total_fare", means: list[str] = (),
             latest: str | None = None) -> DataFrame:
    """Per combination of `dims` and magnitude bucket `_b` of the value: rows, and of the value count, sum, squared
    deviations from the mean, least and largest; sums and counts of the columns `means`; the largest `latest`."""
    x = F.col("_x")
    rows = df.select(*dims, _value(df, value).alias("_x"), *[_value(df, c).alias(f"_v_{c}") for c in means],
                     *([F.col(latest).alias("_latest")] if latest else []))
    aggs = [F.count("*").alias("_rows"), F.count(x).alias("_n"), F.sum(x).alias("_sum"),
            (F.var_pop(x) * F.count(x)).alias("_dev"), F.min(x).alias("_low"), F.max(x).alias("_high")]
    for c in means:
        aggs += [F.sum(f"_v_{c}").alias(f"_s_{c}"), F.count(f"_v_{c}").alias(f"_c_{c}")]
    if latest:
        aggs.append(F.max("_latest").alias("_latest"))
    return rows.groupBy(*dims, F.when(x.isNotNull(), bucket(x)).alias("_b")).agg(*aggs)


class RollUp:
    """Statistics of one table of observations at several grains.

    `grains` are lists of columns, each a dimension or one `derived` from dimensions by an expression over them; rows with
    a null key are left out of a grain. `dims` are the dimensions, `distinct` those whose values are counted per key,
    `means` the columns averaged. The jobs run when it is made; stored results are in the shared folder.
    """

    def __init__(self, df: DataFrame, dims: list[str], grains: list[list[str]], *, derived: dict[str, Column] | None = None,
                 value: str = "total_fare", means: list[str] = (), distinct: list[str] = (), latest: str | None = None,
                 parts: DataFrame | None = None):
        derived = derived or {}
        self.grains = list(dict.fromkeys(tuple(g) for g in grains))
        self.columns = list(dict.fromkeys(c for g in self.grains for c in g))
        self.means, self.distinct = list(means), [c for c in distinct if c in dims]
        self.latest = latest
        self.parts = materialise(partials(df, dims, value, means, latest), "partials") if parts is None else parts
        cells = self.parts.withColumns(derived)
        self.kinds = {c: cells.schema[c].dataType for c in self.columns}
        self._totals = materialise(self._added_up(cells), "totals")
        rows = df.withColumns(derived).select(*self.columns, _value(df, value).alias("_x")).filter(F.col("_x").isNotNull())
        rows = self._keyed(rows).select("_key", "_x", bucket(F.col("_x")).alias("_b"))
        self._medians = materialise(ranked(rows, self._totals.filter("_b IS NOT NULL"), {"median_fare": 0.5}), "medians")
        self._counts = materialise(self._distinct_counts(cells), "distinct") if self.distinct else None

    def _keyed(self, rows: DataFrame) -> DataFrame:
        """Each row once per grain, with `_key`: the grain and its columns, the other columns null."""
        keys = []
        for k, grain in enumerate(self.grains):
            key = F.struct(F.lit(k).alias("grain"), *[
                (F.col(c) if c in grain else F.lit(None)).cast(self.kinds[c]).alias(c) for c in self.columns])
            keys.append(F.when(C.present(list(grain)), key))
        return rows.withColumn("_key", F.explode(F.array(*keys))).filter(F.col("_key").isNotNull())

    def _added_up(self, cells: DataFrame) -> DataFrame:
        """Per key and bucket the sums of all cells. Deviations are taken from one pivot, the overall mean."""
        pivot = cells.select(F.coalesce(F.try_divide(F.sum("_sum"), F.sum("_n")), F.lit(0.0))).scalar()
        gap = F.try_divide(F.col("_sum"), F.col("_n")) - pivot
        cells = cells.withColumn("_off", F.col("_dev") + F.col("_n") * gap * gap)
        cells = cells.withColumn("_pivot", pivot)
        sums = ["_rows", "_n", "_sum", "_off", *[f"_{k}_{c}" for c in self.means for k in "sc"]]
        aggs = [F.sum(c).alias(c) for c in sums] + [F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.max("_pivot").alias("_pivot")]
        return self._keyed(cells).groupBy("_key", "_b").agg(*aggs)

    def _distinct_counts(self, cells: DataFrame) -> DataFrame:
        """Per key the number of distinct values of each column of `distinct`, nulls apart."""
        combos = cells.select(*dict.fromkeys([*self.columns, *self.distinct])).distinct()
        pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in self.distinct])
        coded = numbered(combos.select(F.inline(pairs)).filter("v IS NOT NULL").distinct(), ["c", "v"], "code")
        bits = self._keyed(combos.withColumn("_p", F.explode(pairs))).select("_key", "_p.c", "_p.v").join(coded, ["c", "v"])
        words = bits.groupBy("_key", "c", F.shiftright("code", 6).alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(code % 64 as int))")).alias("bits"))
        return words.groupBy("_key", "c").agg(F.sum(F.bit_count("bits")).cast("long").alias("n"))

    def fare_stats(self, keys: list[str], *, std: bool = False, distinct: dict[str, str] | None = None,
                   means: dict[str, str] | None = None, names: dict[str, str] | None = None,
                   extremes: bool = True) -> DataFrame:
        """The same table as `stats.fare_stats` of the observations, from the stored results."""
        grain = self.grains.index(tuple(keys))
        average = lambda total, n: F.try_divide(F.sum(total), F.sum(n))
        rows = self._totals.filter(F.col("_key.grain") == grain)
        aggs = [average("_sum", "_n").alias("average_fare")]
        if extremes:
            aggs += [F.min("_low").alias("minimum_fare"), F.max("_high").alias("maximum_fare")]
        if std:
            n, mean = F.sum("_n"), average("_sum", "_n") - F.max("_pivot")
            var = F.greatest(F.try_divide(F.sum("_off") - n * mean * mean, n - 1), F.lit(0.0))
            aggs.append(F.when((n > 1) & (F.min("_low") < F.max("_high")), F.sqrt(var)).otherwise(F.lit(0.0)).alias("fare_std"))
        aggs.append(F.sum("_n").alias("observations"))
        counted = {name: c for name, c in (distinct or {}).items() if c in self.distinct}
        for name in (distinct or {}).keys() - counted.keys():
            aggs.append(F.sum("_n").alias(name))
        for name, c in (means or {}).items():
            aggs.append((average(f"_s_{c}", f"_c_{c}") if c in self.means else average("_sum", "_n")).alias(name))
        out = rows.groupBy("_key").agg(*aggs).join(self._medians, "_key", "left")
        for name, c in counted.items():
            own = self._counts.filter(F.col("c") == c).select(F.col("_key").alias("_k"), F.col("n").alias("_own"))
            out = out.join(own, F.col("_key") == F.col("_k"), "left").withColumn(name, F.coalesce("_own", F.lit(0))).drop("_k", "_own")
        order = ["average_fare", "median_fare"]
        if extremes:
            order += ["minimum_fare", "maximum_fare"]
        order += [*(["fare_std"] if std else []), "observations", *(distinct or {}), *(means or {})]
        picked = [F.col(f"_key.`{c}`").alias(c) for c in keys]
        return out.select(*picked, *order).withColumnsRenamed(names or {})

    def combinations(self, keys: list[str]) -> DataFrame:
        """Rows, fares, their sum and extremes, and the latest time per combination of dimensions, null ones among them."""
        latest = F.max("_latest") if self.latest else F.lit(None).cast("timestamp")
        return self.parts.groupBy(*keys).agg(
            F.sum("_rows").alias("n"), F.sum("_n").alias("fares"), F.sum("_sum").alias("total"), F.min("_low").alias("low"),
            F.max("_high").alias("high"), latest.alias("latest"))
