"""Mixing sources to target weights by subset sums over exact lengths.

1. Documents are counted by source and exact length in words; that table, not the documents, is what is fitted.
2. Sources get shares of the budget by weight. A share stops at `max_repeats` times its source; what is over goes to the
   others by weight. The level at which all this balances is found in one sorted pass over the sources.
3. Per source: whole copies first, then an even part of every length, then a bounded knapsack over the lengths left
   fits the remaining words, exactly wherever lengths allow it.
4. Of every length the wanted number of documents is taken in the order of a seeded hash. Only the hash bucket in which
   the number is reached is ranked, and buckets hold about a thousand documents however large a length's group is.

Defined results: a null text has size 0; a null source is a source of its own and the last; sources without words have
target 0; documents of size 0 are never taken; reruns take the same documents; rows repeated with one id lie in one
bucket; an empty table has an empty result. The sources' table (one row each) passes through one task, and a source's
table of lengths (one row per distinct length) through one group.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from fareloom.llm.common import opened, per_text
from fareloom.session import materialise

WEIGHTS = (5, 2, 1)
# Documents per hash bucket, on average.
_BUCKET = 1024


def sized(docs: DataFrame, *, text: str, keep: list[str]) -> DataFrame:
    """The kept columns and `size`, the number of words."""
    def make():
        return lambda texts: [{"size": len(raw.split()) if raw else 0} for raw in texts]

    return opened(per_text(docs, text, keep, "size long", make), keep, ["size"])


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, total: float | None = None, max_repeats: int = 3) -> DataFrame:
    """`source`, `source_size` and `target` of every source; `sources` has `source` and `source_size`.

    Weights repeat over the sources in order of code points, null last. `total` is the budget in words (default: all).
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    listed = sources.withColumn("w", F.element_at(
        F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * max_repeats
    listed = listed.withColumn("cap", cap.cast("double")).withColumn("full_at", F.col("cap") / F.col("w"))
    in_order = W.orderBy("full_at", "source").rowsBetween(W.unboundedPreceding, -1)
    from_here = W.orderBy("full_at", "source").rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(0))
    budget = F.lit(float(total)) if total is not None else F.sum("source_size").over(everything).cast("double")
    level = (budget - F.coalesce(F.sum("cap").over(in_order), F.lit(0.0))) / F.sum("w").over(from_here)
    return listed.withColumn("level", level).withColumn("level", F.max("level").over(everything)).select(
        "source", "source_size", F.least("cap", F.greatest(F.col("level"), F.lit(0.0)) * F.col("w")).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, max_repeats: int) -> tuple[int, np.ndarray]:
    """Whole copies of a source, and how many more documents of each length, for `budget` words in all.

    `lengths` is ascending and positive. The remaining budget is first spread evenly over the lengths, then fitted by a
    bounded knapsack: reachable sums are marked piece by piece, each with the piece that reached it first.
    """
    size = int((lengths * counts).sum())
    extra = np.zeros(len(lengths), np.int64)
    if not size or budget <= 0:
        return 0, extra
    whole = min(max_repeats, budget // size)
    rest = budget - whole * size
    if whole == max_repeats or not rest:
        return int(whole), extra
    even = max(0, rest - 2 * int(lengths[-1]))  # what is held back gives the knapsack room
    want, used = 0.0, 0
    for k, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist())):
        want += even / size * length * count
        extra[k] = min(count, max(0, int((want - used) // length)))
        used += int(extra[k]) * length
    return int(whole), extra + knapsack(lengths, counts - extra, rest - used)


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length come nearest to `budget` from below."""
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    via = np.full(budget + 1, -1, np.int32)
    pieces: list[tuple[int, int]] = []  # (index of the length, how many)
    for k in np.argsort(-lengths, kind="stable").tolist():
        left, many = min(int(counts[k]), budget // int(lengths[k])), 1
        while left > 0 and not reach[budget]:
            many = min(many, left)
            words = many * int(lengths[k])
            new = np.zeros(budget + 1, bool)
            new[words:] = reach[:-words]
            new &= ~reach
            via[new] = len(pieces)
            reach |= new
            pieces.append((k, many))
            left, many = left - many, many * 2
        if reach[budget]:
            break
    taken = np.zeros(len(lengths), np.int64)
    at = int(np.flatnonzero(reach)[-1])
    while at:
        k, many = pieces[via[at]]
        taken[k] += many
        at -= many * int(lengths[k])
    return taken


def mix(
    docs: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id",
    weights: Sequence[float] = WEIGHTS, total: float | None = None, max_repeats: int = 3, seed: int = 7,
) -> DataFrame:
    """Per document: its id, `source`, size, source_size, target (of its source), copies, and taken (words)."""
    own = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text"))
    narrow = sized(own, text="text", keep=["id", "source"])
    chance = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(2 ** 31)) / F.lit(float(2 ** 31))
    narrow = materialise(narrow.withColumn("chance", chance), "sized")
    lengths = materialise(narrow.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    goals = targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")),
                    weights, total, max_repeats)
    goals = materialise(goals, "targets")
    joined = lengths.withColumnRenamed("source", "s").join(goals, F.col("s").eqNullSafe(F.col("source"))).drop("s")

    def plan(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size", ignore_index=True)
        frame["whole"], frame["extra"] = 0, 0
        some = frame["size"] > 0
        whole, extra = fit(frame.loc[some, "size"].to_numpy(np.int64), frame.loc[some, "n"].to_numpy(np.int64),
                           int(round(frame["target"].iloc[0])), max_repeats)
        frame.loc[some, "whole"], frame.loc[some, "extra"] = whole, extra
        return frame

    schema = joined.withColumn("whole", F.lit(0).cast("long")).withColumn("extra", F.lit(0).cast("long")).schema
    quota = materialise(joined.groupBy("source").applyInPandas(plan, schema), "quota")
    quota = quota.withColumnRenamed("source", "q_source").withColumnRenamed("size", "q_size")
    on = F.col("source").eqNullSafe(F.col("q_source")) & (F.col("size") == F.col("q_size"))
    bucket = F.floor(F.col("chance") * F.ceil(F.col("n") / F.lit(float(_BUCKET))))
    placed = narrow.join(quota, on).withColumn("bucket", bucket)
    partial = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    group = ["source", "size"]
    upto = F.sum("m").over(W.partitionBy(*group).orderBy("bucket"))
    edges = (
        placed.filter(partial).groupBy(*group, "bucket", "extra").agg(F.count("*").alias("m")).withColumn("upto", upto)
        .filter((F.col("upto") >= F.col("extra")) & (F.col("upto") - F.col("m") < F.col("extra")))
        .select(F.col("source").alias("e_source"), F.col("size").alias("e_size"), F.col("bucket").alias("edge"),
                (F.col("extra") - F.col("upto") + F.col("m")).alias("need"))
    )
    edges = materialise(edges, "edges")
    rule = quota.join(edges, F.col("q_source").eqNullSafe(F.col("e_source")) & (F.col("q_size") == F.col("e_size")), "left")
    rule = materialise(rule.drop("e_source", "e_size"), "rules")
    placed = narrow.join(rule, on).withColumn("bucket", bucket)
    at_edge = F.col("edge").isNotNull() & (F.col("bucket") == F.col("edge"))
    sure = placed.filter(~at_edge).withColumn("more", F.when(
        F.col("edge").isNotNull(), F.col("bucket") < F.col("edge")).otherwise(F.col("extra") > 0))
    rank = F.row_number().over(W.partitionBy(*group, "bucket").orderBy("chance", F.col("id")))
    last = placed.filter(at_edge).withColumn("more", rank <= F.col("need"))
    copies = (F.col("whole") + F.col("more").cast("long")).alias("copies")
    out = sure.unionByName(last).select("id", "source", "size", "source_size", "target", copies)
    return out.withColumn("taken", F.col("copies") * F.col("size")).withColumnRenamed("id", doc_id)
