"""Connected components of links between long ids, by alternating large and small stars.

Every round replaces links by links to smaller ids without changing what is connected, until each component is a star
around its smallest id. Minima are aggregated before they are joined back, so an id with very many links is neither
collected in one task nor multiplied; adaptive execution splits its join.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fareloom.session import materialise


def _star(edges: DataFrame, upward: bool) -> DataFrame:
    """One star step over edges (u, v). Upward: larger neighbours of u move to the least neighbour of u; downward:
    u and its smaller neighbours do."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not upward:
        both = both.filter(F.col("v") < F.col("u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if upward:
        moved = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v")))
    return moved.filter(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """`id` and `root` (the smallest id reachable) of every id in `links` (columns u and v, both long)."""
    edges = materialise(links.select("u", "v").filter(F.col("u") != F.col("v")).distinct(), "links")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.col("v") % 1_000_003)).first()
        if now == before or not now[0]:
            break
        before = now
        edges = materialise(_star(_star(edges, True), False), "stars")
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
