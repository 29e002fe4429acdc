"""SimHash for similarities at which fingerprints differ in many bits: tables of sampled bits, then differing bits.

Fingerprint: every shingle of a set, counted once, gives a random byte per bit; a bit is 1 if the bytes of all shingles
together exceed their mean. Bits of two sets differ with probability angle / pi, and the angle follows from the Jaccard
similarity, so the number of tables and the budget of differing bits follow from the wanted probability of a pair at the
least similarity. (The trie join of `simhash` finds at most two differing bits; here some twenty of 128 differ.)

Join: a table puts the fingerprints with equal sampled bits under one top node. Under a node all pairs are compared by the
differing bits of 128, whole arrays at a time; what is linked within a node leaves the task as a star around its least set,
not as pairs. A node with more than `leaves` fingerprints is compared as pairs of blocks, so no task ever holds a large
one, and no pair is left out. Sampled bits grow with half the logarithm of the number of sets: tables multiply slowly, and
what a set meets in a node stays cheap.

A large group of near copies falls apart into other nodes in every table, so stars of all tables would give each of its sets
a row per table. The first few tables connect nearly all of such a group; their components are classes, and of the other
tables only what links different classes leaves a task. The components over both are the groups, one row per set. Only a
component of more than `large` sets, whose sets need not resemble each other, is taken apart into the stars of all tables.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fareloom.llm.components import components
from fareloom.session import materialise

# Bits of a fingerprint, and how many of them are compared.
BITS, COMPARED = 512, 128
# How much likelier than in the limit a bit differs between small sets.
SMALL = 0.003
# Fingerprints of a node that a task compares with each other, or with as many of another block.
LEAVES = 1024
# Tables whose links make the classes for the others, and sets of a component that stays one group.
FIRST, LARGE = 8, 8192
# Rows that a task compares at a time.
ROWS = 65536


def _chances(n: int, p: float) -> np.ndarray:
    """Probability of 0 to n differing bits of n."""
    k = np.arange(n + 1)
    ways = [math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) for x in k.tolist()]
    return np.exp(np.array(ways) + k * math.log(p) + (n - k) * math.log(1 - p))


def differing(similarity: float) -> float:
    """Probability that a bit differs at that Jaccard similarity, at most: sets of one size have the widest angle."""
    return min(0.5, math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi + SMALL)


def plan(similarity: float, certain: float, sampled: int) -> tuple[int, int]:
    """Tables of `sampled` bits, and budget of differing bits, that together find a pair with probability `certain`."""
    p, miss = differing(similarity), (1 - certain) / 2
    chances, away = _chances(BITS, p), np.arange(BITS + 1)
    met = np.prod([np.maximum(BITS - away - j, 0) / (BITS - j) for j in range(sampled)], axis=0)
    tables = 1
    while (chances * (1 - met) ** tables).sum() > miss:
        tables += 1 + tables // 64
    over = 1 - np.cumsum(_chances(COMPARED, p))
    return tables, int(np.argmax(over <= miss))


def sampled_bits(sets: int) -> int:
    return min(24, max(6, round(math.log2(max(sets, 1)) / 2 + 3)))


def wide_fingerprint(hashes: np.ndarray) -> bytes | None:
    """The fingerprint of a set of shingle hashes; none of an empty set."""
    if not len(hashes):
        return None
    rng = np.random.default_rng(29)
    salt, odd, more = rng.integers(0, 2 ** 64, (3, BITS // 8), np.uint64) | np.uint64([[0], [1], [1]])
    every, half = np.uint64(0x00FF00FF00FF00FF), np.uint64(8)
    sums = np.zeros(BITS, np.int64)
    for low in range(0, len(hashes), 64):  # bytes are added up in lanes of 16 bits
        mixed = (hashes[low:low + 64, None] ^ salt) * odd
        mixed ^= mixed >> np.uint64(32)
        mixed *= more
        mixed ^= mixed >> np.uint64(29)
        sums += np.concatenate([(mixed & every).sum(0).view(np.uint16), ((mixed >> half) & every).sum(0).view(np.uint16)])
    return np.packbits(2 * sums > 255 * len(hashes)).tobytes()


def _rows(nodes: DataFrame, tables: range, sampled: int, only_nodes: bool = False) -> DataFrame:
    """A row per set (columns set, class, print) and table: the top node, the set, its class and the compared bits; or rows
    by node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(31)
        picks = [rng.permutation(BITS)[:sampled] for _ in range(tables.stop)]
        weights = 1 << np.arange(sampled, dtype=np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                raw = np.frombuffer(b"".join(part.column("print").to_pylist()), np.uint8).reshape(-1, BITS // 8)
                bits = np.unpackbits(raw, axis=1)
                tops = np.stack([(bits[:, picks[t]] @ weights) + (t << sampled) for t in tables], 1).ravel()
                if only_nodes:
                    node, count = np.unique(tops, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(count)], ["node", "n"])
                    continue
                compared = np.ascontiguousarray(raw[:, :COMPARED // 8]).view(np.int64)
                own = [part.column(c).to_numpy() for c in ("set", "class")]
                each = [np.repeat(x, len(tables)) for x in (*own, compared[:, 0], compared[:, 1])]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (tops, *each)], ["node", "set", "class", "a", "b"])

    kind = "node long, n long" if only_nodes else "node long, set long, class long, a long, b long"
    return nodes.select("set", "class", "print").mapInArrow(run, kind)


def _unite(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels (positions, each at most its own) after the positions u and v are linked."""
    while True:
        x, y = label[u], label[v]
        if (x == y).all():
            return label
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]


def linked(unit: np.ndarray, prints: np.ndarray, budget: int, label: np.ndarray | None = None) -> np.ndarray:
    """Per row the first row it is linked with, over pairs of rows of one unit (rows sorted by it) within the budget, and
    over the links that `label` (the same of them) gives."""
    place = np.arange(len(unit))
    label = place if label is None else label
    end = np.searchsorted(unit, unit, "right")
    at, step = place[place + 1 < end], 1
    while len(at):
        apart = at[label[at] != label[at + step]]
        near = np.bitwise_count(prints[apart] ^ prints[apart + step]).sum(1, dtype=np.int16) <= budget
        if near.any():
            label = _unite(label, apart[near], apart[near] + step)
        step += 1
        at = at[at + step < end[at]]
    return label


def _stars(own: DataFrame, tables: range, sampled: int, budget: int, leaves: int) -> DataFrame:
    """What nodes of these tables link of different classes (own: set, class, print): rows (u, v, n) for the least class u
    and every class v, itself included, of n linked ones."""
    large = _rows(own, tables, sampled, True).groupBy("node").agg(F.sum("n").alias("n")).filter(F.col("n") > leaves)
    large = materialise(large.select("node", F.ceil(F.col("n") / leaves).cast("int").alias("blocks")), "large")
    rows = _rows(own, tables, sampled).join(large, "node", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine, other = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select("node", "class", "a", "b", "blocks", mine.alias("mine"), other.alias("other"))
    pair = F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")
    rows = rows.select("node", pair.cast("long").alias("pair"), "class", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(part: np.ndarray) -> pa.RecordBatch:
            new = np.concatenate([[True], (part[1:, :2] != part[:-1, :2]).any(1)])
            first = new | np.concatenate([[True], part[1:, 2] != part[:-1, 2]])  # of its class in the node
            start = np.maximum.accumulate(np.where(first, np.arange(len(part)), 0))
            label = linked(np.cumsum(new), part[:, 3:].view(np.uint64), budget, start)
            several = np.bincount(label[first], minlength=len(part))[label]
            keep = first & (several > 1)
            return pa.RecordBatch.from_arrays(
                [pa.array(part[label[keep], 2]), pa.array(part[keep, 2]), pa.array(several[keep])], ["u", "v", "n"])

        rest, held = [], 0
        for batch in batches:
            rest.append(np.stack([batch.column(k).to_numpy() for k in range(5)], 1))
            held += batch.num_rows
            if held < ROWS:
                continue
            part = np.concatenate(rest)
            last = np.flatnonzero((part[1:, :2] != part[:-1, :2]).any(1))
            if len(last):
                yield found(part[:last[-1] + 1])
                part = part[last[-1] + 1:]
            rest, held = [part], len(part)
        if held:
            yield found(np.concatenate(rest))

    placed = rows.repartition("node", "pair").sortWithinPartitions("node", "pair", "class")
    return placed.mapInArrow(run, "u long, v long, n long")


def met_groups(
    nodes: DataFrame, *, similarity: float, certain: float, leaves: int = LEAVES, first: int = FIRST, large: int = LARGE,
) -> DataFrame:
    """Groups of sets (columns set, distinct, and print) as rows (band, set, met): a pair of sets of at least that similarity
    is in one group with probability `certain`. A group is named by its least set; `met` counts the sets met in the nodes
    of the first tables."""
    own = nodes.filter("print is not null").select("set", F.col("set").alias("class"), "print")
    sampled = sampled_bits(own.count())
    tables, budget = plan(similarity, certain, sampled)
    first = min(first, tables)
    stars = materialise(_stars(own, range(first), sampled, budget, leaves), "first")
    met = stars.groupBy(F.col("v").alias("set")).agg(F.sum("n").alias("met"))
    classes = components(stars).select(F.col("id").alias("set"), F.col("root").alias("class"))
    if first < tables:
        named = own.select("set", "print").join(classes, "set", "left").select("set", F.coalesce("class", "set").alias("class"), "print")
        more = _stars(named, range(first, tables), sampled, budget, leaves).select("u", "v")
        links = classes.select(F.col("set").alias("u"), F.col("class").alias("v")).union(more)
        classes = components(links).select(F.col("id").alias("set"), F.col("root").alias("class"))
    whole = materialise(classes.select(F.col("class").alias("band"), "set").join(met, "set", "left")
                        .select("band", "set", F.coalesce("met", F.lit(0)).alias("met")), "groups")
    wide = whole.groupBy("band").agg(F.count("*").alias("n")).filter(F.col("n") > large).select("band")
    if not wide.take(1):
        return whole
    wide = materialise(wide, "wide")
    apart = own.join(whole.join(wide, "band").select("set"), "set")
    stars = materialise(_stars(apart, range(tables), sampled, budget, leaves), "apart")
    met = stars.groupBy(F.col("v").alias("set")).agg(F.sum("n").alias("met"))
    fine = stars.select(F.col("u").alias("band"), F.col("v").alias("set")).distinct().join(met, "set")
    return whole.join(wide, "band", "left_anti").select("band", "set", "met").union(fine.select("band", "set", "met"))


def groups(nodes: DataFrame, **given) -> DataFrame:
    """The rows (band, set) of `met_groups`."""
    return met_groups(nodes, **given).select("band", "set")
