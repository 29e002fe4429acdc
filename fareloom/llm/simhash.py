"""SimHash fingerprints and their near-duplicate classes by a binary trie self-join.

Fingerprint: words are split at white space after A-Z are lower-cased; every run of three words, repeats included, is
hashed with XXH64 (seed 42); a bit is 1 if more than half of the hashes have it. A text of one or two words is one
shingle, a text without words has fingerprint zero and is linked like any other.

Join: distinct fingerprints that differ in at most two of 64 bits agree in at least two of four 16-bit blocks. For each
of the six pairs of blocks the fingerprints form a binary trie with those 32 bits on top. The self-join goes down from
pairs of equal top nodes: pairs of nodes split bit by bit, differing bits add up, and a pair is dropped as soon as they
exceed the budget. A top node with more than `leaves` fingerprints is first expanded as a table of node pairs, four bits
at a time, until both nodes of a pair are small enough, so no task ever holds a large group. The six tries multiply the
rows by a constant, whatever the size of the input.

Defined results: null and empty texts have fingerprint zero; repeated rows and ids each keep their row; a null id never
is a component's id unless all its ids are null; an empty table has an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from fareloom.llm.common import opened, per_text
from fareloom.llm.components import components
from fareloom.session import materialise

BLOCKS = list(combinations(range(4), 2))
# Fingerprints of one pair of trie nodes that a task may hold together.
LEAVES = 2048
_STEP = 4  # bits by which a large node is split at a time
_REST = 32  # bits below the shared blocks


def fingerprint(raw: bytes | None, shingle: int = 3) -> int:
    """The fingerprint of a UTF-8 text as a signed 64-bit integer."""
    words = raw.lower().split() if raw else []
    if not words:
        return 0
    total, ones = 0, np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    last = max(1, len(words) - shingle + 1)
    for low in range(0, last, 65536):  # very long texts go piece by piece
        own = words[low:min(last, low + 65536) + shingle - 1]
        count = max(1, len(own) - shingle + 1)
        columns = [own[k:k + count] for k in range(min(shingle, len(own)))]
        hashes = np.array([digest(b" ".join(s), 42) for s in zip(*columns)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += count
    bits = np.packbits(2 * ones > total, bitorder="little").view("<i8")
    return int(bits[0])


def fingerprints(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, shingle: int = 3) -> DataFrame:
    """The kept columns and `fp`, the fingerprint as a long."""
    keep = docs.columns if keep is None else keep

    def make():
        return lambda texts: [{"fp": fingerprint(raw, shingle)} for raw in texts]

    return opened(per_text(docs, text, keep, "fp long", make), keep, ["fp"])


def _tries(prints: DataFrame) -> DataFrame:
    """Every fingerprint once per trie: the trie's number, the 32 bits on top and the 32 bits below."""
    def block(i: int):
        return F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))

    def pair(i: int, j: int):
        return F.shiftleft(block(i), 16).bitwiseOR(block(j))

    own = [
        F.struct(F.lit(n).alias("trie"), pair(*top).alias("top"),
                 pair(*[i for i in range(4) if i not in top]).alias("rest"))
        for n, top in enumerate(BLOCKS)
    ]
    return prints.select("fp", F.explode(F.array(*own)).alias("t")).select("fp", "t.*")


def _node(depth: int):
    """Number of the node, `depth` bits below the top, in which a fingerprint lies."""
    return F.shiftrightunsigned("rest", _REST - depth) if depth else F.lit(0).cast("long")


def node_pairs(hot: DataFrame, budget: int, leaves: int) -> dict[int, DataFrame]:
    """Pairs (a, b) of nodes within large top nodes, by depth, each with at most `leaves` fingerprints together.

    `hot` holds the fingerprints of large top nodes. The pairs are a table too: each round joins it with the nodes'
    children, adds the bits in which these differ, and drops pairs beyond the budget.
    """
    key = ["trie", "top"]
    done: dict[int, DataFrame] = {}
    pairs = hot.select(*key).distinct().select(
        *key, F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("diff"))
    for depth in range(_STEP, _REST + 1, _STEP):
        children = hot.groupBy(*key, _node(depth).alias("c")).agg(F.count("*").alias("n"))
        left = children.select(*key, F.shiftrightunsigned("c", _STEP).alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"))
        right = children.select(*key, F.shiftrightunsigned("c", _STEP).alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"))
        grown = (
            pairs.join(left, [*key, "a"]).join(right, [*key, "b"])
            .filter((F.col("a") != F.col("b")) | (F.col("ca") <= F.col("cb")))
            .withColumn("diff", F.col("diff") + F.bit_count(
                F.col("ca").bitwiseXOR(F.col("cb")).bitwiseAND(F.lit(2 ** _STEP - 1))))
            .filter(F.col("diff") <= budget)
            .select(*key, F.col("ca").alias("a"), F.col("cb").alias("b"), "diff",
                    F.when(F.col("ca") == F.col("cb"), F.col("na")).otherwise(F.col("na") + F.col("nb")).alias("n"))
        )
        grown = materialise(grown, "nodes")
        done[depth] = grown.filter((F.col("n") <= leaves) & ((F.col("n") > 1))).select(*key, "a", "b")
        pairs = grown.filter(F.col("n") > leaves).select(*key, "a", "b", "diff")
        if not pairs.take(1):
            break
    return done


def trie_links(rest: np.ndarray, roots: list[tuple[int, int, int, int]], budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs within the budget, by going down pairs of trie nodes together.

    A node is a range of the sorted array `rest` whose values share their upper bits. Each root gives two ranges, equal
    ones for a node paired with itself.
    """
    at = np.array(roots, np.int64).reshape(-1, 4)
    alo, ahi, blo, bhi = at.T
    same, diff = (alo == blo) & (ahi == bhi), np.zeros(len(at), np.int64)
    for bit in range(_REST - 1, -1, -1):
        ones = np.concatenate([[0], np.cumsum((rest >> bit) & 1)])
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        grown = []
        for x, y in ((0, 0), (1, 1), (0, 1), (1, 0)):
            a0, a1 = (alo, amid) if x == 0 else (amid, ahi)
            b0, b1 = (blo, bmid) if y == 0 else (bmid, bhi)
            d, equal = diff + (x != y), same & (x == y)
            keep = (a1 > a0) & (b1 > b0) & (d <= budget) & ~(equal & (a1 - a0 < 2))
            if (x, y) == (1, 0):
                keep &= ~same
            grown.append((a0[keep], a1[keep], b0[keep], b1[keep], d[keep], equal[keep]))
        alo, ahi, blo, bhi, diff, same = (np.concatenate(part) for part in zip(*grown))
        if not len(alo):
            break
    return alo[~same], blo[~same]


def forest(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Links that connect the same fingerprints as (u, v): one from each to the least of its group, as rows of two."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for x, y in zip(u.tolist(), v.tolist()):
        a, b = find(x), find(y)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return np.array([(x, find(x)) for x in list(parent) if find(x) != x], np.int64).reshape(-1, 2)


_UNIT = ["trie", "top", "a", "b"]


def _joiner(budget: int, spanning: bool, leaves: int):
    """Reads rows sorted by unit, side and rest; hands on whole units, several at a time."""
    def links(part: pd.DataFrame) -> pd.DataFrame:
        unit = part[_UNIT].to_numpy(np.int64)
        side, rest, fp = part["side"].to_numpy(), part["rest"].to_numpy(np.int64), part["fp"].to_numpy(np.int64)
        new_unit = np.concatenate([[True], (unit[1:] != unit[:-1]).any(1)])
        new_node = new_unit | np.concatenate([[True], side[1:] != side[:-1]])
        starts = np.flatnonzero(new_node)
        ends = np.append(starts[1:], len(part))
        roots = []
        for k, (lo, hi) in enumerate(zip(starts.tolist(), ends.tolist())):
            if unit[lo, 2] == unit[lo, 3]:
                if hi - lo > 1:
                    roots.append((lo, hi, lo, hi))
            elif side[lo] == 0 and k + 1 < len(starts) and not new_unit[starts[k + 1]]:
                roots.append((lo, hi, int(starts[k + 1]), int(ends[k + 1])))
        if not roots:
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        u, v = trie_links(rest, roots, budget)
        pairs = forest(fp[u], fp[v]) if spanning else np.stack([fp[u], fp[v]], 1)
        return pd.DataFrame(pairs, columns=["u", "v"], dtype="int64")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            if len(rest) < 4 * leaves:
                continue
            unit = rest[_UNIT].to_numpy(np.int64)
            last = np.flatnonzero((unit[1:] != unit[:-1]).any(1))
            if len(last):
                yield links(rest.iloc[:last[-1] + 1])
                rest = rest.iloc[last[-1] + 1:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield links(rest)

    return run


def near_links(prints: DataFrame, *, budget: int = 2, leaves: int = LEAVES, forest: bool = True) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp, no repeats) that differ in at most `budget` (0 to 2) bits.

    With `forest`, links within a task that connect what others connect already are left out: classes stay whole.
    Without it every pair comes at least once.
    """
    if not 0 <= budget <= 2:
        raise ValueError("The four blocks are sure to find links of at most two differing bits.")
    leaves = max(leaves, 2)  # two nodes of one fingerprint each must fit
    rows = _tries(prints)
    tops = rows.groupBy("trie", "top").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    tops = materialise(tops, "tops")
    zero = F.lit(0).cast("long")
    small = rows.join(tops.filter(F.col("n") <= leaves).select("trie", "top"), ["trie", "top"]).select(
        "trie", "top", zero.alias("a"), zero.alias("b"), F.lit(0).alias("side"), "rest", "fp")
    units = small
    large = tops.filter(F.col("n") > leaves).select("trie", "top")
    if large.take(1):
        hot = materialise(rows.join(large, ["trie", "top"]).select("trie", "top", "rest", "fp"), "hot")
        for depth, pairs in node_pairs(hot, budget, leaves).items():
            members = hot.withColumn("node", _node(depth))
            for side, name in ((0, "a"), (1, "b")):
                own = pairs if side == 0 else pairs.filter(F.col("a") != F.col("b"))
                own = own.withColumn("node", F.col(name))
                units = units.unionByName(members.join(own, ["trie", "top", "node"]).select(
                    "trie", "top", "a", "b", F.lit(side).alias("side"), "rest", "fp"))
    placed = units.repartition(*_UNIT).sortWithinPartitions(*_UNIT, "side", "rest")
    return placed.mapInPandas(_joiner(budget, forest, leaves), "u long, v long")


def near_classes(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", budget: int = 2, leaves: int = LEAVES,
) -> DataFrame:
    """Per document: its id, `fp` (long) and `component_id`, the smallest id reachable over links.

    Texts are read once; everything after works on distinct fingerprints.
    """
    own = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    prints = materialise(fingerprints(own, text="_text", keep=["_id"]), "prints")
    least = materialise(prints.groupBy("fp").agg(F.min("_id").alias("_least")), "distinct")
    roots = components(near_links(least.select("fp"), budget=budget, leaves=leaves))
    linked = roots.select(F.col("id").alias("fp"), "root").join(least, "fp")
    ids = linked.groupBy("root").agg(F.min("_least").alias("_class"))
    classes = linked.select("fp", "root").join(ids, "root").select("fp", "_class")
    labels = least.join(classes, "fp", "left").select("fp", F.coalesce("_class", "_least").alias("component_id"))
    labels = materialise(labels, "labels")  # on its own, so that the join can split a fingerprint that very many share
    return prints.join(labels, "fp").select(F.col("_id").alias(doc_id), "fp", "component_id")


def as_hex(fp: str = "fp"):
    """A fingerprint as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
