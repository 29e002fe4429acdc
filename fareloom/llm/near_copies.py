"""Classes of near copies: documents whose word shingles have a Jaccard similarity of at least 0.8.

Words and shingles are those of `simhash`, five words instead of three, each counted once; a text of fewer words is one
shingle. At this similarity two 64-bit SimHash fingerprints differ in some 10 bits and often in 17, where a trie
self-join drops hardly any pair of nodes; candidates come from MinHash bands, or with `by_simhash` from SimHash tables
(`simhash_tables`). Their number follows from the wanted probability that a pair at the least similarity meets in one.
Every candidate is confirmed by the exact similarity of the shingle sets, so no class rests on an estimate.

Equal shingle sets are one node. Within a bucket (the sets with one band value, or a group of the tables) every set is first compared with one
pivot, the set that meets most others, and what is confirmed is united; only buckets that still hold several classes go on,
at last with all pairs of different classes, which are compared block by block within tasks; only links leave a task. So a
large group of near copies costs a few comparisons per set where they resemble one, and no pair is left out; the work of
the last step still grows with the square of a group whose members resemble none. Shingles are made anew only for sets in
candidate pairs.

Defined results: texts without words are copies of each other; repeated rows and ids each keep their row; a null id never
is a class's id unless all its ids are null; an empty table has an empty result.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from fareloom.llm.common import opened, per_text
from fareloom.llm.components import components
from fareloom.llm.simhash import forest
from fareloom.llm.simhash_tables import met_groups, wide_fingerprint
from fareloom.session import materialise

SIMILARITY, SHINGLE = 0.8, 5
# Rows of a band, and wanted probability that a pair at the least similarity has a band in common.
ROWS, CERTAIN = 5, 0.9999
# Rounds of pivots before all pairs of different classes in a bucket are compared.
PIVOTS = 1
# Sets of a bucket that a task takes on either side, and their shingles.
BLOCK, BLOCK_SHINGLES = 1024, 500_000


def bands(similarity: float = SIMILARITY, certain: float = CERTAIN, rows: int = ROWS) -> int:
    """Bands of which at least one collides with probability `certain` at that similarity."""
    met = similarity ** rows
    return 1 if met >= 1 else math.ceil(math.log(1 - certain) / math.log(1 - met))


def shingle_set(raw: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the shingles of a UTF-8 text."""
    words = raw.lower().split() if raw else []
    count = max(1, len(words) - shingle + 1) if words else 0
    digest, found = xxhash.xxh64_intdigest, np.zeros(0, np.uint64)
    for low in range(0, count, 65536):  # very long texts go piece by piece
        own = words[low:min(count, low + 65536) + shingle - 1]
        runs = zip(*[own[k:] for k in range(min(shingle, len(own)))])
        found = np.union1d(found, np.array([digest(b" ".join(s), 42) for s in runs], np.uint64))
    return found


def _mixers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per permutation what is XORed to a hash and the odd number it is then multiplied by."""
    rng = np.random.default_rng(17)
    salt, odd = rng.integers(0, 2 ** 64, (2, n), np.uint64)
    return salt[:, None], (odd | np.uint64(1))[:, None]


def signature(hashes: np.ndarray, n: int, rows: int = ROWS) -> list[int]:
    """Values of `n` bands of `rows` minima each, as signed longs."""
    if not len(hashes):
        return []
    salt, odd = _mixers(n * rows)
    least = np.full(n * rows, 2 ** 64 - 1, np.uint64)
    for low in range(0, len(hashes), 4096):
        least = np.minimum(least, ((hashes[None, low:low + 4096] ^ salt) * odd).min(1))
    width, raw = 8 * rows, least.tobytes()
    found = [xxhash.xxh64_intdigest(raw[k * width:(k + 1) * width], k) for k in range(n)]
    return np.array(found, np.uint64).view(np.int64).tolist()


def signatures(docs: DataFrame, *, text: str, keep: list[str], shingle: int, sign: Callable, kind: str) -> DataFrame:
    """The kept columns, `set` (a hash of the shingle set), `size` and `signs`: what `sign` makes of the set, of that kind."""
    def make():
        def one(raw: bytes | None) -> dict:
            own = shingle_set(raw, shingle)
            name = int(np.array([xxhash.xxh64_intdigest(own.tobytes(), 42)], np.uint64).view(np.int64)[0])
            return {"set": name, "size": len(own), "signs": sign(own)}

        return lambda texts: map(one, texts)

    return opened(per_text(docs, text, keep, f"set long, size int, signs {kind}", make), keep, ["set", "size", "signs"])


def shingle_sets(docs: DataFrame, nodes: DataFrame, *, shingle: int) -> DataFrame:
    """`set` and `own`, its sorted hashes, for the sets in `nodes` (set, _at), each made from the document at `_at`."""
    def make():
        return lambda texts: [{"own": shingle_set(raw, shingle).view(np.int64).tolist()} for raw in texts]

    met = docs.select(_place().alias("_at"), "_text").join(nodes, "_at").select("set", "_text")
    made = opened(per_text(met, "_text", ["set"], "own array<long>", make), ["set"], ["own"])
    return made.groupBy("set").agg(F.first("own").alias("own"))  # rows may be repeated


def _place():
    """A document's id and the hash of its text; within a struct, null equals null."""
    return F.struct("_id", F.xxhash64("_text").alias("_hash"))


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets have at least that Jaccard similarity."""
    both = pairs.join(sets.select(F.col("set").alias("u"), F.col("own").alias("a")), "u").join(
        sets.select(F.col("set").alias("v"), F.col("own").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    rated = both.select("u", "v", shared.alias("n"), (F.size("a") + F.size("b") - shared).alias("all"))
    return rated.filter(F.col("n") >= F.lit(similarity) * F.col("all") - 1e-9).select("u", "v")


def spanning(links: DataFrame) -> DataFrame:
    """Links that connect the same sets, without those that close a circle within a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # without pandas, which every worker would keep
        for batch in batches:
            pairs = forest(batch.column("u").to_numpy(), batch.column("v").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    return links.mapInArrow(run, "u long, v long")


def _ordered(pairs: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs u < v of sets (columns x, y, each with its size) whose sizes allow the similarity."""
    least, most = F.least("x.size", "y.size"), F.greatest("x.size", "y.size")
    fit = pairs.filter((F.col("x.set") != F.col("y.set")) & (least >= F.lit(similarity) * most - 1e-9))
    return fit.select(F.least("x.set", "y.set").alias("u"), F.greatest("x.set", "y.set").alias("v")).distinct()


def _shared(nodes: DataFrame) -> DataFrame:
    """Sets and the band values that several of them share."""
    rows = nodes.select("set", F.explode("signs").alias("band"))
    return rows.join(rows.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band"), "band")


def _members(nodes: DataFrame, buckets: DataFrame) -> DataFrame:
    """Sets (x: set, size) by bucket (rows band, set), each a class of its own, with `met`: how many sets it meets in all
    its buckets, unless they bring it. A set that many others are copies of meets the most."""
    rows = buckets.join(nodes.select("set", "size"), "set")
    if "met" in buckets.columns:
        return rows.select("band", F.struct("set", "size").alias("x"), F.col("set").alias("class"), "met")
    rows = materialise(rows, "shared")
    own = rows.join(rows.groupBy("band").agg(F.count("*").alias("n")), "band")
    met = own.groupBy("set").agg(F.sum("n").alias("met"))
    return rows.join(met, "set").select("band", F.struct("set", "size").alias("x"), F.col("set").alias("class"), "met")


def by_minhash(similarity: float, certain: float) -> tuple[str, Callable, Callable]:
    """Kind of the signs, the signs of a set, and the buckets of sets by them: MinHash bands."""
    n = bands(similarity, certain)
    return "array<long>", lambda own: signature(own, n), _shared


def by_simhash(similarity: float, certain: float) -> tuple[str, Callable, Callable]:
    """The same: SimHash fingerprints, and groups of near ones."""
    def near(nodes: DataFrame) -> DataFrame:
        return met_groups(nodes.select("set", F.col("signs").alias("print")), similarity=similarity, certain=certain)

    return "binary", wide_fingerprint, near


def block_links(members: DataFrame, sets: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """Confirmed links (u, v) between sets of different classes in one bucket, enough of them to unite the classes.

    A bucket is cut into blocks of some `block` sets, or fewer if they are large, and each pair of blocks is compared in a
    task: shingles in common are counted over the postings of the two blocks. No pair leaves the task unless it is a link.
    """
    sizes = members.groupBy("band").agg(F.greatest(
        F.ceil(F.count("*") / block), F.ceil(F.sum("x.size") / BLOCK_SHINGLES)).cast("int").alias("n"))
    rows = members.join(sizes, "band").select("band", "class", F.col("x.set").alias("set"), "n")
    own, other = F.pmod(F.xxhash64("set"), F.col("n")), F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    rows = rows.select("band", "class", "set", own.cast("int").alias("own_block"), other.alias("other"))
    rows = rows.select("band", "class", "set", F.least("own_block", "other").alias("i"), F.greatest("own_block", "other").alias("j"))

    def compare(table: pa.Table) -> pa.Table:
        lists = table.column("own").combine_chunks()
        ends = lists.offsets.to_numpy()
        tokens = np.unique(lists.values.to_numpy()[ends[0]:ends[-1]], return_inverse=True)[1]
        ends, size = ends - ends[0], np.diff(ends)
        holder = np.repeat(np.arange(len(size)), size)
        order = np.argsort(tokens, kind="stable")
        posted, begins = holder[order], np.searchsorted(tokens[order], np.arange(tokens.max() + 2 if len(tokens) else 1))
        name, label = table.column("set").to_numpy(), table.column("class").to_numpy().copy()
        u, v = [], []
        for k in range(len(size)):
            mine = tokens[ends[k]:ends[k + 1]]
            if not len(mine):
                continue
            shared = np.bincount(np.concatenate([posted[begins[t]:begins[t + 1]] for t in mine.tolist()]), minlength=len(size))
            near = np.flatnonzero((label != label[k]) & (shared >= similarity * (size + size[k] - shared) - 1e-9))
            for x in near.tolist():
                if label[x] != label[k]:
                    u.append(name[k]), v.append(name[x])
                    label[label == label[x]] = label[k]
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    met = rows.join(sets, "set").select("band", "i", "j", "set", "class", "own")
    return met.groupBy("band", "i", "j").applyInArrow(compare, "u long, v long")


def near_links(members: DataFrame, sets: DataFrame, *, similarity: float, pivots: int = PIVOTS) -> DataFrame:
    """Confirmed links (u, v) that connect the same sets as all confirmed candidates."""
    tried = links = None
    for turn in range(pivots + 1):
        if turn == pivots:
            found = materialise(block_links(members, sets, similarity).distinct(), "found")
            return found if links is None else links.union(found)
        # First the set that meets most others: in a group of copies the one they were made from. Then another order of
        # the sets in every round. Either order is the same in all buckets, so that buckets share pivots.
        order = F.xxhash64(F.col("x.set"), F.lit(turn)) if turn else -F.col("met")
        pivot = members.groupBy("band").agg(F.min(F.struct(order.alias("o"), "x")).alias("p"))
        pairs = _ordered(members.join(pivot.select("band", F.col("p.x").alias("y")), "band").select("x", "y"), similarity)
        pairs = materialise(pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti"), "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        found = materialise(spanning(confirmed(pairs, sets, similarity)), "found")
        links = found if links is None else links.union(found)
        roots = components(links).select(F.col("id").alias("set"), "root")
        named = members.select("band", "x", "met", F.col("x.set").alias("set")).join(roots, "set", "left")
        named = materialise(named.select("band", "x", "met", F.coalesce("root", "set").alias("class")), "named")
        several = named.groupBy("band").agg(F.min("class").alias("a"), F.max("class").alias("b")).filter("a <> b")
        members = materialise(named.join(several.select("band"), "band"), "members")
        if not members.take(1):
            return links
    return links


def set_links(prints: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (u, v) between the shingle sets (prints: _id, set) of documents that are one class (_id, _class), from each to the
    least. Within a struct, null equals null."""
    own = prints.select(F.struct("_id").alias("_k"), "set").distinct()
    named = classes.select(F.struct("_id").alias("_k"), F.struct("_class").alias("_class")).distinct()
    held = materialise(own.join(named, "_k").select("_class", "set").distinct(), "held")
    least = held.groupBy("_class").agg(F.min("set").alias("u"), F.max("set").alias("most")).filter("u <> most").select("_class", "u")
    return held.join(least, "_class").select("u", F.col("set").alias("v")).filter("u <> v")


def near_classes(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY,
    shingle: int = SHINGLE, certain: float = CERTAIN, candidates: Callable = by_minhash, united: DataFrame | None = None,
) -> DataFrame:
    """Per document: its id and `component_id`, the smallest id reachable over pairs of that similarity.

    Documents of one class in `united` (the id and `component_id`, as `simhash.near_classes` returns them; an id stands for one text)
    stay in one class, whatever their similarity."""
    own = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    kind, sign, buckets = candidates(similarity, certain)
    prints = signatures(own.withColumn("_at", _place()), text="_text", keep=["_id", "_at"], shingle=shingle, sign=sign, kind=kind)
    prints = materialise(prints, "prints")
    least = materialise(prints.groupBy("set").agg(
        F.min("_id").alias("_least"), F.min("_at").alias("_at"), F.first("size").alias("size"), F.first("signs").alias("signs")), "distinct")
    members = materialise(_members(least, buckets(least)), "members")
    wanted = least.join(members.select(F.col("x.set").alias("set")).distinct(), "set").select("set", "_at")
    sets = materialise(shingle_sets(own, wanted, shingle=shingle), "sets")
    links = near_links(members, sets, similarity=similarity)
    if united is not None:
        classes = united.select(F.col(f"`{doc_id}`").alias("_id"), F.col("component_id").alias("_class"))
        links = links.union(set_links(prints, classes))
    roots = components(links)
    linked = roots.select(F.col("id").alias("set"), "root").join(least.select("set", "_least"), "set")
    ids = linked.groupBy("root").agg(F.min("_least").alias("_class"))
    classes = linked.select("set", "root").join(ids, "root").select("set", "_class")
    labels = least.join(classes, "set", "left").select("set", F.coalesce("_class", "_least").alias("component_id"))
    labels = materialise(labels, "labels")  # on its own, so that the join can split a set that very many share
    return prints.select("_id", "set").join(labels, "set").select(F.col("_id").alias(doc_id), "component_id")
