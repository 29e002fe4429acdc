"""Substring dedup: relative Lempel-Ziv parsing of every document against indexed reference blocks.

The whole table is its own reference. Documents in ascending id order are cut into reference blocks of bounded size.

1. Each block is indexed: the distinct hashes of its windows of `size` words, sorted, cut into hash ranges. A window that
   very many documents share is one entry per block.
2. A task per hash range unites the blocks' entries: the first block that holds a window. Every block learns which of its
   windows an earlier block holds.
3. Each document is parsed greedily. A factor starts at a window that an earlier document holds (in an earlier block, or in
   its own, whose documents are indexed on the spot) and runs on while the next window continues it in the same block. The
   next factor starts at the boundary; the windows that cross the boundary are looked up too, and those that are found
   are factors of their own, so that a match which the greedy choice cut in two is not lost. Every factor has at least
   `size` words and is a duplicate span. Words outside all spans stay.

Windows meet as 64-bit hashes. Of 10^9 windows some 0.03 pairs meet by chance, of 10^13 some three million, and such a pair
costs the words of one window.

Defined results: null and empty texts have no words; white space is that of `common.SPACES`; a null id is smaller than any
other; documents with equal ids are no copies of each other's windows, but any other smaller id's; blocks of one id are cut
by a hash of the text, so an id that very many rows share is spread; within one document repeats stay; other columns pass
through; an empty table has an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fareloom.llm.common import spread, without
from fareloom.session import materialise

SIZE = 13
# Text bytes of a reference block, and of the documents whose windows one hash range takes.
BLOCK_BYTES, RANGE_BYTES = 12_000_000, 24_000_000
_MASK = (1 << 64) - 1


def window_hashes(words: list[bytes], size: int) -> np.ndarray:
    """64-bit hash of every run of `size` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += each[k:k + n] * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1) ** 5 | 1) & _MASK)
    total ^= total >> np.uint64(32)
    total *= np.uint64(0xD6E8FEB86659FD93)
    return total ^ total >> np.uint64(29)


def packed(values: np.ndarray) -> bytes:
    """The bytes of equal weight side by side: sorted numbers share their high bytes, which then compress."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def unpacked(raw: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def factors(found: np.ndarray, source: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(first word, words, block) of the factors over the windows that are found: runs of windows of one block."""
    at = np.flatnonzero(found)
    if not len(at):
        return []
    cuts = np.flatnonzero((np.diff(at) != 1) | (np.diff(source[at]) != 0))
    first, last = at[np.append(0, cuts + 1)], at[np.append(cuts, len(at) - 1)]
    return list(zip(first.tolist(), (last - first + size).tolist(), source[first].tolist()))


def covered(spans: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Which of `n` words lie in a span."""
    edge = np.zeros(n + 1, np.int32)
    for start, length, _ in spans:
        edge[start] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def _above(value: Column, lows: list) -> Column:
    """How many of the sorted `lows` are not above `value`, by binary search; 0 for null."""
    if not lows:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(lows).bit_length()))]
    return F.aggregate(F.lit(steps), F.lit(0), lambda r, s: F.when(
        F.coalesce(F.get(F.lit(lows), r + s - 1) <= value, F.lit(False)), r + s).otherwise(r))


def reference_blocks(docs: DataFrame, text: str, doc_id: str, block_bytes: int) -> tuple[Column, Column, int, int]:
    """Order and part of a document's block as columns, the number of blocks, and the bytes of all texts.

    Blocks with one order number hold one id only. The driver gets one row of bounds per block.
    """
    sizes = materialise(docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.octet_length(F.col(f"`{text}`").cast("string")), F.lit(0)).alias("bytes")), "sizes")
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    dealt = sizes.repartitionByRange(max(1, -(-total // block_bytes)), "id").withColumn("part", F.spark_partition_id())
    parts = dealt.groupBy("part", F.col("id").isNull().alias("unknown")).agg(
        F.min("id").alias("low"), F.max("id").alias("high"), F.sum("bytes").alias("bytes")).collect()
    known = sorted((p for p in parts if not p.unknown), key=lambda p: p.low)
    lows = [p.low for p in known]
    unknown = sum(p.bytes for p in parts if p.unknown)
    split = [max(1, -(-unknown // block_bytes))] + [-(-p.bytes // block_bytes) or 1 if p.low == p.high else 1 for p in known]
    order = _above(F.col(f"`{doc_id}`"), lows)
    part = F.pmod(F.xxhash64(F.col(f"`{text}`").cast("string")), F.get(F.lit(split), order)).cast("int")
    return order, part, sum(split), total


def parse(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, size: int = SIZE,
          block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The kept columns, the text's remaining words joined by one space, n_words (before), n_removed, and `spans`: first
    word, words and number of the reference block (in id order) of every duplicate span."""
    keep = docs.columns if keep is None else keep
    others = without(keep, ["n_words", "n_removed", "spans", text])
    order, part, n_blocks, total = reference_blocks(docs, text, doc_id, block_bytes)
    ranges = max(1, -(-total // range_bytes))
    whole = spread(docs, text, others, F.struct(F.col(f"`{doc_id}`").alias("id"), order.alias("order"), part.alias("part")))
    # One exchange of the texts serves the index and the parse.
    dealt = whole.select("row", "text", "extra.id", "extra.order", "extra.part").repartition(n_blocks, "order", "part")

    def texts(table: pa.Table) -> Iterator[list[bytes]]:
        return ((t or b"").split() for t in table.column("text").cast(pa.binary()).to_pylist())

    def index(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        hashes = np.unique(np.concatenate([np.zeros(0, np.uint64), *(window_hashes(w, size) for w in texts(table))]))
        edges = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)
        cuts = [0, *np.searchsorted(hashes, edges).tolist(), len(hashes)]
        rows = [(k, packed(hashes[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
        n = len(rows)
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([key[0].as_py()] * n, pa.int32()),
                         pa.array([key[1].as_py()] * n, pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                        ["range", "order", "part", "hashes"])

    def unite(table: pa.Table) -> pa.Table:
        table = table.sort_by("order")
        orders = table.column("order").to_pylist()
        held = [unpacked(raw, np.uint64) for raw in table.column("hashes").to_pylist()]
        known, at = np.unique(np.concatenate(held), return_index=True)  # the first of equal ones: the earliest block
        first = np.repeat(np.array(orders, np.int32), [len(h) for h in held])[at]
        rows = []
        for own, mine, hashes in zip(orders, table.column("part").to_pylist(), held):
            origin = first[np.searchsorted(known, hashes)]
            old = origin < own
            if old.any():
                rows.append((own, mine, packed(hashes[old]), packed(origin[old])))
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                        ["order", "part", "hashes", "origins"])

    indexed = dealt.groupBy("order", "part").applyInArrow(index, "range int, order int, part int, hashes binary")
    earlier = indexed.groupBy("range").applyInArrow(unite, "order int, part int, hashes binary, origins binary")

    made = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"),
                    F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit(0).alias("block"))).alias("spans"))
    out = dealt.select("row", made.alias("made")).schema
    kind = to_arrow_type(out["made"].dataType)

    def factor(key: tuple[pa.Scalar, ...], table: pa.Table, known: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([table.column("row").combine_chunks(), pa.array([], kind)], ["row", "made"])
        own = key[0].as_py()
        hashes = np.concatenate([np.zeros(0, np.uint64), *(unpacked(r, np.uint64) for r in known.column("hashes").to_pylist())])
        origins = np.concatenate([np.zeros(0, np.int32), *(unpacked(r, np.int32) for r in known.column("origins").to_pylist())])
        by = np.argsort(hashes)
        hashes, origins = hashes[by], origins[by]
        ids = table.column("id").to_pylist()
        smallest_first = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] if ids[k] is not None else 0))
        words = list(texts(table))
        windows = [window_hashes(words[k], size) for k in smallest_first]
        place = np.cumsum([0] + [int(a and ids[smallest_first[a]] != ids[smallest_first[a - 1]]) for a in range(len(ids))])[1:]
        every, nth = np.concatenate(windows), np.repeat(place, [len(w) for w in windows])
        # Windows of this block: the first document that holds each.
        by = np.argsort(every, kind="stable")
        ordered, nth = every[by], nth[by]
        new = np.append(True, ordered[1:] != ordered[:-1])[:len(ordered)]
        first = nth[new][np.cumsum(new) - 1]
        # Windows of earlier blocks.
        at = np.minimum(np.searchsorted(hashes, ordered), max(len(hashes) - 1, 0))
        old = hashes[at] == ordered if len(hashes) else np.zeros(len(ordered), bool)
        found, source = np.zeros(len(every), bool), np.full(len(every), own, np.int32)
        found[by] = old | (first < nth)
        if len(hashes):
            source[by] = np.where(old, origins[at], own)
        results, low = [None] * len(ids), 0
        for k, w in zip(smallest_first, windows):
            high, mine = low + len(w), words[k]
            spans = factors(found[low:high], source[low:high], size)
            low = high
            left = mine
            if spans:
                gone = covered(spans, len(mine)).tolist()
                left = [x for x, g in zip(mine, gone) if not g]
            results[k] = {"text": b" ".join(left).decode("utf-8", "replace"), "n_words": len(mine),
                          "n_removed": len(mine) - len(left),
                          "spans": [{"start": a, "length": n, "block": b} for a, n, b in spans]}
        return pa.table([table.column("row").combine_chunks(), pa.array(results, kind)], ["row", "made"])

    parsed = dealt.groupBy("order", "part").cogroup(earlier.groupBy("order", "part")).applyInArrow(factor, out)
    return parsed.select(*[F.col(f"row.`{c}`").alias(c) for c in others], F.col("made.text").alias(text),
                         "made.n_words", "made.n_removed", "made.spans")
