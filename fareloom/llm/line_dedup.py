"""Line dedup: two Bloom filters find suspected repeats, which alone are shuffled and confirmed exactly.

A line's key is the line without white space at both ends and with A-Z lower-cased. Keys of at least `min_chars` code
points that occur in at least `min_docs` documents lose all their lines, except in the document with the largest id.

1. Every task hashes the keys of its documents and gives the positions they set in a filter of keys seen once, and of
   keys its own documents repeat, by segment of the filter. The segments are united: a position set by two tasks is set
   in the filter of keys seen twice. No repeated key can be missing there.
2. The second filter has `bits` bits whatever the input, and is broadcast. Keys whose positions it has are suspects and
   go through an exact count by key. A full filter only makes more suspects; it never changes the result.
3. The documents meet the keys they lose by id and are rewritten.

Defined results: a null or empty text is one empty line; rows with one id are one document, and keep or lose a key
together; a row without an id is no document to count, but loses the keys that documents repeat; other columns pass through; an empty table has an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from fareloom.llm.common import per_text, spread, without
from fareloom.session import materialise

# Bits of either filter: 32 MB to broadcast.
BITS = 2 ** 28
_SEGMENT = 20  # a segment of the filters has 2 ** 20 bits
_CHUNK = 1_000_000  # hashes a task gathers before it hands on their positions
_SPACES = b"\t\n\x0b\x0c\r "


def line_key(line: bytes) -> bytes:
    return line.strip(_SPACES).lower()


def long_keys(raw: bytes | None, min_chars: int) -> set[bytes]:
    """The distinct keys of a text that are long enough."""
    keys = map(line_key, (raw or b"").split(b"\n"))
    return {k for k in keys if len(k) >= min_chars and (k.isascii() or len(k.decode("utf-8", "replace")) >= min_chars)}


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The two positions of each hash in a filter of `bits` bits, a power of two."""
    mask = np.uint64(bits - 1)
    return np.stack([hashes & mask, (hashes >> np.uint64(32) ^ hashes << np.uint64(7)) & mask])


def _segments(hashes: list[int], bits: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Per segment the sorted positions within it that are set once or more, and by keys seen twice or more."""
    distinct, seen = np.unique(np.array(hashes, np.uint64), return_counts=True)
    once, twice = (np.unique(positions(h, bits)) for h in (distinct, distinct[seen > 1]))
    edges = np.arange(0, bits + 1, min(bits, 2 ** _SEGMENT), dtype=np.uint64)
    a, b = np.searchsorted(once, edges), np.searchsorted(twice, edges)
    for k in range(len(edges) - 1):
        if a[k] < a[k + 1]:
            yield k, *((x[lo[k]:lo[k + 1]] - edges[k]).astype("<u4").tobytes() for x, lo in ((once, a), (twice, b)))


def twice_seen(docs: DataFrame, text: str, min_chars: int, bits: int) -> DataFrame:
    """The filter of keys seen twice: per segment its set bits, packed. At most bits / 2 ** 20 rows."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, hashes = xxhash.xxh64_intdigest, []

        def out() -> pa.RecordBatch:
            rows = list(_segments(hashes, bits))
            hashes.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))],
                ["segment", "once", "twice"])

        for batch in batches:
            for raw in batch.column("text").cast(pa.binary()):
                hashes.extend(map(digest, long_keys(raw.as_py(), min_chars)))
                if len(hashes) >= _CHUNK:
                    yield out()
        if hashes:
            yield out()

    def unite(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = min(bits, 2 ** _SEGMENT)
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for frame in frames:
            for segment, new, repeated in frame.itertuples(index=False):
                if segment not in once:
                    once[segment], twice[segment] = np.zeros(size, bool), np.zeros(size, bool)
                new = np.frombuffer(new, "<u4")
                twice[segment][new[once[segment][new]]] = True
                twice[segment][np.frombuffer(repeated, "<u4")] = True
                once[segment][new] = True
        rows = [(s, np.packbits(b, bitorder="little").tobytes()) for s, b in twice.items()]
        yield pd.DataFrame(rows, columns=["segment", "bits"])

    marks = spread(docs, text, []).select("text").mapInArrow(mark, "segment int, once binary, twice binary")
    return marks.repartition("segment").mapInPandas(unite, "segment int, bits binary")


def suspects(docs: DataFrame, text: str, doc_id: str, filter_bits: np.ndarray, min_chars: int, bits: int) -> DataFrame:
    """`id` and `key` of every document and key that the filter has."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_bits)

    def make():
        held, digest = shared.value, xxhash.xxh64_intdigest

        def work(texts):
            for raw in texts:
                keys = list(long_keys(raw, min_chars))
                if keys:
                    at = positions(np.fromiter(map(digest, keys), np.uint64, len(keys)), bits)
                    hit = (held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(0)
                    keys = [k for k, h in zip(keys, hit.tolist()) if h]
                yield {"keys": keys}

        return work

    found = per_text(docs, text, [doc_id], "keys array<binary>", make)
    return found.select(F.col(f"row.`{doc_id}`").alias("id"), F.explode("made.keys").alias("key"))


def drop_repeated_lines(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, min_chars: int = 20,
    min_docs: int = 3, bits: int = BITS,
) -> DataFrame:
    """The kept columns, the rewritten text, n_lines (before) and n_dropped."""
    keep = docs.columns if keep is None else keep
    others = without(keep, ["n_lines", "n_dropped", text])
    held = np.zeros(bits // 8, np.uint8)
    for row in twice_seen(docs, text, min_chars, bits).toLocalIterator():
        low = row.segment * 2 ** _SEGMENT // 8
        held[low:low + len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    found = materialise(suspects(docs, text, doc_id, held, min_chars, bits), "suspects")
    repeated = found.groupBy("key").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper")).filter(
        F.col("n") >= min_docs).select("key", "keeper")
    repeated = materialise(repeated, "repeated")  # on its own, so that the join can split a key that very many hold
    lost = found.join(repeated, "key").filter(~F.col("id").eqNullSafe(F.col("keeper")))
    lost = lost.groupBy(F.col("id").alias("_lost_id")).agg(F.collect_set("key").alias("_lost"))
    kept = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("int")
    source = docs.select(kept.alias("_row"), F.col(f"`{text}`").alias("_text"), F.col(f"`{doc_id}`").alias("_id"))
    met = source.join(lost, F.col("_id").eqNullSafe(F.col("_lost_id")), "left")

    def make():
        def one(raw: bytes | None, keys: list[bytes] | None) -> dict:
            lines = (raw or b"").split(b"\n")
            gone = set(keys or ())
            left = [x for x in lines if line_key(x) not in gone] if gone else lines
            return {"text": b"\n".join(left).decode("utf-8", "replace"), "n_lines": len(lines),
                    "n_dropped": len(lines) - len(left)}

        return lambda texts, lost_keys: map(one, texts, lost_keys)

    done = per_text(met, "_text", ["_row"], "text string, n_lines long, n_dropped long", make, extra=F.col("_lost"))
    return done.select(*[F.col(f"row._row.`{c}`").alias(c) for c in others], F.col("made.text").alias(text),
                       "made.n_lines", "made.n_dropped")
