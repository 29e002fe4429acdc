"""Centroid clustering over dictionary-encoded vectors, in exact integers.

1. Encode: vectors are dealt to chunks. Within a chunk, blocks of dimensions are dictionary-encoded without loss: the
   distinct subvectors, and one code per vector. A block whose subvectors hardly repeat is cut in halves, down to single
   dimensions, whose values do. The encoded chunks are stored once; nothing else is read afterwards.
2. Every round computes the squared distances between the distinct subvectors and the centroids' matching components,
   and sums them by code: the exact distance of each vector to each centroid. The nearest one takes it (ties: the smaller
   number). A chunk then gives, per centroid, its count and its component sums, from counts per code; Spark adds these
   up, and the driver gets one row per centroid.

Chunks bound the memory of a task, whatever the number of vectors or of equal ones; the driver holds the centroids only.

Defined results: vectors with another number of components, a null one, or one that is not finite are left out; component
x is floor(scale * x) computed in doubles; integers beyond +-2^26 raise, since their distances need not fit 64 bits; starting
centroids are the vectors with the least hashes of their ids (ties by components, null ids last); equal vectors and repeated
ids are rows of their own; with fewer vectors than centroids there are as many centroids as vectors; an empty table has
an empty result; other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fareloom.session import materialise

CHUNK = 16_384  # vectors; a chunk may hold up to twice as many, and codes have 16 bits
_LARGEST = 1 << 26


def whole_vectors(vectors: DataFrame, vec_id: str, vector: str, dims: int, scale: int) -> DataFrame:
    """`id` and `v` (array of long) of the vectors that are kept."""
    given = F.col(f"`{vector}`")
    fine = F.forall(given, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    kept = vectors.filter((F.size(given) == dims) & fine)
    limit = F.lit("A component is too large for exact distances.")
    whole = F.transform(given, lambda x: F.when(F.abs(x.cast("double") * scale) <= _LARGEST, F.floor(x.cast("double") * scale))
                        .otherwise(F.raise_error(limit).cast("long")))
    return kept.select(F.col(f"`{vec_id}`").alias("id"), whole.alias("v"))


def subvectors(values: np.ndarray, low: int = 0, width: int = 8) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first dimension, distinct subvectors, code per vector) of blocks that make up all dimensions from `low`."""
    for at in range(0, values.shape[1], width):
        part = np.ascontiguousarray(values[:, at:at + width])
        same = part.view(np.dtype((np.void, part.shape[1] * 8))).ravel()
        _, first, codes = np.unique(same, return_index=True, return_inverse=True)
        if part.shape[1] > 1 and len(first) > len(part) // 4:
            yield from subvectors(part, low + at, part.shape[1] // 2)
        else:
            yield low + at, part[first], codes.astype(np.uint16)


_ENCODED = "ids array<{}>, n int, at array<int>, widths array<int>, sizes array<int>, dictionary binary, codes binary"


def encode(whole: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per chunk: its ids, and per block of dimensions the distinct subvectors and a code per vector."""
    kind = whole.schema["id"].dataType.simpleString()
    if not 0 < chunk <= 32_768:
        raise ValueError("chunk must be 1 to 32,768 vectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names = [], []

        def out() -> pa.RecordBatch:
            values = np.concatenate(held)
            blocks = list(subvectors(values))
            row = {"ids": pa.concat_arrays(names).to_pylist(), "n": len(values), "at": [b[0] for b in blocks],
                   "widths": [b[1].shape[1] for b in blocks], "sizes": [len(b[1]) for b in blocks],
                   "dictionary": b"".join(b[1].astype("<i8").tobytes() for b in blocks),
                   "codes": b"".join(b[2].astype("<u2").tobytes() for b in blocks)}
            held.clear(), names.clear()
            return pa.RecordBatch.from_pylist([row], schema)

        schema = None
        for batch in batches:
            ids = batch.column("id")
            schema = schema or pa.schema([
                ("ids", pa.list_(ids.type)), ("n", pa.int32()), ("at", pa.list_(pa.int32())), ("widths", pa.list_(pa.int32())),
                ("sizes", pa.list_(pa.int32())), ("dictionary", pa.binary()), ("codes", pa.binary())])
            values = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            for low in range(0, len(ids), chunk):
                held.append(values[low:low + chunk].astype(np.int64))
                names.append(ids.slice(low, chunk))
                if sum(map(len, held)) >= chunk:
                    yield out()
        if held:
            yield out()

    return whole.mapInArrow(run, _ENCODED.format(kind))


def blocks_of(row: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first dimension, distinct subvectors, code per vector) of an encoded chunk."""
    values, codes = np.frombuffer(row["dictionary"], "<i8"), np.frombuffer(row["codes"], "<u2")
    low = 0
    for k, (at, width, size) in enumerate(zip(row["at"], row["widths"], row["sizes"])):
        yield at, values[low:low + size * width].reshape(size, width), codes[k * row["n"]:(k + 1) * row["n"]]
        low += size * width


def distances(row: dict, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of every vector of a chunk to every centroid: partial distances summed by code."""
    total = np.zeros((row["n"], len(centroids)), np.int64)
    for at, distinct, codes in blocks_of(row):
        gap = distinct[:, None, :] - centroids[None, :, at:at + distinct.shape[1]]
        total += np.einsum("mkw,mkw->mk", gap, gap)[codes]
    return total


def _each_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def next_centroids(encoded: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the means of the vectors nearest to each centroid; a centroid without any stays."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for row in _each_chunk(batches):
            nearest = distances(row, centroids).argmin(1)
            count += np.bincount(nearest, minlength=len(centroids))
            for at, distinct, codes in blocks_of(row):
                seen = np.bincount(nearest * len(distinct) + codes, minlength=len(centroids) * len(distinct))
                total[:, at:at + distinct.shape[1]] += seen.reshape(len(centroids), -1) @ distinct
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(range(len(centroids)), pa.int32()), "n": pa.array(count),
                                          "total": pa.array(total.tolist(), pa.list_(pa.int64()))})

    chunks = encoded.select("n", "at", "widths", "sizes", "dictionary", "codes")
    parts = chunks.mapInArrow(sums, "cluster int, n long, total array<long>").filter("n > 0")
    dims = [F.sum(F.get("total", F.lit(k))).alias(f"d{k}") for k in range(centroids.shape[1])]
    moved = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *dims).collect():
        moved[row.cluster] = [row[f"d{k}"] // row.n for k in range(centroids.shape[1])]
    return moved


def assign(encoded: DataFrame, centroids: np.ndarray) -> DataFrame:
    """`id`, `cluster` and `distance` (squared) of every vector."""
    kind = encoded.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                chunk = batch.slice(k, 1)
                total = distances(chunk.drop_columns(["ids"]).to_pylist()[0], centroids)
                nearest = total.argmin(1)
                yield pa.RecordBatch.from_arrays([
                    chunk.column("ids").flatten(), pa.array(nearest.astype(np.int32)),
                    pa.array(total[np.arange(len(total)), nearest])], ["id", "cluster", "distance"])

    return encoded.mapInArrow(run, f"id {kind}, cluster int, distance long")


def cluster(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 1024,
            k: int = 8, rounds: int = 10, seed: str = "3:", chunk: int = CHUNK) -> tuple[DataFrame, np.ndarray]:
    """`id`, `cluster`, `distance` of every kept vector, and the final centroids."""
    whole = whole_vectors(vectors, vec_id, vector, dims, scale)
    named = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    start = whole.orderBy(named.asc_nulls_last(), "v").limit(k).collect()
    if not start:
        return whole.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).filter("false"), np.zeros((0, dims), np.int64)
    centroids = np.array([r.v for r in start], np.int64)
    encoded = materialise(encode(whole, chunk), "encoded")
    for _ in range(rounds):
        centroids = next_centroids(encoded, centroids)
    return assign(encoded, centroids), centroids
