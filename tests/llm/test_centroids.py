from hashlib import sha256

import numpy as np
import pytest

from fareloom.llm import centroids as cent, queries

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance string, v int, id string"


def plain(vectors, k, rounds, scale=1024, seed="3:"):
    """{row: (cluster, distance)} and centroids, in Python integers. `vectors`: (id, list of floats), those to keep."""
    whole = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in vectors]
    name = lambda x: (x[0] is None, sha256(f"{seed}{x[0]}".encode()).hexdigest() if x[0] is not None else "", x[1])
    cents = [v for _, v in sorted(whole, key=name)[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((gap(v, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in whole]
        groups = [[v for (_, v), o in zip(whole, own) if o == j] for j in range(len(cents))]
        cents = [[sum(c) // len(g) for c in zip(*g)] if g else old for g, old in zip(groups, cents)]
    return sorted(((i, *reversed(near(v))) for i, v in whole), key=repr), cents


def check(spark, vectors, dims, k=3, rounds=4, chunk=7, extra=()):
    rows = [(i, v, "c", "d", 5, "x") for i, v in [*vectors, *extra]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found, final = cent.cluster(df, dims=dims, k=k, rounds=rounds, chunk=chunk)
    want, cents = plain(vectors, k, rounds)
    assert sorted(((r.id, r.cluster, r.distance) for r in found.collect()), key=repr) == want
    assert final.tolist() == cents


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(0, 0.3, 4).tolist()) for i in range(80)]
    nan, inf = float("nan"), float("inf")
    odd = [(200, None), (201, []), (202, [0.1, 0.2, 0.3]), (203, [0.1, None, 0.2, 0.3]), (204, [nan, 0.0, 0.0, 0.0]),
           (205, [0.0, inf, 0.0, 0.0]), (206, [0.0, 0.0, -inf, 0.0]), (207, [0.0] * 5)]
    check(spark, vectors, 4, extra=odd)
    hot = [(i, [0.5, -0.25, 0.0, 1.0]) for i in range(300, 340)] + [(None, [0.1, 0.2, 0.3, 0.4]), (5, [9.0, -9.0, 9.0, -9.0])]
    check(spark, vectors + hot, 4, k=5, chunk=1000)


def test_ties_few_and_equal_vectors(spark):
    check(spark, [(1, [0.0, 0.0]), (2, [0.0, 0.0])], 2, k=8)
    check(spark, [(i, [float(i % 2), -0.001]) for i in range(12)], 2, k=4)
    found, final = cent.cluster(spark.createDataFrame([], SCHEMA))
    assert found.collect() == [] and final.shape == (0, 64)


def test_large_components_raise(spark):
    df = spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        cent.cluster(df, dims=2)


def test_dictionaries_are_lossless_and_shrink_repeats():
    rng = np.random.default_rng(4)
    values = rng.integers(-300, 300, (5000, 16))
    values[:4000, 8:] = rng.integers(-300, 300, (50, 8))[rng.integers(0, 50, 4000)]
    back, widths = np.zeros_like(values), {}
    for at, distinct, codes in cent.subvectors(values):
        back[:, at:at + distinct.shape[1]] = distinct[codes]
        widths[at] = distinct.shape[1]
        assert len(distinct) <= max(600, len(values) // 4)
    assert (back == values).all() and widths[8] == 8 and widths[0] == 1


def test_registered_query(spark, sf_dir):
    rows = queries.op13_centroids(spark, sf_dir).collect()
    data = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    kept = [(i, v) for i, v in data if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    want, cents = plain(kept, 8, 10)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in rows), key=repr) == want
    assert {(r.cluster, r.centroid_sha256) for r in rows} == {(j, sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for _, j, _ in want}
    assert {r.inertia for r in rows} == {sum(d for *_, d in want)}
