import itertools
import random

import numpy as np

import cases
from fareloom.llm import mixing


def shares(sizes, weights=(5, 2, 1), times=3):
    """Targets by resharing the excess again and again."""
    total, free = float(sum(sizes)), set(range(len(sizes)))
    w = [weights[k % len(weights)] for k in range(len(sizes))]
    out = [0.0] * len(sizes)
    while free:
        left = total - sum(out[k] for k in range(len(sizes)) if k not in free)
        level = left / sum(w[k] for k in free)
        over = {k for k in free if level * w[k] > times * sizes[k]}
        for k in free:
            out[k] = min(level * w[k], times * sizes[k])
        if not over:
            break
        free -= over
    return out


def test_targets(spark):
    rng = random.Random(0)
    for n in (1, 2, 5, 12):
        names = [None, *(f"s{k}" for k in range(n - 1))] if n > 1 else ["s"]
        sizes = {name: rng.choice([0, 1, 5, 100, 10_000, 3]) for name in names}
        table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        order = sorted((x for x in names if x is not None)) + [x for x in names if x is None]
        want = dict(zip(order, shares([sizes[x] for x in order])))
        got = {r.source: r.target for r in mixing.targets(table).collect()}
        assert all(abs(got[x] - want[x]) < 1e-6 * max(1, want[x]) for x in names), (sizes, got, want)


def test_knapsack_is_best():
    rng = random.Random(1)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(1, 30), 4)))
        counts = np.array([rng.randint(0, 3) for _ in lengths])
        budget = rng.randint(0, 80)
        sums = {int(np.dot(lengths, c)) for c in itertools.product(*[range(n + 1) for n in counts])}
        taken = mixing.knapsack(lengths, counts, budget)
        assert (taken <= counts).all() and (taken >= 0).all()
        assert int((taken * lengths).sum()) == max(s for s in sums if s <= budget)


def test_fit_is_near():
    rng = np.random.default_rng(2)
    lengths, counts = np.unique(rng.integers(5, 3000, 4000), return_counts=True)
    size = int((lengths * counts).sum())
    for budget in (0, 1, 777, size // 3, size - 1, size, int(1.7 * size), 3 * size):
        whole, extra = mixing.fit(lengths, counts, budget, 3)
        assert whole * size + int((lengths * extra).sum()) <= budget
        assert budget - whole * size - int((lengths * extra).sum()) < 5
        assert (extra <= counts).all() and whole <= 3


def test_odd_rows_and_reruns(spark):
    extra = [(1000 + k, "w " * (k % 9 + 1), "en", "big" if k % 3 else None) for k in range(3000)]
    rows = cases.rows(extra)
    one = mixing.mix(cases.docs(spark, extra)).collect()
    two = mixing.mix(cases.docs(spark, extra).repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(key, one)) == sorted(map(key, two))
    assert len(one) == len(rows)
    assert sum(r.size for r in one) == sum(len((r[1] or "").encode().split()) for r in rows)
    for source in {r.source for r in one}:
        own = [r for r in one if r.source == source]
        assert {r.source_size for r in own} == {sum(r.size for r in own)}
        assert all(0 <= r.copies <= 3 and r.taken == r.copies * r.size for r in own)
        # "c" has one text with nearly all its words: it is taken or not
        assert source == "c" or abs(sum(r.taken for r in own) - own[0].target) <= max(3, 0.05 * own[0].target)
    assert mixing.mix(cases.none(spark)).collect() == []


def test_hot_length_is_split_over_buckets(spark):
    docs = spark.range(30_000).selectExpr("id AS doc_id", "'same size of five words' AS text", "if(id % 2 = 0, 'a', 'b') AS source")
    got = mixing.mix(docs, weights=(2, 1)).groupBy("source").sum("taken", "size").collect()
    assert {r.source: r[1] for r in got} == {"a": 100_000, "b": 50_000}
