import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import cases
from fareloom.llm import toxicity

LABELS = "doc_id long, quality int, toxic int, text string"


def examples(n=300):
    """Texts of invented words; toxic ones hold words of their own."""
    rng = np.random.default_rng(4)
    out = []
    for k in range(n):
        words = [f"w{rng.integers(60)}" for _ in range(rng.integers(3, 60))]
        if k % 4 == 0:
            words[1:1] = [f"bad{rng.integers(5)}" for _ in range(rng.integers(1, 4))]
        out.append((f"{k:04d}", float(k % 4 == 0), dict(Counter(words))))
    return out


def test_nearest_equals_all_cosines():
    model = toxicity.Model(examples(), k=7)
    vectors = np.zeros((len(model.names), len(model.place)))
    counts = {e[0]: e[2] for e in examples()}
    for n, name in enumerate(model.names):
        at, value = model._vector(counts[name])
        vectors[n, at] = value
    assert len(model.names) > 128  # several blocks
    for name, _, own in examples(80):
        at, value = model._vector(own)
        query = np.zeros(len(model.place))
        query[at] = value
        cosine = np.round(vectors @ query, 12)
        order = [i for i in np.lexsort((np.arange(len(cosine)), -cosine)) if cosine[i] > 0][:7]
        best, score = model.nearest(at, value)
        assert best.tolist() == order
        assert np.allclose(score, cosine[order])


def test_scores_are_monotone_and_bounded():
    model = toxicity.Model(examples())
    at, share = model.steps
    assert (np.diff(at) >= 0).all() and (np.diff(share) >= 0).all()
    bad, _ = model.score({"bad1": 2, "w3": 1})
    good, _ = model.score({"w3": 2, "w5": 1})
    empty, near = model.score({})
    assert 0 <= good < 0.5 < bad <= 1 and 0 <= empty < 0.5 and near == []


def test_few_or_no_examples():
    assert toxicity.Model([]).score({"a": 1}) == (0.0, [])
    for only in ([("1", 1.0, {"a": 1})], [("1", 0.0, {}), ("2", 1.0, {"b": 2})], [("1", math.nan and 0.0, {"a": 1})] * 3):
        value, _ = toxicity.Model(only).score({"a": 1})
        assert 0 <= value <= 1


def test_odd_rows(spark):
    labels = [(i, None, t, "x") for i, t in [(1, 1), (2, 0), (3, None), (4, 0), (None, 1), (6, 0), (6, 1), (7, 0), (8, 0), (99, 1)]]
    given = spark.createDataFrame(labels, LABELS)
    model = toxicity.learn(cases.docs(spark), given)
    got = toxicity.score(cases.docs(spark), model)
    assert [c for c in got.columns if c == "score"] == ["score"]
    rows = got.collect()
    assert len(rows) == len(cases.rows())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    same = {r.score for r in rows if r.doc_id in (1, 2)}
    assert len(same) == 1  # equal texts
    none = toxicity.learn(cases.none(spark), given.limit(0))
    assert {r.score for r in toxicity.score(cases.docs(spark), none).collect()} == {0.0}
    assert toxicity.score(cases.none(spark), model).collect() == []


def test_held_out_rows_teach_nothing(spark):
    ids = list(range(200))
    docs = spark.createDataFrame([(i, f"word{i % 7} idiot" if i % 3 == 0 else f"word{i % 7}") for i in ids], "doc_id long, text string")
    out = [i for i in ids if zlib.crc32(str(i).encode()) % 5 == 0]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in ids], "doc_id long, toxic int")
    wrong = labels.withColumn("toxic", F.when(F.col("doc_id").isin(out), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    marked = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).filter("h").collect()
    assert sorted(r.doc_id for r in marked) == out
    scores = [sorted(toxicity.score(docs, toxicity.learn(docs, x), keep=["doc_id"]).select("doc_id", "score").collect()) for x in (labels, wrong)]
    assert scores[0] == scores[1]
    assert all((r.score >= 0.5) == (r.doc_id % 3 == 0) for r in scores[0])


def test_held_out_accuracy(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scored = toxicity.score(docs, toxicity.learn(docs, labels), keep=["doc_id"]).join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id")))
    right, n = scored.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")), F.count("*")).first()
    assert n > 50 and right >= 0.93


def test_every_term_of_the_examples_counts():
    """Words that say little about the label still make neighbours; they were dropped below two standard errors."""
    model = toxicity.Model(examples())
    assert set(model.place) == {w for e in examples() for w in e[2]} and model.factor.min() > 0
    for name, _, own in examples():
        assert len(model.score(own)[1]) == toxicity.K
    one = toxicity.Model([(str(k), 1.0, {f"w{k % 3}": 1}) for k in range(6)])  # no deviation at all
    assert sorted(x[0] for x in one.score({"w1": 1})[1]) == ["1", "4"]


def test_the_share_read_first_changes_nothing(monkeypatch):
    found = []
    for rest in (0.0, 0.1, 0.9):
        monkeypatch.setattr(toxicity, "REST", rest)
        model = toxicity.Model(examples())
        found.append([model.nearest(*model._vector(e[2]), skip=n % 9) for n, e in enumerate(examples())])
    for one in found[1:]:
        for (a, x), (b, y) in zip(found[0], one):
            assert a.tolist() == b.tolist() and np.allclose(x, y)


def test_blocks_are_pruned(spark, sf_dir):
    """On sf0.1 most examples are never scored: their blocks' bounds stay below the k-th neighbour."""
    folder = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.learn(docs, labels)
    model.scored = [0, 0]
    for r in docs.filter("doc_id % 20 = 0").select("text").collect():
        model.score(toxicity.terms((r.text or "").encode()))
    assert model.scored[0] <= 0.15 * model.scored[1]
