import random

import numpy as np
import pytest

import cases
import corpus_pipeline
from fareloom.llm import near_copies


def plain(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def reached(ids, texts):
    """Smallest id reachable over pairs of at least 0.8, by looking at all pairs."""
    sets, label, before = [plain(t) for t in texts], list(ids), None
    near = [[j for j, b in enumerate(sets) if jaccard(a, b) >= 0.8] for a in sets]
    while before != label:
        before = label[:]
        for n in near:
            least = min(label[j] for j in n)
            for j in n:
                label[j] = least
    return label


def edited(words, n, rng):
    """The words with n of them replaced, far from each other."""
    own = list(words)
    for k in rng.sample(range(0, len(own), 8), n):
        own[k] = f"new{rng.randrange(10 ** 9)}"
    return own


def texts():
    rng = random.Random(3)
    out = []
    for group in range(6):
        base = [f"g{group}w{rng.randrange(10 ** 6)}" for _ in range(300)]
        out += [" ".join(edited(base, n, rng)) for n in (0, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9)]
    return out


@pytest.mark.parametrize("pivots", [0, 1, 3])
def test_classes_equal_all_pairs(spark, monkeypatch, pivots):
    monkeypatch.setattr(near_copies.near_links, "__kwdefaults__", {"pivots": pivots})
    rows = list(enumerate(texts()))
    got = dict(near_copies.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = reached(*zip(*rows))
    assert [got[i] for i, _ in rows] == want
    assert 6 < len(set(want)) < len(want)


@pytest.mark.parametrize("block", [2, 5])
def test_buckets_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies.near_links, "__kwdefaults__", {"pivots": 0})
    monkeypatch.setattr(near_copies.block_links, "__defaults__", (block,))
    rows = list(enumerate(texts()))
    got = dict(near_copies.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [got[i] for i, _ in rows] == reached(*zip(*rows))


def test_bands_meet_at_the_bound():
    """Share of bands in which two sets of similarity 0.8 collide, as the number of bands supposes."""
    rng, n = np.random.default_rng(5), near_copies.bands()
    assert 1 - (1 - 0.8 ** near_copies.ROWS) ** n >= near_copies.CERTAIN
    met = []
    for _ in range(400):
        hashes = rng.integers(0, 2 ** 64, 300, np.uint64)
        a, b = (near_copies.signature(np.sort(x), n) for x in (hashes[:270], hashes[30:]))  # 240 of 300 shared
        met.append(sum(x == y for x, y in zip(a, b)))
    assert abs(np.mean(met) / n - 0.8 ** near_copies.ROWS) < 0.03 and min(met) > 0


def test_stage_drops_copies_at_similarity_08(spark, sf_dir):
    """SimHash with three words and two bits kept nearly all of these."""
    base = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(edited(base, 7, random.Random(k))), "en", "a", 1) for k in range(12)]
    rows += [(50 + k, " ".join(base[k:] + [f"v{k}x{j}" for j in range(k)]), "en", "a", 1) for k in (0, 120, 240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()}
    label = reached([r[0] for r in rows], [r[1] for r in rows])
    assert kept == set(label) and len(kept) < 6


def test_odd_rows(spark):
    got = near_copies.near_classes(cases.docs(spark)).collect()
    assert len(got) == len(cases.rows())
    assert {r.component_id for r in got if r.doc_id == 2} == {1}
    assert all(r.component_id is not None for r in got if r.doc_id is not None)
    assert near_copies.near_classes(cases.none(spark)).collect() == []
