import random
import re

import numpy as np
import pytest
import xxhash

import cases
from fareloom.llm import simhash
from fareloom.llm.components import components


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k:k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - 2 ** 64 if value >= 2 ** 63 else value


def reached(ids, prints):
    """Smallest id reachable over pairs of at most two differing bits, by looking at all pairs."""
    prints, label = np.array(prints, np.int64).view(np.uint64), np.array(ids)
    near = [np.flatnonzero(np.bitwise_count(prints ^ p) <= 2) for p in prints]
    before = None
    while before is None or (before != label).any():
        before = label.copy()
        for n in near:
            label[n] = label[n].min()
    return label.tolist()


def test_fingerprints_and_odd_rows(spark):
    got = simhash.near_classes(cases.docs(spark)).collect()
    assert len(got) == len(cases.rows())
    want = sorted((r[0] is None, r[0] or 0, plain(r[1])) for r in cases.rows())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fp) for r in got) == want
    zero = {r.component_id for r in got if r.fp == 0}
    assert zero == {3}  # null, empty and blank texts are linked
    assert {r.component_id for r in got if r.doc_id == 2} == {1}
    assert all(r.component_id is not None for r in got if r.doc_id is not None)
    assert simhash.near_classes(cases.none(spark)).collect() == []


def test_very_long_text_goes_piece_by_piece():
    assert simhash.fingerprint((cases.LONG * 4).encode()) == plain(cases.LONG * 4)


@pytest.mark.parametrize("leaves", [2, 5, 2048])
def test_trie_join_equals_all_pairs(spark, leaves):
    random_ = random.Random(leaves)
    prints = set()
    for _ in range(6):  # clusters of near fingerprints, large ones among them
        centre = random_.getrandbits(64)
        for _ in range(60):
            flips = sum(1 << random_.randrange(64) for _ in range(random_.randint(0, 3)))
            prints.add((centre ^ flips) % 2 ** 64)
    prints = sorted(p - 2 ** 64 if p >= 2 ** 63 else p for p in prints)
    table = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {tuple(sorted(r)) for r in simhash.near_links(table, leaves=leaves, forest=False).collect()}
    bits = np.array(prints, np.int64).view(np.uint64)
    want = {(prints[a], prints[b]) for a in range(len(prints)) for b in range(a + 1, len(prints))
            if int(bits[a] ^ bits[b]).bit_count() <= 2}
    assert got == want
    classes = {r.id: r.root for r in components(simhash.near_links(table, leaves=leaves)).collect()}
    assert [classes.get(p, p) for p in prints] == reached(prints, prints)


def test_budget_is_limited(spark):
    with pytest.raises(ValueError):
        simhash.near_links(spark.createDataFrame([(1,)], "fp long"), budget=3)


def test_classes_of_the_table(spark, sf_dir):
    docs = cases.sample(spark, sf_dir, 200)
    rows = sorted(simhash.near_classes(docs).collect())
    assert [r.component_id for r in rows] == reached([r.doc_id for r in rows], [r.fp for r in rows])


def test_components_of_long_chains(spark):
    order = list(range(40))
    random.Random(3).shuffle(order)
    links = [(order[k], order[k + 1]) for k in range(39)] + [(100, 101), (7, 7)]
    got = dict(components(spark.createDataFrame(links, "u long, v long")).collect())
    assert got == {**dict.fromkeys(range(40), 0), 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
