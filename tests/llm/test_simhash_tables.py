import random

import numpy as np
import pytest

import cases
import corpus_pipeline
from fareloom.llm import near_copies, simhash_tables as s
from test_near_copies import edited, reached, texts


@pytest.mark.parametrize("size,shared", [(9, 8), (45, 40), (270, 240)])
def test_bits_differ_as_planned(size, shared):
    """Sets of one size and similarity 0.8, down to the least for which there are any."""
    rng, apart = np.random.default_rng(size), []
    for _ in range(300):
        hashes = rng.integers(0, 2 ** 64, 2 * size - shared, np.uint64)
        a, b = (np.frombuffer(s.wide_fingerprint(x), np.uint8) for x in (hashes[:size], hashes[-size:]))
        apart.append(np.bitwise_count(a ^ b).sum())
    mean, spread = np.mean(apart) / s.BITS, np.std(apart)
    assert abs(mean - (s.differing(0.8) - s.SMALL)) < 2 * s.SMALL
    assert spread < 1.25 * (s.BITS * mean * (1 - mean)) ** 0.5  # bits are independent


def test_plan():
    assert s.plan(0.8, 0.9999, 12)[0] > s.plan(0.9, 0.9999, 12)[0] > s.plan(1.0, 0.9999, 12)[0]
    assert 30 < s.plan(0.8, 0.9999, 12)[1] < 45
    assert s.sampled_bits(0) == 6 and s.sampled_bits(250_000) == 12


@pytest.mark.parametrize("leaves", [3, 1024])
def test_groups_hold_all_near_pairs(spark, leaves):
    own = {k: near_copies.shingle_set(t.encode()) for k, t in enumerate(texts())}
    nodes = spark.createDataFrame([(k, bytearray(s.wide_fingerprint(x))) for k, x in own.items()] + [(-1, None)], "set long, print binary")
    held = {}
    for band, member in s.groups(nodes, similarity=0.8, certain=0.9999, leaves=leaves).collect():
        held.setdefault(band, set()).add(member)
    near = {(a, b) for a in own for b in own if a < b
            and len(np.intersect1d(own[a], own[b])) >= 0.8 * len(np.union1d(own[a], own[b]))}
    assert len(near) > 40
    assert all(any({a, b} <= members for members in held.values()) for a, b in near)
    assert all(min(members) == band and len({m // 11 for m in members}) == 1 for band, members in held.items())


def held_by(spark, own, **given):
    nodes = spark.createDataFrame([(k, bytearray(s.wide_fingerprint(x))) for k, x in own.items()], "set long, print binary")
    return [tuple(r) for r in s.groups(nodes, similarity=0.8, certain=0.9999, **given).collect()]


def test_large_group_has_a_row_per_set(spark):
    """Its sets had a row for every table whose nodes cut the group another way, to be joined by group several times."""
    rng, base = random.Random(8), [f"w{k}" for k in range(400)]
    own = {k: near_copies.shingle_set(" ".join(edited(base, k % 24, rng)).encode()) for k in range(400)}
    near = {(a, b) for a in own for b in own if a < b
            and len(np.intersect1d(own[a], own[b])) >= 0.8 * len(np.union1d(own[a], own[b]))}
    rows = held_by(spark, own)
    name = {member: band for band, member in rows}
    assert len(rows) == len(name) and len(near) > 1000
    assert all(name[a] == name[b] for a, b in near)


@pytest.mark.parametrize("first", [1, 8, 10 ** 6])
def test_large_components_are_taken_apart(spark, first):
    own = {k: near_copies.shingle_set(t.encode()) for k, t in enumerate(texts())}
    near = {(a, b) for a in own for b in own if a < b
            and len(np.intersect1d(own[a], own[b])) >= 0.8 * len(np.union1d(own[a], own[b]))}
    whole, apart = held_by(spark, own, first=first), held_by(spark, own, first=first, large=3)
    assert len(whole) == len(set(whole)) <= len(own) < len(apart) == len(set(apart))
    for rows in (whole, apart):
        held = {}
        for band, member in rows:
            held.setdefault(band, set()).add(member)
        assert all(any({a, b} <= members for members in held.values()) for a, b in near)
        assert all(min(members) == band and len(members) > 1 for band, members in held.items())


def test_linked_equals_all_pairs():
    rng = np.random.default_rng(4)
    unit = np.sort(rng.integers(0, 40, 600))
    prints = rng.integers(0, 2 ** 64, (60, 2), np.uint64)[rng.integers(0, 60, 600)] ^ (np.uint64(1) << rng.integers(0, 64, (600, 2)).astype(np.uint64))
    near = (unit[:, None] == unit) & (np.bitwise_count(prints[:, None] ^ prints).sum(2) <= 3)
    want, before = np.arange(600), None
    while before is None or (want != before).any():
        before, want = want, np.where(near, want, 600).min(1)
    assert (s.linked(unit, prints, 3) == want).all() and 40 < len(set(want)) < 600


def test_linked_starts_from_classes():
    unit, prints = np.array([0, 0, 0, 0, 1, 1]), np.uint64([[0, 0], [255, 0], [1, 0], [255 << 8, 0], [0, 0], [1, 0]])
    assert s.linked(unit, prints, 1).tolist() == [0, 1, 0, 3, 4, 4]
    assert s.linked(unit, prints, 1, np.array([0, 0, 2, 2, 4, 5])).tolist() == [0, 0, 0, 0, 4, 4]


@pytest.mark.parametrize("pivots", [0, 1])
def test_classes_equal_all_pairs(spark, monkeypatch, pivots):
    monkeypatch.setattr(near_copies.near_links, "__kwdefaults__", {"pivots": pivots})
    rows = list(enumerate(texts()))
    got = dict(near_copies.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), candidates=near_copies.by_simhash).collect())
    assert [got[i] for i, _ in rows] == reached(*zip(*rows))


def test_stage_uses_simhash(spark, sf_dir, monkeypatch):
    """MinHash bands took its place."""
    def refused(*_):
        raise AssertionError("MinHash")

    monkeypatch.setattr(near_copies, "signature", refused)
    base = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(edited(base, 3, random.Random(k))), "en", "a", 1) for k in range(8)] + [(9, "on its own", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()}
    assert kept == set(reached([r[0] for r in rows], [r[1] for r in rows])) and len(kept) < 9


def test_odd_rows(spark):
    got = near_copies.near_classes(cases.docs(spark), candidates=near_copies.by_simhash).collect()
    want = near_copies.near_classes(cases.docs(spark)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == len(cases.rows())
    assert near_copies.near_classes(cases.none(spark), candidates=near_copies.by_simhash).collect() == []
