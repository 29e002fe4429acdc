import random

import numpy as np
import pytest

import cases
from fareloom.llm import queries, substring_dedup as sub


def plain(rows, size):
    """(id, text) -> expected (id, kept text, words, removed) by comparing every window with every smaller id."""
    order = lambda i: (i is not None, i or 0)
    split = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in split:
        for k in range(len(w) - size + 1):
            key = tuple(w[k:k + size])
            least[key] = min(least.get(key, order(i)), order(i))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - size + 1):
            if least[tuple(w[k:k + size])] < order(i):
                gone |= set(range(k, k + size))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, b" ".join(kept).decode(), len(w), len(w) - len(kept)))
    return sorted(out, key=repr)


def made_up(n=60, seed=3):
    """Texts of a few words, so that windows of three repeat everywhere, with passages of several lengths in common."""
    rng = random.Random(seed)
    shared = [" ".join(rng.choice("abcdefgh") for _ in range(k)) for k in (3, 4, 7, 20, 60)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 12))) for _ in range(3)]
        rows.append((rng.choice([i, i, i, 5, None]), f"{parts[0]} {rng.choice(shared)}\n{parts[1]}\t{rng.choice(shared)} {parts[2]}"))
    return rows


@pytest.mark.parametrize("blocks", [200, 1_500, 10 ** 7])
def test_against_every_window(spark, blocks):
    rows = made_up()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sub.parse(docs, size=3, block_bytes=blocks, range_bytes=blocks)
    assert got.columns == ["doc_id", "text", "n_words", "n_removed", "spans"]
    assert sorted([(r.doc_id, r.text, r.n_words, r.n_removed) for r in got.collect()], key=repr) == plain(rows, 3)


def test_odd_rows_and_clashing_names(spark):
    extra = [(50 + k, cases.LONG, "en", "a") for k in range(3)]
    for size, blocks in ((13, 10 ** 7), (2, 500)):
        got = sub.parse(cases.docs(spark, extra), size=size, block_bytes=blocks, range_bytes=100_000)
        assert got.columns == [c for c in cases.docs(spark).columns if c != "text"] + ["text", "n_words", "n_removed", "spans"]
        rows = [(r[0], r[1]) for r in cases.rows(extra)]
        assert sorted([(r.doc_id, r.text, r.n_words, r.n_removed) for r in got.collect()], key=repr) == plain(rows, size)
        assert {r.made for r in got.select("made").collect()} == {7}
    assert sub.parse(cases.none(spark)).collect() == []


def test_spans_are_copies(spark):
    docs = cases.docs(spark, [(50, "Before it: the quick brown fox jumps over the lazy dog now", "en", "a"),
                              (51, "x The quick brown fox jumps over the lazy dog y z", "en", "a")])
    spans = {r.doc_id: [(s.start, s.length) for s in r.spans] for r in sub.parse(docs, size=5).collect() if r.doc_id in (1, 2, 50, 51)}
    assert spans == {1: [], 2: [(0, 9)], 50: [(3, 8)], 51: [(1, 9)]}


def test_a_shared_window_is_one_entry_per_block(spark):
    """A third of all rows with one passage: what reaches a hash range grows with blocks, not with rows."""
    passage = " ".join(f"w{k}" for k in range(20))
    rows = [(i, f"{passage} own{i}" if i % 3 == 0 else f"own{i} only") for i in range(3000)]
    got = sub.parse(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=40_000, range_bytes=30_000)
    kept = {r.doc_id: r.text for r in got.collect()}
    assert kept[0] == f"{passage} own0" and all(kept[i] == f"own{i}" for i in range(3, 3000, 3))


def test_factors_cover_windows_that_cross_a_boundary():
    found = np.array([1, 1, 0, 1, 0, 0, 1, 1], bool)
    source = np.array([1, 1, 0, 2, 0, 0, 3, 4])
    spans = sub.factors(found, source, 4)
    assert spans == [(0, 5, 1), (3, 4, 2), (6, 4, 3), (7, 4, 4)]
    assert sub.covered(spans, 12).tolist() == [True] * 11 + [False]
    values = np.array([5, 2 ** 63 + 1, 77], np.uint64)
    assert (sub.unpacked(sub.packed(values), np.uint64) == values).all()


def test_registered_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {(i, n, gone) for i, _, n, gone in plain([(r.doc_id, r.text) for r in docs.collect()], 13)}
    assert {tuple(r)[:3] for r in queries.op11_substring_dedup(spark, sf_dir).collect()} == want
