from collections import defaultdict

import numpy as np

import cases
from fareloom.llm import line_dedup

SPACES = " \t\n\x0b\x0c\r"


def plain(rows, min_chars=20, min_docs=3):
    """(id, text) -> expected (id, kept text, lines, dropped) by looking at every line."""
    key = lambda x: x.strip(SPACES).translate({c: c + 32 for c in range(65, 91)})
    seen, keeper = defaultdict(set), {}
    order = lambda i: -1 if i is None else i
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars and i is not None:  # as COUNT(DISTINCT doc_id) has it
                seen[k].add(i)
                keeper[k] = max([keeper.get(k, i), i], key=order)
    lost = defaultdict(set)
    for i, text in rows:
        lost[i] |= {k for k in {key(x) for x in (text or "").split("\n")} if len(seen[k]) >= min_docs and keeper[k] != i}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if key(x) not in lost[i]]
        out.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=repr)


SHARED = "This line stands in many documents"


def test_odd_rows_and_repeats(spark):
    extra = [(20 + k, f"  {SHARED.upper() if k % 2 else SHARED}\t\nown line number {k} of this text\n{SHARED}\n", "en", "a") for k in range(4)]
    extra += [(None, SHARED, "en", "a"), (40, "short\nshort", "en", "a"), (41, "ééééééééééééééééééé\nab", "en", "a"),
              (42, "ééééééééééééééééééé", "en", "a"), (43, "ééééééééééééééééééé", "en", "a")]
    rows = [(r[0], r[1]) for r in cases.rows(extra)]
    for bits in (2 ** 10, 2 ** 22):  # a full filter gives the same result
        got = line_dedup.drop_repeated_lines(cases.docs(spark, extra), bits=bits, keep=["doc_id", "lang", "n_lines"])
        assert got.columns == ["doc_id", "lang", "text", "n_lines", "n_dropped"]
        assert sorted([(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()], key=repr) == plain(rows)
    assert line_dedup.drop_repeated_lines(cases.none(spark), bits=2 ** 12).collect() == []


def test_rows_with_one_id_are_one_document(spark):
    long = "a line of more than twenty characters"
    rows = [(5, long), (5, f"{long}\nx"), (6, long), (7, f"{long}, too"), (7, f"{long}, too"), (8, f"{long}, too"), (9, f"{long}, too"),
            (None, f"{long}, too"), (None, "only rows without an id hold this"), (None, "only rows without an id hold this"),
            (None, "only rows without an id hold this")]
    got = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bits=2 ** 12)
    dropped = sorted(((r.doc_id, r.n_dropped) for r in got.collect()), key=repr)
    assert dropped == sorted([(5, 0), (5, 0), (6, 0), (7, 1), (7, 1), (8, 1), (9, 0), (None, 1), (None, 0), (None, 0), (None, 0)], key=repr)
    assert sorted([(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()], key=repr) == plain(rows)


def test_table(spark, sf_dir):
    docs = cases.sample(spark, sf_dir, 200)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = line_dedup.drop_repeated_lines(docs.repartition(5), bits=2 ** 22, keep=["doc_id"]).collect()
    assert sorted([tuple(r) for r in got], key=repr) == plain(rows)


def test_no_repeat_is_missing_in_the_filter(spark):
    docs = cases.docs(spark, [(50, SHARED, "en", "a"), (51, SHARED, "en", "a")]).repartition(7)
    bits = 2 ** 12
    held = np.zeros(bits // 8, np.uint8)
    for r in line_dedup.twice_seen(docs, "text", 20, bits).collect():
        held[:] = np.frombuffer(r.bits, np.uint8)[:bits // 8]
    found = {bytes(r.key) for r in line_dedup.suspects(docs, "text", "doc_id", held, 20, bits).collect()}
    assert SHARED.lower().encode() in found and b"the quick brown fox jumps over the lazy dog" in found
