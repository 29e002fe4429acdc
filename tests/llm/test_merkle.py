import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

import cases
from fareloom.llm import merkle
from fareloom.llm.common import lower_ascii, table

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*map(part, (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k:k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def siblings(tree, k):
    """(left, right) per level."""
    out = []
    for level in tree[:-1]:
        low = k // 8 * 8
        out.append(("".join(level[low:k]), "".join(level[k + 1:low + 8])))
        k //= 8
    return out


def plain(rows):
    groups, out = {}, []
    for r in rows:
        lower = None if r["text"] is None else r["text"].translate({c: c + 32 for c in range(65, 91)})
        own = leaf(r, r["text"])
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, own, leaf(r, lower) if hit else own))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g])]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    for i, g in enumerate(names):
        for k, (known, doc, own, found) in enumerate(sorted(groups[g])):
            path = siblings(trees[g], k) + siblings(top, i)
            at = found
            for left, right in path:
                at = h(left, at, right)
            out.append((doc if known else None, own, trees[g][-1][0], top[-1][0], h(*[x for p in path for x in p]), at, at == top[-1][0]))
    return sorted(out, key=repr)


def made(docs):
    rows = merkle.manifest(docs, fields=FIELDS, group="lang", doc_id="doc_id", change="text", to=lower_ascii(F.col("text")),
                           tampered=F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
    rows = rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("siblings")), "folded", "verified")
    return sorted(map(tuple, rows.collect()), key=repr)


def test_odd_rows(spark):
    docs = cases.docs(spark, [(3, "Other Text", "", "x"), (60, "Alone", "zz", None)])
    assert made(docs) == plain([r.asDict() for r in docs.collect()])
    assert made(cases.none(spark)) == []


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 512, 513, 1100])
def test_tree_shapes(spark, n):
    rows = [(i, f"Text {i}", "en" if i else None, "s", i) for i in range(n + 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert made(docs) == plain([r.asDict() for r in docs.collect()])


def test_many_groups(spark):
    rows = [(i, f"Text {i}", f"l{i % 150}", "s", i) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert made(docs) == plain([r.asDict() for r in docs.collect()])


def test_small_blocks_need_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DEPTH", 1)
    monkeypatch.setattr(merkle, "_BLOCK", 8)
    rows = [(i % 200, f"Text {i}", "en" if i % 7 else "de", "s", i) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    assert made(docs) == plain([r.asDict() for r in docs.collect()])


def test_whole_table_and_changed_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = made(docs)
    assert rows == plain([r.asDict() for r in docs.collect()])
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for doc, *_, verified in rows:
        changed = zlib.crc32(str(doc).encode()) % 3 == 0 and texts[doc] != texts[doc].translate({c: c + 32 for c in range(65, 91)})
        assert verified is not changed
