"""Every stage against a brute-force version of it on its own input."""
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import cases
import corpus_pipeline
from fareloom.llm import decontamination, near_copies, toxicity
from test_decontamination import plain as contaminated
from test_near_copies import reached


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Input and output rows of every stage, over the smallest table with planted odd rows."""
    docs = cases.sample(spark, sf_dir, 200)
    odd = spark.createDataFrame([
        (None, None, None, None, None), (5000, "", "en", "src0", 0), (5001, "a copy of some text to keep", "en", None, 27),
        (5002, "A copy of some text to keep", "en", "src1", 27), (None, "no id here", "en", "src1", 10), (None, "no id there", "en", "src1", 11),
        (5003, "twice the same row", "en", "src2", 18), (5003, "twice the same row", "en", "src2", 18), (5004, "x " * 30_000, "en", "src3", 60_000),
    ], docs.schema)
    docs, out = docs.union(odd), {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf_dir)
        made = spark.createDataFrame(made.collect(), made.schema)
        out[name] = (docs.collect(), made.collect(), docs.columns, made.columns)
        docs = made
    return out


def key(r):
    return r.doc_id, r.text


def test_columns(stages):
    for name, (_, _, before, after) in list(stages.items())[:-1]:
        assert before == after == ["doc_id", "text", "lang", "source", "n_chars"], name


def test_toxicity(spark, sf_dir, stages):
    before, after, *_ = stages["toxicity"]
    docs = spark.createDataFrame(before, cases.sample(spark, sf_dir).schema)
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = Counter(key(r) for r in before if model.score(toxicity.terms((r.text or "").encode() or None))[0] < 0.5)
    assert Counter(map(key, after)) == want
    assert len(after) > 0.7 * len(before)


def test_near_dedup(stages):
    before, after, *_ = stages["simhash_near_dedup"]
    unique = list(dict.fromkeys(map(key, before)))
    order = sorted(range(len(unique)), key=lambda k: (unique[k][0] is not None, unique[k][0] or 0))
    label = reached(list(range(len(unique))), [unique[k][1] for k in order])  # five words, similarity 0.8, all pairs
    groups = {}
    for place, k in zip(label, order):
        groups.setdefault(place, []).append(unique[k])
    kept = Counter(map(key, after))
    assert len(kept) == len(groups) and set(kept.values()) == {1}
    for members in groups.values():
        stays = [m for m in members if m in kept]
        assert len(stays) == 1
        known = [m[0] for m in members if m[0] is not None]
        assert None in [m[0] for m in members] or stays[0][0] == min(known)


def test_decontamination(spark, sf_dir, stages):
    before, after, *_ = stages["benchmark_decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    grams = {" ".join(w[k:k + 10]) for _, t in items for w in [split(t)] for k in range(len(w) - 9)}
    want = Counter(key(r) for r in before if not any(" ".join(w[k:k + 10]) in grams for w in [split(r.text)] for k in range(len(w) - 9)))
    assert Counter(map(key, after)) == want
    gone = set(map(key, before)) - set(map(key, after))
    assert gone and all(contaminated(text, items)[1] > 0 for _, text in list(gone)[:3])


def split(text):
    from test_decontamination import split as words
    return words(text)


def test_mixing(stages):
    before, after, *_ = stages["source_mixing"]
    size = lambda r: len((r.text or "").encode().split())
    copies, given = Counter(map(key, after)), Counter(map(key, before))
    assert set(copies) <= set(given) and max(copies.values()) <= 3
    total = sum(map(size, before))
    assert abs(sum(map(size, after)) - total) < 0.1 * total


def test_tokens(stages):
    before, after, *_ = stages["token_records"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [(r.doc_id, [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in before]
    want = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in after) == want
    start = 0
    for r in sorted(after, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    known = [r.doc_id for r in sorted(after, key=lambda r: r.start) if r.doc_id is not None]
    assert known == sorted(known)


def test_empty_documents(spark, sf_dir):
    docs = cases.sample(spark, sf_dir).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.collect() == []


def test_extra_columns_survive(spark, sf_dir):
    docs = cases.docs(spark)
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == cases.docs(spark).columns, name
    assert {r.score for r in docs.select("score").collect()} <= {"s"}


def test_text_goes_to_workers_once(spark, sf_dir):
    """A batch holds a text within its row, not beside it too, which doubled what workers and executors hold."""
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_contaminated):
        plan = stage(spark, cases.docs(spark), sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        sent = [line for line in plan.splitlines() if "MapInArrow" in line]
        assert len(sent) == 1 and re.search(r"run\(row#\d+\)", sent[0]), sent


@pytest.mark.parametrize("parts", [1, 4])
def test_text_by_path(spark, parts):
    docs = cases.docs(spark, [(20, "x ONE two three four five six seven eight nine ten y", "en", "a")])
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "lazy dog")], "item_id long, text string")
    held = docs.select("doc_id", "source", F.struct("n_chars", F.col("text").alias("Text")).alias("_doc"), F.lit("no").alias("text"))
    size = 1_000_000 if parts == 1 else 20
    find = lambda rows, **given: Counter(map(repr, decontamination.find_passages(rows, items, keep=["doc_id"], max_item_chars=size, **given).collect()))
    want = find(docs)
    keep_doc = decontamination.find_passages(held, items, text=("_doc", "text"), keep=["doc_id", "_doc"], max_item_chars=size).drop("_doc")
    assert Counter(map(repr, keep_doc.collect())) == want and len(want) > 5
    assert find(held, text=("_doc", "text")) == want  # the struct itself is not kept, so the text goes beside the row


def test_simhash_links_count_in_near_dedup(spark, sf_dir):
    """Documents that the SimHash operator links are near copies, though few of their five-word shingles are shared; both
    kinds of links make one class."""
    body = "one two three four five six seven eight nine " * 100
    tail = [" ".join(f"w{k}x{i}" for i in range(25)) for k in range(2)]
    close = " ".join(f"v{i}" for i in range(60))
    texts = [(1, body + tail[0]), (2, body + tail[1]), (3, body + tail[1] + " more"), (4, close), (5, close + " end"), (None, "alone " + close[:40])]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in texts], cases.sample(spark, sf_dir).schema)
    alike = near_copies.near_classes(docs.select("doc_id", "text"), candidates=near_copies.by_simhash).collect()
    assert {r.doc_id: r.component_id for r in alike}[2] == 2  # by similarity alone it is another class than document 1
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 4]
