import hashlib
import random

import xxhash
from pyspark.sql import functions as F

import cases
from fareloom.llm import queries, sketches


def test_edits_and_neighbours(spark, sf_dir):
    rows = cases.sample(spark, sf_dir).collect()
    texts = [r.text or "" for r in sorted(rows)]
    got = sketches.compare_edits(spark.createDataFrame(rows)).orderBy("doc_id").withColumn(
        "sha", F.sha2("edited", 256)).collect()
    assert len(got) == len(texts)
    for k, r in enumerate(got):
        cut = len(texts[k]) // 4
        edited = texts[k][:len(texts[k]) - cut] + texts[(k + 1) % len(texts)][:cut]
        assert (r.n_chars, r.sha) == (len(texts[k]), hashlib.sha256(edited.encode()).hexdigest())


def test_odd_rows(spark):
    got = sketches.compare_edits(cases.docs(spark)).select(
        "doc_id", "n_chars", "sketch", "edited", sketches.containment(F.col("sketch"), F.col("edited_sketch")).alias("near")).collect()
    assert len(got) == len(cases.rows())
    assert all(0 <= r.near <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].sketch == by_id[2].sketch and len(by_id[1].sketch) >= 1
    assert by_id[3].n_chars == 0 and by_id[3].sketch == [] and by_id[3].near == 1.0
    assert sketches.compare_edits(cases.none(spark)).collect() == []
    one = sketches.compare_edits(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert one.edited == "abcdefab"


def test_estimate_of_containment_between_unequal_texts(spark):
    words = [f"w{k}" for k in range(4000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:800])), (3, " ".join(words[400:1200])), (4, " ".join(words[2000:]))]
    df = sketches.with_sketch(spark.createDataFrame(rows, "doc_id long, text string"), "text", "s")
    s = {r.doc_id: r.s for r in df.collect()}
    pair = spark.createDataFrame([(s[1], s[2], s[3], s[4])], "a array<long>, b array<long>, c array<long>, d array<long>")
    r = pair.select(sketches.containment(F.col("a"), F.col("b")).alias("in_all"), sketches.containment(F.col("b"), F.col("c")).alias("half"),
                    F.size(sketches.merged(F.col("b"), F.col("d"))).alias("n")).first()
    assert r.in_all == 1.0 and abs(r.half - 0.5) < 0.15
    assert r.n == len(set(s[2]) | set(s[4]))
    assert abs(len(s[1]) / 3996 - sketches.FRACTION) < 0.03


def retained(text):
    """Sketch by its definition: hashes chained over the words of each shingle, those below the threshold, else the least."""
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode()
    words = lower.split()
    runs = [words[k:k + 5] for k in range(len(words) - 4)] if len(words) >= 5 else [[b" ".join(words)]] if words else []
    hashes = set()
    for run in runs:
        h = 42
        for w in run:
            h = xxhash.xxh64_intdigest(w, h)
        hashes.add(h - 2 ** 64 if h >= 2 ** 63 else h)
    low = sorted(h for h in hashes if h < -2 ** 63 + 2 ** 61)
    return low or sorted(hashes)[:1]


def alike(a, b):
    least = min(len(a), len(b))
    return len(set(a) & set(b)) / least if least else float(len(a) == len(b))


def as_hex(sketch):
    return "".join(f"{h % 2 ** 64:016x}" for h in sketch)


def test_registered_query_against_the_definition(spark, sf_dir):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    got = queries.op2_fingerprints(spark, sf_dir).orderBy("doc_id").collect()
    assert len(got) == len(texts)
    for k, r in enumerate(got):
        after, cut = texts[(k + 1) % len(texts)], len(texts[k]) // 4
        own, edited, near = (retained(t) for t in (texts[k], texts[k][:len(texts[k]) - cut] + after[:cut], after))
        assert (r.fingerprint, r.edited_fingerprint) == (as_hex(own), as_hex(edited))
        assert abs(r.near_edited - alike(own, edited)) < 1e-9 and abs(r.near_next - alike(own, near)) < 1e-9


def test_merged_is_the_sketch_of_the_united_text(spark):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n)) for n in (5, 5, 6, 7, 5, 40, 5, 5, 300, 5)]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(texts, texts[1:]))], "k long, a string, b string")
    both = sketches.with_sketch(sketches.with_sketch(rows, "a", "x"), "b", "y").withColumn("m", sketches.merged(F.col("x"), F.col("y")))
    for r in both.collect():
        united = sorted(set(retained(r.a)) | set(retained(r.b)))
        low = [h for h in united if h < -2 ** 63 + 2 ** 61]
        assert r.m == (low or united[:1])
    none = both.select(sketches.merged(F.slice("x", 1, 0), F.slice("y", 1, 0)).alias("m")).first()
    assert none.m == []


def test_only_built_in_functions(spark):
    plan = sketches.compare_edits(cases.docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
