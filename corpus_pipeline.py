"""Corpus preparation: each stage calls one operator and hands its result on as a Parquet table.

1. Toxicity: documents scored as toxic go.
2. Near-dedup: of each class of near copies the document with the smallest id stays. Near copies are linked by the SimHash
   operator (fingerprints within two bits) or have a 5-word Jaccard similarity of 0.8 or more; candidates for the latter are
   wider SimHash fingerprints within a budget of differing bits, confirmed by the exact similarity.
3. Benchmark decontamination: documents that hold a window of a benchmark item go.
4. Mixing: documents are dropped or repeated so that sources meet their target weights.
5. Token ids: what is left is tokenised and written as binary records; the result is the index of the records.

Stages identify a document by its id and a hash of its text, so documents without an id, and different texts with one id,
are told apart; rows that repeat both are one document. Columns beyond those of `documents` pass through stages 1 to 4.
"""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from fareloom.llm import decontamination, mixing, near_copies, simhash, token_records, toxicity
from fareloom.llm.common import table
from fareloom.session import fresh_path, materialise

# Where `_wrapped` holds the text; by this path it goes to Python workers once, not beside the document too.
TEXT = ("_doc", "text")
# Words that a process remembers: it comes from the stages before with less memory left than one that only tokenises.
REMEMBERED = 100_000
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _wrapped(docs: DataFrame) -> DataFrame:
    """The whole document as `_doc`, what the operators read beside it, and the document's key."""
    key = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(whole.alias("_doc"), key.alias("_key"), "text", "source")


def _chosen(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """`_doc` of one row per document that is decided on (column _key, unique), with the decision's other columns."""
    met = _wrapped(docs).select("_doc", "_key").join(decided, "_key")
    return met.withColumn("_nth", F.row_number().over(W.partitionBy("_key").orderBy("_key"))).filter("_nth = 1")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(_wrapped(docs), model, text=TEXT, keep=["_doc"]).filter("predicted = 0").select("_doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = _wrapped(docs).select("_key", "text")
    linked = simhash.near_classes(own, doc_id="_key")
    classes = near_copies.near_classes(own, doc_id="_key", candidates=near_copies.by_simhash, united=linked)
    return _chosen(docs, classes.filter("_key = component_id").select("_key").distinct()).select("_doc.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    found = decontamination.find_passages(_wrapped(docs), items, text=TEXT, keep=["_doc"])
    return found.filter(F.size("hits") == 0).select("_doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_wrapped(docs), doc_id="_key").filter("copies > 0")
    copies = mixed.groupBy("_key").agg(F.sum("copies").cast("int").alias("_copies"))
    return _chosen(docs, copies).select("_doc", F.explode(F.array_repeat(F.lit(1), F.col("_copies")))).select("_doc.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    token_records.write_records(docs, path, TOKENIZER, remembered=REMEMBERED)
    return token_records.write_index(spark, path).select(
        F.col("id").cast("long").alias("doc_id"), "start", "n_tokens", "ids_crc32")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_records", write_tokens),
]

# Fingerprints, nearest examples and subset sums are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
