"""One query per operator of this package, over whole tables, with production parameters."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fareloom.llm import (
    centroids, decontamination, licenses, line_dedup, merkle, mixing, simhash, sketches, substring_dedup, token_records, toxicity,
    url_lists, warc,
)
from fareloom.llm.common import lower_ascii, table
from fareloom.session import fresh_path, materialise

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", simhash.as_hex().alias("fingerprint"), "component_id")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = sketches.compare_edits(table(spark, sf_dir, "documents"))
    return pairs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        sketches.as_text(F.col("sketch")).alias("fingerprint"),
        sketches.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        sketches.containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        sketches.containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"))


def dated_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with a fetch time in 2024, which the tables lack, from a hash of the id."""
    second = F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 8), 16, 10).cast("long") % (366 * 86400)
    return table(spark, sf_dir, "pages").select(
        "page_id", "url", F.timestamp_seconds(F.lit(1704067200) + second).alias("fetched"))


def dated_entries(captures: DataFrame) -> DataFrame:
    """Lists with three dated entries for every host, its domain and every address: which list, kind, action and day
    come from hashes."""
    host = url_lists.host_of(F.col("url"))
    site = F.regexp_replace(host, r"^(www|m|blog)\.", "")
    seen = captures.select(F.explode(F.array(
        F.struct(F.lit("domain").alias("kind"), site.alias("pattern")), F.struct(F.lit("host").alias("kind"), host.alias("pattern")),
        F.struct(F.lit("url").alias("kind"), F.col("url").alias("pattern")))).alias("x")).select("x.*").filter(
        F.col("pattern") != "").distinct()
    turn = seen.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn(
        "d", F.md5(F.concat_ws("|", "kind", "pattern", F.col("k").cast("string"))))

    def digit(low: int, n: int):
        return F.conv(F.substring("d", low, n), 16, 10).cast("long")

    return turn.select(
        F.concat(F.lit("list"), (digit(1, 2) % 3).cast("string")).alias("list"), "kind", "pattern",
        F.when(digit(3, 2) % 2 == 0, "add").otherwise("remove").alias("action"),
        F.timestamp_seconds(F.lit(1704067200) + digit(5, 4) % 366 * 86400).alias("at"))


def op3_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = dated_captures(spark, sf_dir)
    marked = url_lists.evaluate(captures, dated_entries(captures))
    return marked.select("page_id", "n_entries", F.array_join("lists", ",").alias("lists"), "listed")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.records(warc.read_archives(spark, path, payload=False)).select(
        F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_passages(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return decontamination.contamination(found, ["doc_id"])


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    token_records.write_records(table(spark, sf_dir, "documents"), path, TOKENIZER)
    index = token_records.write_index(spark, path)
    return index.select(F.col("id").cast("long").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    names = F.transform("found", lambda x: x["license"])
    return found.select(
        "doc_id", F.size("found").cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["contained"])), F.lit(0.0)).alias("contained"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = substring_dedup.parse(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return parsed.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merkle.manifest(
        table(spark, sf_dir, "documents"), fields=["doc_id", "source", "lang", "n_chars", "text"], group="lang", doc_id="doc_id",
        tampered=F.crc32(F.col("doc_id").cast("string")) % 3 == 0, change="text", to=lower_ascii(F.col("text")))
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("siblings")).alias("proof_sha256"),
                       F.col("folded").alias("folded_root"), "verified")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, final = centroids.cluster(table(spark, sf_dir, "embeddings"))
    found = materialise(found, "assigned")
    own = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    inertia = found.agg(F.sum("distance")).first()[0]
    names = spark.createDataFrame([(k, ",".join(map(str, c))) for k, c in enumerate(final.tolist())], "cluster int, parts string")
    named = names.join(own, "cluster").select("cluster", "cluster_inertia", F.sha2("parts", 256).alias("centroid_sha256"))
    return found.join(F.broadcast(named), "cluster").select(  # one row per centroid
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", F.lit(inertia).cast("long").alias("inertia"),
        "centroid_sha256")


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_fingerprints": op2_fingerprints,
    "op3_url_lists": op3_url_lists,
    "op4_warc": op4_warc,
    "op5_line_dedup": op5_line_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_decontamination": op7_decontamination,
    "op8_token_records": op8_token_records,
    "op9_licenses": op9_licenses,
    "op10_mixing": op10_mixing,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_merkle": op12_merkle,
    "op13_centroids": op13_centroids,
}
