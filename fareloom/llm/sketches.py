"""Document fingerprints as threshold-scaled sketches: every shingle hash below a fixed fraction is retained.

The threshold is the same for all texts, so sketches of any two texts compare whatever their lengths, and the sketch of
a union is the union of sketches. The share of the smaller sketch that the other one holds estimates containment. A text
none of whose hashes is below the threshold retains its least one, so only texts without words have an empty sketch.

All of it is built-in functions. Neighbours in id order come from a sort of ids alone; texts are shuffled by id.

Defined results: a null text is empty; two empty sketches are alike (1), an empty one and another are not (0); ids go in
ascending order, null first; rows with one id follow each other in order of a text hash and share the next larger id's
first row as their next document (a single id is its own); an empty table has an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fareloom.llm.common import lower_ascii, shingle_hashes, words
from fareloom.session import materialise

# Retained share of all hashes, and words per shingle.
FRACTION, SHINGLE = 1 / 8, 5


def _limit(fraction: float) -> int:
    return int(-2 ** 63 + fraction * 2 ** 64) if fraction < 1 else 2 ** 63 - 1


def with_sketch(df: DataFrame, text: str, name: str, *, fraction: float = FRACTION, shingle: int = SHINGLE) -> DataFrame:
    """`df` with `name`, the sorted array of the distinct retained hashes of the text column."""
    limit = _limit(fraction)
    hashed = df.withColumn("_w", words(lower_ascii(F.col(text)))).withColumn("_h", shingle_hashes(F.col("_w"), shingle))
    kept = hashed.withColumn("_k", F.filter("_h", lambda h: h < F.lit(limit)))
    least = F.when(F.size("_h") > 0, F.array(F.array_min("_h"))).otherwise(F.col("_h"))
    sketch = F.when(F.size("_k") > 0, F.sort_array(F.array_distinct("_k"))).otherwise(least)
    return kept.withColumn(name, sketch).drop("_w", "_h", "_k")


def merged(a: Column, b: Column, *, fraction: float = FRACTION) -> Column:
    """Sketch of two texts taken together: the least hash that a short text retained goes if others are below the
    threshold; if none is, the least of both stays."""
    both = F.array_union(a, b)
    below = F.filter(both, lambda h: h < F.lit(_limit(fraction)))
    return F.when(F.size(below) > 0, F.sort_array(below)).otherwise(F.slice(F.sort_array(both), 1, 1))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller text's shingles that the other holds, 0 to 1."""
    least = F.least(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b)) / least
    return F.when(least > 0, shared).when(F.size(a) == F.size(b), F.lit(1.0)).otherwise(F.lit(0.0))


def as_text(sketch: Column) -> Column:
    """A sketch as hex digits, 16 per hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def previous_keys(docs: DataFrame) -> DataFrame:
    """For every distinct `k`: `before`, a struct of the key before it (for the first: the last key) and that key's text
    length (the largest, if it has several rows).

    Keys are range-partitioned, each partition looks back within itself, and the partitions' last keys (one row per
    partition) close the gaps between them.
    """
    keys = docs.groupBy("k").agg(F.max(F.char_length("text")).alias("n"))
    placed = materialise(keys.repartitionByRange("k").withColumn("part", F.spark_partition_id()), "keys")
    ends = placed.groupBy("part").agg(F.max(F.struct("k", "n")).alias("last"))
    parts = W.partitionBy(F.lit(0)).orderBy("part")
    ends = ends.withColumn("closing", F.coalesce(
        F.lag("last").over(parts), F.last("last").over(parts.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
    inner = placed.withColumn("look", F.lag(F.struct("k", "n")).over(W.partitionBy("part").orderBy("k")))
    return inner.join(ends.select(F.col("part").alias("p"), "closing"), F.col("part") == F.col("p")).select(
        F.col("k").alias("own"), F.coalesce("look", "closing").alias("before"))


def compare_edits(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: int = 4) -> DataFrame:
    """Every document's sketch beside that of its edited text and of the next document in id order.

    The edited text has its last n / `part` code points replaced by as many first ones of the next document. Columns:
    the id, n_chars, edited (the text), sketch, edited_sketch, next_sketch.

    Texts are shuffled once, by key; the next document's side of the join reads the same exchange, and sends on only as
    much of each text as is wanted.
    """
    # Within a struct, null is a value like any other, and the smallest.
    own = docs.select(F.struct(F.col(f"`{doc_id}`").alias("id")).alias("k"),
                      F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    dealt = with_sketch(own, "text", "sketch").repartition("k")
    first = dealt.withColumn("_r", F.row_number().over(W.partitionBy("k").orderBy(F.xxhash64("text")))).filter("_r = 1")
    wanted = F.floor(F.col("before.n") / part).cast("int")
    given = first.join(previous_keys(own), F.col("k") == F.col("own")).select(
        F.col("before.k").alias("to"), F.substring(F.col("text"), F.lit(1), wanted).alias("lead"),
        F.col("sketch").alias("next_sketch"))
    met = dealt.join(given, F.col("k") == F.col("to"))
    n = F.char_length("text")
    cut = F.floor(n / part).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("lead"), F.lit(1), cut))
    met = met.select(F.col("k.id").alias(doc_id), n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    return with_sketch(met, "edited", "edited_sketch")
