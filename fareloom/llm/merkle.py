"""Merkle dataset manifest: levels of a hash tree as strings of concatenated digests.

Every row is a leaf: the SHA-256, as hex text, of its fields, each as `-` if null, else its UTF-8 byte count, a colon and
the value. Within each group the leaves ascend by id; every `RUN` consecutive nodes (the last run may be shorter) become
the hash of their concatenated digests, until one node, the group's subroot, remains (a lone leaf itself). The subroots,
ordered by group (null first), make the root in the same way.

A block of `RUN ** DEPTH` aligned nodes keeps each of its levels as one string, 64 characters a node. Fixed-width substrings
of a level hash to the next one; the substrings on both sides of a node within its run are its siblings. The blocks' own
roots are the nodes of the next round, which has a 512th of the rows, until each group has one node. Then the siblings of
the upper rounds are handed down block by block. No group passes through one task: positions come from a range partition
over the full order, counts per partition and their running sums, and a block holds at most 512 nodes.

Defined results: a null id comes first and is written as `-`; rows that tie in group and id are ordered by their digests, so
reruns agree; repeated rows are leaves of their own; a null group is a group; other columns pass through neither leaf nor
result unless named; an empty table has an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fareloom.session import materialise

RUN, DEPTH = 8, 3
_WIDTH = 64  # characters of a digest
_BLOCK = RUN ** DEPTH


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A field's part of the leaf."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: list[Column]) -> Column:
    return digest(*map(field, fields))


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`rows` with their position `idx` in the order of their group, and the group's row count `n`.

    Rows are sorted within range partitions; only the counts per partition and group meet in a window.
    """
    held = rows.repartitionByRange(F.col(group).asc_nulls_first(), *order).withColumn("_part", F.spark_partition_id())
    held = materialise(held, "ordered")
    counts = held.groupBy("_part", group).agg(F.count("*").alias("_own"))
    before = W.partitionBy(group).orderBy("_part")
    counts = counts.select(F.col("_part").alias("_p"), F.struct(group).alias("_g"), "_own",
                           F.coalesce(F.sum("_own").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
                           F.sum("_own").over(W.partitionBy(group)).alias("n"))
    inner = W.partitionBy("_part", group).orderBy(*order)
    numbered = held.withColumn("_nth", F.row_number().over(inner) - 1)
    met = numbered.join(counts, (F.col("_part") == F.col("_p")) & (F.struct(group) == F.col("_g")))
    return met.select(*rows.columns, (F.col("_before") + F.col("_nth")).alias("idx"), "n")


def _up(level: Column, lone: Column) -> Column:
    """The level above: the hashes of all runs. A level of one node stays if `lone`, as its block is the whole group."""
    runs = F.ceil(F.length(level) / (_WIDTH * RUN)).cast("int")
    hashed = F.array_join(F.transform(F.sequence(F.lit(1), runs), lambda k: F.sha2(
        F.substring(level, (k - 1) * (_WIDTH * RUN) + 1, F.lit(_WIDTH * RUN)), 256)), "")
    return F.when(lone & (F.length(level) == _WIDTH), level).otherwise(hashed)


def _sides(level: Column, k: Column, lone: Column) -> Column:
    """The digests left and right of node `k` within its run, or null where the tree has ended."""
    run = F.floor(k / RUN).cast("int") * RUN
    left = F.substring(level, run * _WIDTH + 1, (k - run) * _WIDTH)
    right = F.substring(level, (k + 1) * _WIDTH + 1, (run + RUN - 1 - k) * _WIDTH)
    return F.when(~(lone & (F.length(level) == _WIDTH)), F.struct(left.alias("left"), right.alias("right")))


def _blocks(nodes: DataFrame, group: str, extra: list[str]) -> DataFrame:
    """One row per block of nodes (columns: group, idx, n, node, extra): its levels l0 to l3 (l3 is its root) and, as
    arrays in order, the extra columns."""
    gathered = nodes.groupBy(group, F.floor(F.col("idx") / _BLOCK).alias("block")).agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("idx", "node", *extra))).alias("members"))
    out = gathered.select(group, "block", "n", (F.col("n") <= _BLOCK).alias("lone"), F.array_join("members.node", "").alias("l0"),
                          *[F.col(f"members.{c}").alias(c) for c in extra])
    for k in range(DEPTH):
        out = out.withColumn(f"l{k + 1}", _up(F.col(f"l{k}"), F.col("lone")))
    return materialise(out, "blocks")


def _paths(k: Column) -> Column:
    """Siblings of the block's node `k`, from its level up to the block's root."""
    sides, at = [], k
    for depth in range(DEPTH):
        sides.append(_sides(F.col(f"l{depth}"), at, F.col("lone")))
        at = F.floor(at / RUN).cast("int")
    return F.filter(F.array(*sides), lambda x: x.isNotNull())


def _nodes(blocks: DataFrame, group: str) -> DataFrame:
    return blocks.select(group, F.col("block").alias("idx"), F.ceil(F.col("n") / _BLOCK).cast("long").alias("n"),
                         F.col(f"l{DEPTH}").alias("node"))


def _same(group: str, other: str) -> Column:
    return F.col(group).eqNullSafe(F.col(other))


def tree(nodes: DataFrame, group: str, extra: list[str]) -> DataFrame:
    """Blocks of the nodes with their groups' root and `above`: the siblings from the block's root up to it."""
    largest = nodes.agg(F.max("n")).first()[0] or 0
    rounds = [_blocks(nodes, group, extra)]
    while largest > _BLOCK:
        largest = -(-largest // _BLOCK)
        rounds.append(_blocks(_nodes(rounds[-1], group), group, []))
    none = F.array().cast("array<struct<left:string,right:string>>")
    met = rounds.pop().withColumns({"root": F.col(f"l{DEPTH}"), "above": none})
    while rounds:
        paths = met.select(F.col(group).alias("_g"), "root", "above", "lone", *[f"l{k}" for k in range(DEPTH)], F.posexplode(
            F.sequence(F.lit(0), (F.length("l0") / _WIDTH - 1).cast("int"))).alias("_", "k"), "block")
        paths = paths.select("_g", (F.col("block") * _BLOCK + F.col("k")).alias("_b"), "root",
                             F.concat(_paths(F.col("k")), "above").alias("above"))
        met = rounds.pop().join(paths, _same(group, "_g") & (F.col("block") == F.col("_b")))
        met = met.drop("_g", "_b")
    return met


def manifest(docs: DataFrame, *, fields: list[str], group: str, doc_id: str, tampered: Column, change: str, to: Column) -> DataFrame:
    """Per row: the id, its digest `leaf`, `subroot` and `root`, `siblings` (left and right digests, level by level up to
    the root), `folded` (the root recomputed from the siblings and the row as found) and `verified`.

    The row as found differs where `tampered` holds: its field `change` has the value `to`.
    """
    source = {c: F.col(f"`{c}`") for c in fields}
    rows = docs.select(F.col(f"`{group}`").alias("group"), F.col(f"`{doc_id}`").alias("id"),
                       leaf(list(source.values())).alias("node"),
                       F.when(tampered, leaf([to if c == change else v for c, v in source.items()])).alias("changed"))
    rows = rows.select("group", F.struct("id").alias("id"), "node", F.coalesce("changed", "node").alias("found"))
    leaves = tree(placed(rows, "group", ["id", "node", "found"]), "group", ["id", "found"])
    leaves = materialise(leaves, "leaves")
    tops = leaves.filter("block = 0").select(F.struct("group").alias("g"), F.lit(0).alias("whole"), F.col("root").alias("node"))
    top = tree(placed(tops, "whole", ["g"]), "whole", ["g"])
    top = top.select(F.col("root").alias("_root"), "above", *[f"l{k}" for k in range(DEPTH)], "lone", F.posexplode("g").alias("k", "_g"))
    top = top.select("_root", F.concat(_paths(F.col("k")), "above").alias("_over"), F.col("_g.group").alias("_group"))
    met = leaves.join(top, _same("group", "_group"))
    each = met.select("*", F.posexplode(F.arrays_zip("id", "found")).alias("k", "row"))
    each = each.select(
        F.col("row.id.id").alias(doc_id), F.substring("l0", F.col("k") * _WIDTH + 1, F.lit(_WIDTH)).alias("leaf"),
        F.col("root").alias("subroot"), F.col("_root").alias("root"),
        F.concat(_paths(F.col("k")), "above", "_over").alias("siblings"), F.col("row.found").alias("_found"))
    folded = F.aggregate("siblings", F.col("_found"), lambda at, s: digest(s["left"], at, s["right"]))
    return each.withColumn("folded", folded).withColumn("verified", F.col("folded") == F.col("root")).drop("_found")


def proof_digest(siblings: Column) -> Column:
    return F.sha2(F.array_join(F.transform(siblings, lambda s: F.concat(s["left"], s["right"])), ""), 256)
