"""Writers: dual CSV and Parquet output, append of unseen keys, archive of raw responses."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from fareloom.functions import columns as C
from fareloom.operators.identity import keep_first
from fareloom.schema import TRAVEL
from fareloom.session import BROADCAST_ROWS, fresh_path, materialise, remove
from fareloom.sources.memory import KeyMemory
from fareloom.sources.readers import read_table

# Columns that make up the storage key of an observation and of a raw response.
OBSERVATION_KEY = ["collection_date", "route", "outbound_date", "record_id"]
RAW_KEY = ["year", "month", "day", "route", "outbound_date", "response_hash"]
SNAPSHOT_KEY = ["collection_date", "route", "outbound_date", "snapshot_hash"]
REJECT_KEY = ["file", "content_hash"]
MANIFEST_KEY = ["collection_date", "run_id", "search_id", "collection_timestamp", "route", "outbound_date"]

# Stored observations are laid out by month of collection: few enough folders for years of history on many routes.
LAYOUT = "collection_month"
# Up to so many new rows, the folders of a batch are dealt to tasks, however little there is in them.
FEW_ROWS = 200_000


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON, for text formats."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.withColumns({f.name: F.to_json(f.name) for f in df.schema.fields if isinstance(f.dataType, nested)})


def write_dual(df: DataFrame, folder: str, name: str, staged: bool = False) -> bool:
    """Write `name` as Parquet and as CSV with header; an empty result is skipped and returns False.

    The result is computed once, into the shared folder, and both outputs are copied from there. `staged` says that
    `df` is a stored table already.
    """
    done = df if staged else materialise(df, name)
    if done.isEmpty():
        return False
    done.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    flat(done).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/{name}.csv")
    return True


def key_hashes(keys: list[str]) -> list:
    """128 bits of a key as two longs, `k1` and `k2`; a missing value is a value of its own."""
    text = F.to_json(F.struct(*[F.col(k) for k in keys]), {"ignoreNullFields": "false"})
    digest = F.md5(text)
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    return [half(1).alias("k1"), half(17).alias("k2")]


def _in_months(layout: str, values: list) -> Column:
    known = [v for v in values if v is not None]
    found = F.col(layout).isin(known)
    return found | F.col(layout).isNull() if len(known) < len(values) else found


def key_index(table: DataFrame, path: str, keys: list[str], layout: str, values: list) -> DataFrame | None:
    """Hashes of all keys stored under the given layout values (`k1`, `k2`), None if there are none.

    `path`_keys holds, file by file, the hashes of the keys in the stored table, under the same layout. It is a memory of
    what the files hold, not a truth of its own: files it does not know yet are read for their keys and added, and what
    it knows of files that are gone is left out. So a run that breaks off between table and index leaves nothing wrong.
    """
    spark = table.sparkSession
    # A file's name alone is not unique: one task gives it to its files in all folders. Layout values are months or hex
    # digits, which folder names hold as they are.
    folders = {f"{layout}={'__HIVE_DEFAULT_PARTITION__' if v is None else v}" for v in values}
    named = {"/".join(f.split("/")[-2:]): f for f in table.inputFiles()}
    files = {name: f for name, f in named.items() if name.split("/")[0] in folders}
    if not files:
        return None
    kind = T.StructType([T.StructField("file", T.StringType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()),
                         T.StructField(layout, table.schema[layout].dataType)])
    known = read_table(spark, f"{path}_keys", kind).filter(_in_months(layout, values))
    seen = {r.file for r in known.select("file").distinct().collect()}
    new = [files[name] for name in sorted(files.keys() - seen)]
    if new:
        own = spark.read.schema(table.schema).option("basePath", path).parquet(*new)
        file = F.array_join(F.slice(F.split("_metadata.file_path", "/"), -2, 2), "/")
        hashed = own.select(file.alias("file"), *key_hashes(keys), layout)
        hashed.hint("rebalance", F.col(layout)).sortWithinPartitions("file").write.mode("append").partitionBy(layout).parquet(f"{path}_keys")
        known = read_table(spark, f"{path}_keys", kind).filter(_in_months(layout, values))
    if seen - files.keys():
        there = F.broadcast(spark.createDataFrame([(f,) for f in files], "file string"))
        known = known.join(there, "file", "left_semi")
    return known.select("k1", "k2")


def stored_keys(batch: DataFrame, path: str, keys: list[str] | None = None, layout: str = LAYOUT,
                indexed: bool = False) -> DataFrame:
    """Distinct keys of a stored batch that the table at `path` holds already.

    Only partitions with a `layout` value of the batch are read, the one without a value among them. With `indexed` keys
    are looked up by their 128-bit hashes in the `key_index`, so the table's own key columns are read once, when a file is
    new: worth while for tables with long keys that grow large. A batch of checked small size is broadcast against what
    is stored, so stored rows do not move; a larger one is joined by shuffle.
    """
    keys = keys or OBSERVATION_KEY
    counts = batch.groupBy(layout).agg(F.count("*").alias("n")).collect()  # one row per month of the batch
    total, values = sum(r["n"] for r in counts), [r[layout] for r in counts]
    wanted = list(dict.fromkeys([*keys, layout]))
    table = read_table(batch.sparkSession, path, batch.select(*wanted).schema)
    asked = batch.select(*keys).distinct()
    if indexed:
        index = key_index(table, path, keys, layout, values)
        if index is None:
            return asked.filter("false")
        hashed = asked.select(*keys, *[h.alias(f"_{n}") for h, n in zip(key_hashes(keys), ("k1", "k2"))])
        small = F.broadcast(hashed) if total <= BROADCAST_ROWS else hashed
        return index.join(small, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))).select(*keys).distinct()
    table = table.filter(_in_months(layout, values)).select(*keys)
    if total <= BROADCAST_ROWS:
        asked = F.broadcast(asked)
    return table.join(asked.withColumnsRenamed({k: f"_a_{k}" for k in keys}), _same(keys, "_a_"), "left_semi").distinct()


def _same(keys: list[str], prefix: str):
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return match


def write_laid_out(df: DataFrame, path: str, cluster: tuple[str, ...] = ("route", "advance_purchase_days", "airline")) -> None:
    """Store observations by month of travel, files clustered on several columns, so that filters skip what they can.

    Readers get the month as a partition column, with which `filter_observations` and its siblings leave out whole
    folders; within a file, row groups have narrow ranges of the clustering columns. A month with very many rows is split
    over tasks, and small months share one.
    """
    rows = df.withColumn(TRAVEL, C.month_key("outbound_date"))
    order = [c for c in cluster if c in rows.columns]
    rows = rows.hint("rebalance", F.col(TRAVEL)).sortWithinPartitions(TRAVEL, *order)
    rows.write.mode("overwrite").partitionBy(TRAVEL).parquet(path)


def write_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """Store a table in the session catalog, bucketed and sorted by a key, and read it back.

    Two tables with the same key type and number of buckets join on the key without an exchange. A bucket is one task's
    work, so a key that holds most of the rows should not be the bucketing key.
    """
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def with_layout(df: DataFrame) -> DataFrame:
    return df if LAYOUT in df.columns else df.withColumn(LAYOUT, C.month_key("collection_date"))


def append_new(new: DataFrame, path: str, keys: list[str] | None = None, order: list[str] | None = None,
               layout: str = LAYOUT, staged: bool = False, indexed: bool = False, known: DataFrame | None = None,
               memory: KeyMemory | None = None, after: Callable[[], object] | None = None) -> dict[str, int]:
    """Append the rows whose key is not stored yet; returns how many were stored and how many skipped.

    Rows are first made unique by key, so replaying a batch adds nothing. The table is partitioned by `layout`, which
    must follow from the key. Files are rebalanced, so a hot partition is split over tasks and small ones share a
    file writer. `staged` says that `new` is a stored table already; `indexed` is that of `stored_keys`, and `known` its
    result for this batch, if it is there already. With a `memory` of the table, keys are looked up there instead. `after`
    is waited for before anything is stored. Copies made on the way are removed as soon as they are read for the last time.
    """
    keys = keys or OBSERVATION_KEY
    if layout == LAYOUT:
        new = with_layout(new)
    spark = new.sparkSession
    copies = {name: fresh_path(spark, name) for name in ("batch", "fresh")}
    batch = new if staged else materialise(new, path=copies["batch"])
    if known is None and not memory and not indexed and batch.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        fresh = _unstored(batch, path, keys, order or [], layout)
    else:
        if known is None:
            known = memory.known(batch, keys, layout) if memory else stored_keys(batch, path, keys, layout, indexed)
        known = known.withColumnsRenamed({k: f"_s_{k}" for k in keys})
        fresh = keep_first(batch, keys, order or []).join(known, _same(keys, "_s_"), "left_anti")
    fresh = materialise(fresh, path=copies["fresh"])
    added, total = fresh.count(), batch.count()
    remove(spark, copies["batch"])
    if after:
        after()
    if added:
        few = fresh.repartition(spark.sparkContext.defaultParallelism, layout)
        placed = few if added <= FEW_ROWS else fresh.hint("rebalance", F.col(layout))
        placed.write.mode("append").partitionBy(layout).parquet(path)
        if memory:
            memory.add(fresh, keys, layout)
    remove(spark, copies["fresh"])
    return {"uploaded": added, "skipped_duplicates": total - added}


def _unstored(batch: DataFrame, path: str, keys: list[str], order: list[str], layout: str) -> DataFrame:
    """`keep_first` of a large batch without the rows whose key is stored: one aggregate over the batch and the stored keys
    of its months, so that either is shuffled once and nothing is joined. Null keys equal each other."""
    values = [r[layout] for r in batch.select(layout).distinct().collect()]  # one row per month of the batch
    wanted = list(dict.fromkeys([*keys, layout]))
    table = read_table(batch.sparkSession, path, batch.select(*wanted).schema).filter(_in_months(layout, values))
    first = [c for c in order if c not in keys]
    rest = [*first, *[c for c in batch.columns if c not in keys and c not in first]]
    row = F.struct(*rest, *([] if rest else [F.lit(1).alias("_one")]))
    rows = batch.select(*keys, row.alias("_row"), F.lit(False).alias("_old"))
    both = rows.unionByName(table.select(*keys, F.lit(True).alias("_old")), allowMissingColumns=True)
    best = both.groupBy(*keys).agg(F.min("_row").alias("_best"), F.max("_old").alias("_old")).filter("not _old")
    return best.select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in batch.columns])


def archive_raw(landed: DataFrame, path: str, memory: KeyMemory | None = None) -> dict[str, int]:
    """Store raw responses keyed by year, month, day, route, travel date and content hash; known ones are skipped."""
    when = C.instant("collected_at")
    rows = landed.select(
        F.year(when).alias("year"), F.month(when).alias("month"), F.day(when).alias("day"),
        C.route_of("departure_airport", "arrival_airport").alias("route"),
        C.day("outbound_date").alias("outbound_date"),
        F.sha2("body", 256).alias("response_hash"),
        "body",
        F.date_format(when, "yyyy-MM").alias(LAYOUT),
    )
    return append_new(rows, path, RAW_KEY, ["body"], memory=memory)


def store_snapshots(index: DataFrame, path: str, memory: KeyMemory | None = None) -> dict[str, int]:
    """Store index results with a `collection_date` by the hash of their content; equal results are stored once.

    When and from which response a result was calculated is not part of the content.
    """
    apart = ("collection_date", "calculated_at", "search_id", "collection_timestamp")
    plain = [c for c in index.columns if c not in apart]
    rows = index.withColumn("snapshot_hash", C.sha256_json(plain))
    return append_new(rows, path, SNAPSHOT_KEY, memory=memory)


def store_manifest(manifest: DataFrame, path: str, run_id: str, memory: KeyMemory | None = None) -> dict[str, int]:
    """Store the manifest of landed responses under a run id; a response stored under it before adds nothing."""
    rows = manifest.withColumns({"run_id": F.lit(run_id), "run_timestamp": F.current_timestamp()})
    return append_new(rows, path, MANIFEST_KEY, memory=memory)


def store_rejects(rejects: DataFrame, path: str, run_id: str, memory: KeyMemory | None = None) -> dict[str, int]:
    """Store files that cannot be read (columns file, text) once per file and content, with the run that met them first.

    They are spread over 16 folders by their hash.
    """
    digest = F.sha2("text", 256)
    rows = rejects.select("file", "text", digest.alias("content_hash"), F.substring(digest, 1, 1).alias("shard"),
                          F.lit(run_id).alias("run_id"), F.current_timestamp().alias("rejected_at"))
    return append_new(rows, path, REJECT_KEY, layout="shard", memory=memory)
