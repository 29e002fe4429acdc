"""Session defaults and the shared folder for intermediate results."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

# A derived look-up table is broadcast only when it holds at most this many rows.
BROADCAST_ROWS = 100_000


def build_session(app: str = "fareloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators assume: UTC, ANSI casts, adaptive execution."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_private: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder within `spark.checkpoint.dir`, which all executors reach.

    A local session without that setting gets a private folder; on a cluster the setting is required.
    """
    app = spark.sparkContext.applicationId
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that every executor can reach.")
        if app not in _private:
            _private[app] = tempfile.mkdtemp(prefix="fareloom-")
        folder = _private[app]
    return f"{folder.rstrip('/')}/fareloom-{app}"


_owned: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Everything that `fresh_path` and `materialise` put into the shared folder within is removed at the end.

    Only for work whose results are stored elsewhere by then.
    """
    _owned.append([])
    try:
        yield
    finally:
        for path in _owned.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that this application made."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _owned:
        _owned[-1].append(path)
    return path


def materialise(df: DataFrame, name: str = "stage", path: str | None = None) -> DataFrame:
    """Write `df` once to the shared folder and read it back, which cuts lineage and fixes its size. A caller that removes it
    gives its `path`."""
    path = path or fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach(df: DataFrame, derived: DataFrame, on: list[str], rows: int = BROADCAST_ROWS) -> DataFrame:
    """Left-join a derived per-key table back to the wide rows it came from, matching null keys too.

    The derived table is written once and counted, so its size is known before the join is planned. Up to `rows`
    rows it is broadcast and the wide rows never move. Beyond that it is an ordinary shuffle join, where adaptive
    execution splits hot keys.
    """
    small = materialise(derived, "derived")
    if small.count() <= rows:
        small = F.broadcast(small)
    keys = {k: f"_k_{k}" for k in on}
    small = small.withColumnsRenamed(keys)
    match = None
    for left, right in keys.items():
        part = df[left].eqNullSafe(small[right])
        match = part if match is None else match & part
    return df.join(small, match, "left").drop(*keys.values())
