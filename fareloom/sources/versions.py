"""Published tables: whole versions, of which one pointer file names the current one.

`<folder>/versions/<version>/` holds every table of a version as Parquet and CSV; `<folder>/CURRENT` holds the name of the
version that readers follow. A version is written completely before the pointer is replaced by a rename, so a reader, or a
run that breaks off, never meets half a table, and all tables a reader gets are of one run. There is no log and no table
format: a version is a folder of ordinary files.
"""
from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from fareloom.sources.writers import flat

POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _folder(folder: str, version: str) -> str:
    return f"{folder}/versions/{version}"


def _point(spark: SparkSession, folder: str, version: str) -> None:
    """Replace the pointer file in one step."""
    fresh, fs = _fs(spark, f"{folder}/.{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    jvm = spark._jvm
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri() if fresh.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(fresh), fs.makeQualified(_fs(spark, f"{folder}/{POINTER}")[0]), overwrite)


def current(spark: SparkSession, folder: str) -> str | None:
    """Name of the current version, None before the first."""
    try:
        row = spark.read.text(f"{folder}/{POINTER}").first()
    except AnalysisException as failure:
        if failure.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return row[0] if row else None


def publish(spark: SparkSession, folder: str, tables: dict[str, DataFrame], side_by_side: Callable = map) -> str:
    """Write the tables as a new version, switch to it, and return its name.

    Each table is computed once, into its Parquet files; the CSV is made from those. A table without rows is written as
    Parquet, so that its columns are known, and has no CSV. `side_by_side` may be the `map` of a thread pool.
    """
    version = f"{dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"

    def write(name: str) -> None:
        path = f"{_folder(folder, version)}/{name}"
        tables[name].write.parquet(f"{path}.parquet")
        stored = spark.read.parquet(f"{path}.parquet")
        if not stored.isEmpty():
            flat(stored).write.option("header", True).option("escape", '"').csv(f"{path}.csv")

    list(side_by_side(write, tables))
    _point(spark, folder, version)
    return version


def read_published(spark: SparkSession, folder: str, name: str, version: str | None = None) -> DataFrame:
    """A table of the current version, or of a given one. Name one version to read several tables of one run."""
    version = version or current(spark, folder)
    if version is None:
        raise FileNotFoundError(f"Nothing is published in {folder}")
    return spark.read.parquet(f"{_folder(folder, version)}/{name}.parquet")


def versions(spark: SparkSession, folder: str) -> list[str]:
    """All version folders, oldest first, those of broken runs among them."""
    place, fs = _fs(spark, f"{folder}/versions")
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def drop_versions(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Remove all versions older than the current one but the `keep` - 1 before it; returns what went.

    Versions after the current one may still be in the writing, and stay.
    """
    now = current(spark, folder)
    older = [v for v in versions(spark, folder) if now and v < now]
    gone = older[:len(older) - (keep - 1)] if keep > 1 else older
    for version in gone:
        place, fs = _fs(spark, _folder(folder, version))
        fs.delete(place, True)
    return gone
