"""Readers for search and option CSV files, collected JSON observations, landed responses and result tables."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fareloom import fixed, schema
from fareloom.operators.cleaning import clean_options, clean_searches

_CORRUPT = "_corrupt_record"


def _csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Header-named text columns; types are set by the cleaning step, so nothing is inferred.

    A quote within a quoted field is doubled. `multi_line` allows line breaks within fields; a file is then read by one
    task.
    """
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line).csv(path)
    return raw.select(*[F.when(~F.col(c).isin(fixed.MISSING_TEXTS), F.col(c)).alias(c) for c in raw.columns])


def read_searches(spark: SparkSession, path: str, request_id: str = "request_id", multi_line: bool = False) -> DataFrame:
    """Cleaned searches; `request_id` names the column that holds the provider's id."""
    raw = _csv(spark, path, multi_line)
    if request_id in raw.columns:
        raw = raw.withColumnRenamed(request_id, "request_id")
    return clean_searches(raw)


def read_options(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return clean_options(_csv(spark, path, multi_line))


def _json_options(reader, pattern: str):
    return reader.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)


def _whole(reader, fields: T.StructType, pattern: str, path: str) -> DataFrame:
    """Rows of JSON files with `_corrupt_record`, which holds the text of a file that cannot be read."""
    marked = T.StructType([*fields.fields, T.StructField(_CORRUPT, T.StringType())])
    reader = _json_options(reader.schema(marked), pattern).option("mode", "PERMISSIVE")
    return reader.option("columnNameOfCorruptRecord", _CORRUPT).json(path)


def _sound(rows: DataFrame) -> DataFrame:
    return rows.filter(rows[_CORRUPT].isNull()).drop(_CORRUPT)


def rejected_files(spark: SparkSession, path: str, pattern: str = "*.json", fields: T.StructType = schema.OBSERVATION) -> DataFrame:
    """The JSON files below `path` that the readers leave out: `file`, its `text`, and as JSON what could be `parsed`."""
    rows = _whole(spark.read, fields, pattern, path)
    return rows.select(
        F.col("_metadata.file_path").alias("file"), F.col(_CORRUPT).alias("text"),
        F.to_json(F.struct(*fields.names)).alias("parsed")).filter(F.col("text").isNotNull())


def read_observations(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Collected observations below `path`; a file holds one object or a list, unreadable files are left out."""
    return _sound(_whole(spark.read, schema.OBSERVATION, pattern, path))


def read_landed(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Landed responses below `path`, one search with its response body per object; unreadable files are left out."""
    return _sound(_whole(spark.read, schema.LANDED, pattern, path))


def stream_landed(spark: SparkSession, path: str, files_per_batch: int = 1000,
                  pattern: str = "*.json") -> DataFrame:
    """The same as a stream of newly arriving files."""
    return stream_marked(spark, path, files_per_batch, pattern).filter("text IS NULL").select(*schema.LANDED.names)


def stream_marked(spark: SparkSession, path: str, files_per_batch: int = 1000, pattern: str = "*.json") -> DataFrame:
    """New files as a stream: landed responses, and one row per file that cannot be read, with its `text`, beside the
    `file` each row is from."""
    rows = _whole(spark.readStream.option("maxFilesPerTrigger", files_per_batch), schema.LANDED, pattern, path)
    return rows.select(*schema.LANDED.names, F.col("_metadata.file_path").alias("file"), F.col(_CORRUPT).alias("text"))


def read_table(spark: SparkSession, path: str, expected: T.StructType | None = None) -> DataFrame:
    """A Parquet table. A missing one is an error, or an empty table of the `expected` schema if that is given."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as failure:
        if failure.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        if expected is None:
            raise FileNotFoundError(f"Table not found: {path}") from failure
        return spark.createDataFrame([], expected)


def read_processed(spark: SparkSession, path: str, required: bool = True) -> DataFrame:
    """The processed observations; when not required, a missing table is empty."""
    return read_table(spark, path, None if required else schema.PROCESSED)
