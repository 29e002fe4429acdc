"""Helpers shared by the operators of this package."""
from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

# White space that separates words: space and the control characters tab to carriage return.
SPACES = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only, whatever the locale and alphabet."""
    return F.translate(c, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the words of `text`, separated by white space (see SPACES); null has none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[ \t-\r]+"))


def shingle_hashes(words: Column, size: int) -> Column:
    """XXH64 of every run of `size` words, in order, repeats included; fewer words are one shingle, no words none.

    `words` must be a column of its own, not an expression, or every shingle would compute it anew.
    """
    many = F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)),
                       lambda i: F.xxhash64(*[F.get(words, i + (k - 1)) for k in range(size)]))
    few = F.array(F.xxhash64(F.array_join(words, " ")))
    return F.when(F.size(words) >= size, many).when(F.size(words) > 0, few).otherwise(
        F.array().cast("array<bigint>"))


def text_column(text: str | Sequence[str]) -> Column:
    """The column of that name, or the field at that path within a struct column."""
    return F.col(".".join(f"`{name}`" for name in ([text] if isinstance(text, str) else text))).cast("string")


def spread(df: DataFrame, text: str | Sequence[str], keep: Sequence[str], extra: Column | None = None) -> DataFrame:
    """`row` (the kept columns as one struct, so that no name can clash), `text`, and `extra` if given."""
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(None).cast("int").alias("none"))
    more = [] if extra is None else [extra.alias("extra")]
    return df.select(row.alias("row"), text_column(text).alias("text"), *more)


def _within(row: StructType, path: Sequence[str]) -> list[int] | None:
    """Positions that lead to the string at `path` within `row`; None if no one string is there."""
    found: list[int] = []
    for name in path:
        at = [k for k, f in enumerate(row) if f.name.lower() == name.lower()] if isinstance(row, StructType) else []
        if len(at) != 1:
            return None
        found, row = [*found, at[0]], row[at[0]].dataType
    return found if isinstance(row, StringType) else None


def per_text(
    df: DataFrame, text: str | Sequence[str], keep: Sequence[str], fields: str,
    make: Callable[[], Callable[..., Iterable[dict]]], extra: Column | None = None,
) -> DataFrame:
    """The kept columns and one struct `made` per row, computed from the UTF-8 bytes of the text column.

    `make()` runs once per task and returns a function from a list of texts to one dict per text with the keys of
    `fields` (a DDL list); `extra`, if given, comes as a second list. Texts arrive in Arrow batches and leave as Arrow columns, so no row passes alone.
    `text` may be a path into a kept struct column: such a text goes to the workers once, within its row.
    """
    source, given = spread(df, text, keep, extra), extra is not None
    path = None if isinstance(text, str) else _within(source.schema["row"].dataType, text)
    if path is not None:
        source = source.drop("text")
    wanted = _parse_datatype_string(fields)
    out = StructType([StructField("row", source.schema["row"].dataType), StructField("made", wanted)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, kind = make(), to_arrow_type(wanted)
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                column = part.column("text") if path is None else pc.struct_field(part.column("row"), path)
                texts = column.cast(pa.binary()).to_pylist()
                others = [part.column("extra").to_pylist()] if given else []
                made = pa.array(list(work(texts, *others)), kind)
                yield pa.RecordBatch.from_arrays([part.column("row"), made], ["row", "made"])
        pa.default_memory_pool().release_unused()  # workers live on, beside an executor that needs the memory

    return source.mapInArrow(run, out)


def without(keep: Sequence[str], made: Sequence[str]) -> list[str]:
    """The kept columns that no result replaces. A result takes the place of a column of its name, whatever its case."""
    names = {c.lower() for c in made}
    return [c for c in keep if c.lower() not in names]


def opened(df: DataFrame, keep: Sequence[str], made: Sequence[str]) -> DataFrame:
    """The result of `per_text` as flat columns."""
    return df.select(*[F.col(f"row.`{c}`").alias(c) for c in without(keep, made)],
                     *[F.col(f"made.`{c}`").alias(c) for c in made])


def per_process(name: str, make: Callable[[], object]) -> object:
    """The object of that name in this Python process, made once. Executors keep their Python workers between tasks."""
    held = sys.modules.setdefault("_fareloom_held", types.ModuleType("_fareloom_held")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]


def binary_files(spark: SparkSession, path: str):
    """RDD of (path, bytes) over the files of a folder. A task holds one file at a time, so keep files small."""
    return spark.sparkContext.binaryFiles(path, minPartitions=spark.sparkContext.defaultParallelism)
