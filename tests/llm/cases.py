"""Small documents that every operator must take: nulls, empty and long texts, ties, repeats, clashing names."""
from __future__ import annotations

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row string, made int, id string, key string, "
          "size int, hits int, found string, score string, n_lines string, _text string, _w int, _key string")
LONG = " ".join(random.Random(5).choice(["la", "the", "of", "onre", "thion", "Aß", "ed."]) for _ in range(30_000))


def rows(extra=()):
    base = [
        (1, "The quick brown fox jumps over the lazy dog", "en", "a"), (2, "The quick brown fox jumps over the lazy dog", "en", "a"),
        (3, None, None, None), (4, "", "en", "b"), (5, " \t\n ", None, "b"), (6, "one", "en", None), (7, "one two", "en", "c"),
        (8, LONG, "en", "c"), (9, "zażółć gęślą jaźń 中文 🙂 naïve", "xx", "a"), (9, "same id, other text", "en", "a"),
        (None, "a text without an id", "en", "a"), (None, "another text without an id", "en", "b"),
        (10, "repeated row here", "en", "b"), (10, "repeated row here", "en", "b"), *extra,
    ]
    filler = ("r", 7, "i", "k", 3, 4, "f", "s", "l", "t", 5, "y")
    return [(*r, None if r[1] is None else len(r[1]), *filler) for r in base]


def docs(spark, extra=()):
    return spark.createDataFrame(rows(extra), SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sample(spark, sf_dir, n=120):
    """The first rows of the smallest table, for brute force."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(n)
