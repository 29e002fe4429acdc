"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased; shingles are five words. Templates fall
into classes by their number of shingles, up to m, a power of two. Windows of a class have 2 m shingles and start every
m, so every run of m shingles lies whole in a window. A window that holds 0.8 of a template has a Jaccard similarity of
at least LEAST with it. Bands of one row each collide with that probability, and their number follows from the wanted
probability that at least one does. Retrieved templates count if the window holds at least 0.8 of their shingles.

Everything happens inside each row, by built-in functions: no shuffle, and one row out per row in. Before signatures are
made, texts are passed over that hold no shingle which is the minimum of any template in any band: no band of theirs
could collide, so nothing is lost.

Defined results: a null, empty or short text holds no license; the same template in several windows is reported by its
first best window; repeated rows are scanned each for itself; other columns pass through.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fareloom.llm.common import lower_ascii, shingle_hashes, without

SHINGLE, CONTAINED = 5, 0.8
# Least similarity of a window and a template that it holds to 0.8: a template of just over m / 2 shingles in a window of
# 2 m, which has at least (0.8 * m / 2) shingles in common out of at most (2 m + 0.2 * m / 2).
LEAST = 0.4 / 2.1
# Wanted probability that a band collides at that similarity.
CERTAIN = 0.9999
# Templates whose literals one plan holds; more are scanned in several steps.
TEMPLATES_PER_STEP = 200

# Notices as they are commonly written.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                          "except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License."),
    ("MIT-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                   "associated documentation files, to deal in the Software without restriction"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                   "General Public License as published by the Free Software Foundation"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                   "provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def bands(least: float = LEAST, certain: float = CERTAIN) -> int:
    """Bands of one row that collide at least once with probability `certain` at similarity `least`."""
    return math.ceil(math.log(1 - certain) / math.log(1 - least))


def license_words(text: Column) -> Column:
    plain = lower_ascii(F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(plain, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _permuted(hashes: Column, n: int) -> Column:
    """The hashes under each band's own permutation."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.transform(hashes, lambda x: F.xxhash64(x, j)))


def _shingle_texts(words: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(words) - (SHINGLE - 1)),
                       lambda i: F.array_join(F.slice(words, i, SHINGLE), " "))


def prepare(spark: SparkSession, templates: Sequence[tuple[str, str]], n: int) -> list[dict]:
    """Per template: name, class m, the minimum per band and the hash it belongs to, and the distinct shingles."""
    rows = spark.createDataFrame(list(templates), "name string, text string").withColumn("w", license_words(F.col("text")))
    short = rows.filter(F.size("w") < SHINGLE).select("name").first()
    if short:
        raise ValueError(f"template {short.name} has fewer than {SHINGLE} words")
    rows = rows.withColumn("h", shingle_hashes(F.col("w"), SHINGLE)).withColumn("p", _permuted(F.col("h"), n))
    rows = rows.select(
        "name", F.size("w").alias("words"), F.array_distinct(_shingle_texts(F.col("w"))).alias("shingles"),
        F.transform("p", lambda p: F.array_min(p)).alias("mins"),
        F.array_distinct(F.transform("p", lambda p: F.get(F.col("h"), F.array_position(p, F.array_min(p)).cast("int") - 1))).alias("leads"))
    out = []
    for r in rows.collect():
        out.append({"name": r.name, "m": 1 << max(0, r.words - SHINGLE).bit_length(), "mins": list(r.mins),
                    "leads": list(r.leads), "shingles": list(r.shingles)})
    return out


def _longs(values: Sequence[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _class_hits(own: list[dict], m: int) -> Column:
    """Licenses in the windows of one class: struct<license, first_word, contained>."""
    known = [v for t in own for v in t["mins"]]
    listed = F.array(*[
        F.struct(F.lit(t["name"]).alias("name"), _longs(t["mins"]).alias("mins"),
                 F.array(*[F.lit(s) for s in t["shingles"]]).alias("shingles"))
        for t in own
    ])
    starts = F.sequence(F.lit(1), F.greatest(F.size("_h"), F.lit(1)), F.lit(m))
    signed = F.transform(starts, lambda s: F.struct(
        s.alias("start"), F.transform("_p", lambda p: F.array_min(F.slice(p, s, 2 * m))).alias("sig")))
    met = F.filter(signed, lambda w: F.exists(w["sig"], lambda v: v.isin(known)))
    read = F.transform(met, lambda w: F.struct(
        w["start"].alias("start"), w["sig"].alias("sig"),
        _shingle_texts(F.slice(F.col("_w"), w["start"], 2 * m + SHINGLE - 1)).alias("texts")))

    def verified(w: Column) -> Column:
        retrieved = F.filter(listed, lambda t: F.arrays_overlap(t["mins"], w["sig"]))
        rated = F.transform(retrieved, lambda t: F.struct(
            t["name"].alias("license"), w["start"].alias("first_word"),
            (F.size(F.array_intersect(t["shingles"], w["texts"])) / F.size(t["shingles"])).alias("contained")))
        return F.filter(rated, lambda x: x["contained"] >= CONTAINED)

    return F.flatten(F.transform(read, verified))


def scan(
    docs: DataFrame, *, text: str = "text", keep: list[str] | None = None,
    templates: Sequence[tuple[str, str]] = TEMPLATES, certain: float = CERTAIN,
) -> DataFrame:
    """The kept columns and `found`: array of struct<license, first_word (of the window, from 1), contained>, one per
    license, by name."""
    keep = without(docs.columns if keep is None else keep, ["found"])
    n = bands(certain=certain)
    prepared = prepare(docs.sparkSession, templates, n)
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(None).cast("int").alias("none"))
    rows = docs.select(kept.alias("_row"), license_words(F.col(f"`{text}`")).alias("_w"))
    rows = rows.withColumn("_h", shingle_hashes(F.col("_w"), SHINGLE))
    every = F.array().cast("array<struct<license:string,first_word:int,contained:double>>")
    rows = rows.withColumn("_all", every)
    for low in range(0, len(prepared), TEMPLATES_PER_STEP):
        step = prepared[low:low + TEMPLATES_PER_STEP]
        leads = _longs(sorted({v for t in step for v in t["leads"]}))
        rows = rows.withColumn("_p", F.when(F.arrays_overlap("_h", leads), _permuted(F.col("_h"), n)))
        by_class = {m: [t for t in step if t["m"] == m] for m in sorted({t["m"] for t in step})}
        hits = F.concat("_all", *[_class_hits(own, m) for m, own in by_class.items()])
        rows = rows.withColumn("_all", F.when(F.col("_p").isNotNull(), hits).otherwise(F.col("_all")))
    names = F.array_distinct(F.transform("_all", lambda x: x["license"]))

    def best(name: Column) -> Column:
        own = F.filter("_all", lambda x: x["license"] == name)
        ranked = F.transform(own, lambda x: F.struct((-x["contained"]).alias("c"), x["first_word"].alias("f"), x.alias("x")))
        return F.array_min(ranked)["x"]

    return rows.select(*[F.col(f"_row.`{c}`").alias(c) for c in keep], F.transform(F.sort_array(names), best).alias("found"))
