"""Benchmark decontamination: one Aho-Corasick automaton over the normalised items, one scan of every text.

Normal form: A-Z lower-cased, words are runs of digits, letters a-z and characters beyond ASCII, joined by one space.
A window is `window` consecutive words of an item; a shorter item with words is one window. The automaton's patterns are
windows with a space on both sides, so a match always covers whole words. Match ends map back to word numbers, and word
numbers to code points of the original text.

Defined results: a null or empty text has no words; items without words have no window; repeated items count once per
distinct item id and equal windows point to all their items; a null item id is written as "null"; an empty item table
marks nothing; repeated documents are scanned each for itself; other columns pass through untouched.
"""
from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Sequence
from hashlib import sha256
from itertools import accumulate

import ahocorasick
from pyspark.sql import DataFrame, functions as F

from fareloom.llm.common import opened, per_text, text_column, without

# Byte table of the normal form: kept bytes stay, A-Z become a-z, all other ASCII becomes a space.
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
_NORMAL = bytes(
    b if b >= 128 or b in _KEPT else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)
# Items are held by the driver and by every task only up to this many characters; more are scanned in several passes. An
# automaton takes some 270 bytes a character (measured), so this is about 270 MB a task.
MAX_ITEM_CHARS = 1_000_000

FIELDS = ("n_words long, hits array<struct<first:int,last:int>>, items array<string>, "
          "spans array<struct<start:int,end:int>>")


def normal_words(raw: bytes | None) -> list[bytes]:
    return raw.translate(_NORMAL).split() if raw else []


def item_windows(items: Iterable[tuple[str, bytes]], window: int) -> dict[str, tuple[int, list[str]]]:
    """Pattern -> (its number of words, the items that hold it), as Latin-1 texts of the UTF-8 bytes."""
    found: dict[str, tuple[int, list[str]]] = {}
    for item, raw in items:
        words = normal_words(raw)
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if words else 0):
            pattern = (b" " + b" ".join(words[k:k + size]) + b" ").decode("latin-1")
            owners = found.setdefault(pattern, (size, []))[1]
            if item not in owners:
                owners.append(item)
    return found


def _automaton(windows: dict[str, tuple[int, list[str]]]):
    machine = ahocorasick.Automaton()
    for pattern, (size, owners) in windows.items():
        machine.add_word(pattern, (size, owners))
    machine.make_automaton()
    return machine


def _merged(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, disjoint word intervals, both ends included."""
    out: list[list[int]] = []
    for first, last in sorted(hits):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def _spans(raw: bytes, hits: list[tuple[int, int]]) -> list[dict]:
    """Code-point offsets in the original text of merged word intervals."""
    at = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(_NORMAL))]
    out, bytes_done, points = [], 0, 0
    for first, last in hits:
        ends = []
        for offset in (at[first][0], at[last][1]):
            points += len(raw[bytes_done:offset].decode("utf-8", "replace"))
            bytes_done = offset
            ends.append(points)
        out.append({"start": ends[0], "end": ends[1]})
    return out


def _scanner(shared):
    def make():
        windows = shared.value
        machine = _automaton(windows) if windows else None

        def one(raw: bytes | None) -> dict:
            words = normal_words(raw)
            hits, owners = [], set()
            if words and machine is not None:
                ends = None
                for at, (size, items) in machine.iter((b" " + b" ".join(words) + b" ").decode("latin-1")):
                    if ends is None:  # position of the space after each word
                        ends = list(accumulate(len(w) + 1 for w in words))
                    last = bisect_left(ends, at)
                    hits.append((last - size + 1, last))
                    owners.update(items)
            hits = _merged(hits)
            return {
                "n_words": len(words), "hits": [{"first": a, "last": b} for a, b in hits], "items": sorted(owners),
                "spans": _spans(raw, hits) if hits else [],
            }

        return lambda texts: map(one, texts)

    return make


def find_passages(
    docs: DataFrame, items: DataFrame, *, text: str | Sequence[str] = "text", keep: list[str] | None = None, item_id: str = "item_id",
    item_text: str = "text", window: int = 10, max_item_chars: int = MAX_ITEM_CHARS,
) -> DataFrame:
    """The kept columns of every document with n_words, hits (word intervals, both ends included), items (ids as text,
    sorted) and spans (code-point offsets of the hits in the original text). `text` is a column or a path, as in `per_text`.

    The items' size is measured first. Items beyond `max_item_chars` are dealt into parts by a hash of their id; every
    part has its own automaton and scans the texts in a pass of its own, and the passes' intervals are united.
    """
    spark = docs.sparkSession
    keep = without(docs.columns if keep is None else keep, ["n_words", "hits", "items", "spans"])
    listed = items.select(
        F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("null")).alias("item"),
        F.coalesce(F.col(f"`{item_text}`").cast("string"), F.lit("")).cast("binary").alias("raw"))
    total = listed.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    parts = total // max_item_chars + 1
    # The text travels along only if it is scanned again.
    carried = keep if parts == 1 else [F.col(f"`{c}`") for c in keep]
    source = docs if parts == 1 else docs.select(
        (F.struct(*carried) if carried else F.lit(None).cast("int")).alias("_row"), text_column(text).alias("text"))
    done = None
    for part in range(parts):
        own = listed.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == part) if parts > 1 else listed
        windows = item_windows(((r.item, bytes(r.raw)) for r in own.toLocalIterator()), window)
        scan = _scanner(spark.sparkContext.broadcast(windows))
        if parts == 1:
            return opened(per_text(source, text, keep, FIELDS, scan), keep, ["n_words", "hits", "items", "spans"])
        if done is None:
            done = opened(per_text(source, "text", ["_row", "text"], FIELDS, scan), ["_row", "text"], ["n_words", "hits", "items"])
        else:
            done = _united(per_text(done, "text", ["_row", "text", "n_words", "hits", "items"], FIELDS, scan))

    def make():
        return lambda texts, hits: [
            {"spans": _spans(raw, [(h["first"], h["last"]) for h in own]) if own else []} for raw, own in zip(texts, hits)]

    done = per_text(done, "text", ["_row", "n_words", "hits", "items"], "spans array<struct<start:int,end:int>>", make,
                    extra=F.col("hits"))
    return done.select(*[F.col(f"row._row.`{c}`").alias(c) for c in keep], "row.n_words", "row.hits", "row.items", "made.spans")


def _united(after: DataFrame) -> DataFrame:
    """Hits of two passes over the same texts in one set of disjoint intervals."""
    def add(done, x):
        last = F.try_element_at(done, F.lit(-1))
        joins = last.isNotNull() & (x["first"] <= last["last"] + 1)
        grown = F.struct(last["first"].alias("first"), F.greatest(last["last"], x["last"]).alias("last"))
        kept = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(joins, F.concat(kept, F.array(grown))).otherwise(F.concat(done, F.array(x)))

    both = F.sort_array(F.concat("row.hits", "made.hits"))
    return after.select(
        "row._row", "row.text", "row.n_words", F.aggregate(both, F.slice(both, 1, 0), add).alias("hits"),
        F.sort_array(F.array_union("row.items", "made.items")).alias("items"))


def contamination(found: DataFrame, keep: list[str]) -> DataFrame:
    """Digest of `find_passages`: counts, the hash of the comma-joined item ids, and whether any word is hit."""
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    return found.select(
        *keep, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))
