"""Token ids in length-delimited binary records, with an offset index for shuffled reads.

A record is: the length of its data (unsigned 64 bits), the masked checksum of those eight bytes (unsigned 32 bits), the
data, the masked checksum of the data (unsigned 32 bits), and one newline byte. All numbers are little-endian. The data
is: length of the id (unsigned 32 bits, all ones for null), the id as UTF-8, bytes per token id (one byte, 2 or 4), and
the token ids. The checksum is CRC-32; masking rotates it right by 15 bits and adds a constant, so that a checksum over
data that holds checksums stays sound.

Spark's text writer writes the records (its line end is the newline), so any file system that Spark reaches will do, and
lost tasks are written again whole. Files follow each other in ascending order of ids, and hold a bounded number of
records, because a reader holds one file. The index is made from the written files: file, offset, length, id, tokens.

Defined results: a null or empty text has no ids but the end id; a null id comes first; rows with equal ids are ordered
by a hash of their text; other columns are not written; an empty table makes no records.
"""
from __future__ import annotations

import codecs
import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from fareloom.llm.common import binary_files, per_process, spread
from fareloom.session import materialise

MASK = 0xA282EAD8
RECORDS_PER_FILE = 20_000
# Words whose ids a process remembers, at most, and the longest worth remembering.
MEMO, MEMO_CHARS = 800_000, 48
# Texts that are encoded together, and their characters: the more, the fewer words are looked up.
TEXTS, CHARS = 2048, 8_000_000

# Latin letters, about which this module and the tokenizer's splitting rule surely agree, and what may follow a word.
_L = "A-Za-zÀ-ÖØ-öø-ɏ"
_OTHER = re.compile(f"[^\x00-\x7f{_L}]")
_TAILED = re.compile(f"([{_L}]+)([^{_L}\\s']+)")
# By byte: 1 for ASCII letters, 2 for marks, before which the splitting rule ends any run of letters.
_KIND = np.array([chr(c).isalpha() + 2 * (32 < c < 127 and not chr(c).isalnum() and chr(c) != "'") if c < 128 else 0 for c in range(256)], np.uint8)
# A space or a line end between other characters starts a token. Beside other white space it may not.
_LOOSE = [[(chr(c), " " + chr(c), "\n" + chr(c)) for c in codes if chr(c).isspace()] for codes in (range(128), range(128, 0x3001))]


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    """The record of `data` without its newline."""
    size = struct.pack("<Q", len(data))
    return b"".join((size, struct.pack("<I", masked(size)), data, struct.pack("<I", masked(data))))


def unframe(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, data) of every record of a file; ValueError where a length or checksum does not hold."""
    at = 0
    while at < len(raw):
        size = raw[at:at + 8]
        if len(size) < 8 or raw[at + 8:at + 12] != struct.pack("<I", masked(size)):
            raise ValueError(f"broken length at byte {at}")
        end = at + 12 + struct.unpack("<Q", size)[0]
        data = raw[at + 12:end]
        if raw[end:end + 5] != struct.pack("<I", masked(data)) + b"\n":
            raise ValueError(f"broken record at byte {at}")
        yield at, data
        at = end + 5


def pack(doc: str | None, ids: bytes, width: int) -> bytes:
    name = b"" if doc is None else doc.encode()
    return struct.pack("<I", 0xFFFFFFFF if doc is None else len(name)) + name + bytes([width]) + ids


def unpack(data: bytes) -> tuple[str | None, np.ndarray]:
    size = struct.unpack_from("<I", data)[0]
    name, at = (None, 4) if size == 0xFFFFFFFF else (data[4:4 + size].decode(), 4 + size)
    return name, np.frombuffer(data, "<u2" if data[at] == 2 else "<u4", offset=at + 1).astype("<u4")


@cache
def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: bytes that are printable Latin-1 stand for themselves, the others for the characters from
    256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Encoder:
    """Token ids of texts as bytes, by the `tokenizers` library, with a memo of words.

    The tokenizer's own splitting never crosses a line end or a space that has no white space beside it, so the ids of a
    text are those of its lines and words, a word with the space before it. The bytes of many texts are cut there, equal
    pieces are found by Arrow and looked up once, and their ids are gathered into place. Every new word goes through the library
    once: Latin letters as words or lines of one text, marks behind them by themselves, other words one by one. Texts with loose
    white space or with the text of a special token go through the library whole.
    """

    def __init__(self, file: str, remembered: int | None = None):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.remembered = Tokenizer.from_file(file), remembered
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 65536 else 4
        self.kind = f"<u{self.width}"
        self.memo: dict[str, dict[str, bytes]] = {" ": {}, "": {}, "tail": {}}
        # The splitting rule leaves letters whole, so for them the same model may split at line ends, or spaces, only: that is
        # faster. All share one model; only texts without special tokens come to the others.
        splits = self.tokenizer.pre_tokenizer
        self.lines = None
        if self.tokenizer.normalizer is None and splits is not None and json.loads(splits.__getstate__()).get("type") == "ByteLevel":
            self.lines = Tokenizer(self.tokenizer.model)
            self.lines.pre_tokenizer = pre_tokenizers.Split(byte_letters()[10], "isolated")
            self.spaced = Tokenizer(self.tokenizer.model)
            self.spaced.pre_tokenizer = pre_tokenizers.Split(byte_letters()[32], "merged_with_next")
            vocabulary = self.tokenizer.get_vocab()
            self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
            self.opens[[k for token, k in vocabulary.items() if token.startswith(byte_letters()[32])]] = True
        self.line_end, = self._whole(["\n"])
        self.end = np.frombuffer(self.line_end, self.kind)[0]

    def _whole(self, texts: list[str]) -> list[bytes]:
        done = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in done]

    def _learn_letters(self, words: list[str], before: str) -> None:
        """Words after a space are told apart by the token that the space begins, others by line ends between them."""
        memo, w = self.memo[before], self.width
        letters = "".join(byte_letters()[b] for b in range(256))
        for low in range(0, len(words), 300):
            part = words[low:low + 300]
            text = codecs.charmap_decode((before + (before or "\n").join(part)).encode(), "strict", letters)[0]
            found = (self.spaced if before else self.lines).encode_batch_fast([text], add_special_tokens=False)[0]
            ids = np.array(found.ids, self.kind)
            begins = np.flatnonzero(self.opens[ids]) if before else np.flatnonzero(np.concatenate([[True], ids == self.end]))
            raw, at = ids.tobytes(), (begins * w).tolist()
            stops = [*at[1:], len(raw)] if before else [*[x - w for x in at[1:]], len(raw)]
            memo.update((x, raw[i:j]) for x, i, j in zip(part, at, stops))

    def _learn(self, new: list[str], before: str) -> None:
        """Remember the ids of new words that have `before` (a space or nothing) before them."""
        memo, tails = self.memo[before], self.memo["tail"]
        latin = self.lines is not None and not _OTHER.search("".join(new))
        stems, tailed, others = set(), [], []
        for word in new:
            if self.lines is None or not latin and _OTHER.search(word):
                others.append(word)
            elif word.isalpha():
                stems.add(word)
            elif found := _TAILED.fullmatch(word):
                tailed.append((word, *found.groups()))
                if found[1] not in memo:
                    stems.add(found[1])
            else:
                others.append(word)
        self._learn_letters(list(stems), before)
        marks = list({tail for _, _, tail in tailed}.difference(tails))
        tails.update(zip(marks, self._whole(marks)))
        memo.update((word, memo[stem] + tails[tail]) for word, stem, tail in tailed)
        memo.update(zip(others, self._whole([before + word for word in others])))

    def _loose(self, text: str) -> bool:
        """Whether a text has to go through the library whole."""
        for space, after_space, after_line in _LOOSE[0] if text.isascii() else _LOOSE[0] + _LOOSE[1]:
            if space in text and (after_space in text or after_line in text):  # one character is found much faster
                return True
        return text[-1:] == "\n" or any(x in text for x in self.special)

    def _values(self, pieces: pa.Array, before: str) -> list[bytes]:
        """Ids of distinct words that have `before` before them."""
        words, memo = pieces.to_numpy(zero_copy_only=False).tolist(), self.memo[before]  # to_pylist is much slower
        found = list(map(memo.get, words))
        places = [k for k, ids in enumerate(found) if ids is None]
        new = [words[k] for k in places]
        self._learn(new, before)
        for k, word in zip(places, new):
            found[k] = memo[word] if len(word) <= MEMO_CHARS else memo.pop(word)
        return found

    def _pieces(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of texts without loose white space. They are cut before every space and line end, and behind letters before marks."""
        column = pa.array(texts, pa.string())
        ends = np.frombuffer(column.buffers()[1], np.int32, len(texts) + 1)
        data = column.buffers()[2] or pa.py_buffer(b"")
        raw = np.frombuffer(data, np.uint8, ends[-1])
        cut = (raw == 32) | (raw == 10)
        if self.lines is not None:
            cut[1:] |= (_KIND[raw[:-1]] == 1) & (_KIND[raw[1:]] == 2)
        cut[ends[:-1][np.diff(ends) > 0]] = True
        starts = np.flatnonzero(cut).astype(np.int32)
        cuts = np.append(starts, np.int32(len(raw)))
        coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(cuts), data).dictionary_encode()
        codes, pieces = coded.indices.to_numpy(), coded.dictionary
        first = pc.binary_slice(pieces.cast(pa.binary()), 0, 1).to_numpy(zero_copy_only=False)
        opens = {" ": first == b" ", "\n": first == b"\n"}
        values = np.empty(len(pieces), object)
        for mark, before in ((" ", " "), ("\n", ""), ("", "")):
            own = opens.get(mark, ~(opens[" "] | opens["\n"]))
            if own.any():
                words = pc.utf8_slice_codeunits(pieces.filter(pa.array(own)), len(mark))
                found = self._values(words, before)
                values[own] = [self.line_end + ids for ids in found] if mark == "\n" else found
        values = values.tolist()
        size = np.fromiter(map(len, values), np.int32, len(values)) // self.width
        flat, begin = np.frombuffer(b"".join(values), self.kind), np.cumsum(size, dtype=np.int32) - size
        long = size[codes]
        stop = np.cumsum(long, dtype=np.int32)
        placed = flat[np.repeat(begin[codes] - (stop - long), long) + np.arange(stop[-1] if len(stop) else 0, dtype=np.int32)]
        upto = np.concatenate([[0], stop])[np.searchsorted(starts, ends)] * self.width
        done = placed.tobytes()
        return (done[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist()))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        low = 0
        while low < len(texts):
            stop, held = low + 1, len(texts[low])
            while stop < len(texts) and stop - low < TEXTS and held + len(texts[stop]) <= CHARS:
                held += len(texts[stop])
                stop += 1
            part, low = texts[low:stop], stop
            for memo in self.memo.values():
                if len(memo) > (MEMO if self.remembered is None else self.remembered):
                    memo.clear()
            loose = list(map(self._loose, part))
            whole = iter(self._whole([t for t, x in zip(part, loose) if x]))
            plain = self._pieces([t for t, x in zip(part, loose) if not x])
            for x in loose:
                yield next(whole if x else plain)


def write_records(
    docs: DataFrame, path: str, tokenizer: str, *, text: str = "text", doc_id: str = "doc_id", end_id: int = 2,
    records_per_file: int = RECORDS_PER_FILE, remembered: int | None = None,
) -> None:
    """Tokenise `docs` and write one record per document to `path`/records, in ascending order of ids.

    `tokenizer` is a file that every executor has at that path. A process remembers the ids of `remembered` words at most
    of each kind (default: MEMO); fewer take less memory and more time.
    """
    ordered = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    ordered = ordered.repartitionByRange("_id").sortWithinPartitions("_id", F.xxhash64("_text"))
    source = spread(ordered, "_text", ["_id"]).select(F.col("row._id").cast("string").alias("id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_process(f"encoder {tokenizer} {remembered}", lambda: Encoder(tokenizer, remembered))
        end = np.array([end_id], encoder.kind).tobytes()
        for batch in batches:
            for low in range(0, batch.num_rows, TEXTS):
                part = batch.slice(low, TEXTS)
                texts = [t or "" for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([
                    frame(pack(doc, ids + end, encoder.width))
                    for doc, ids in zip(part.column("id").to_pylist(), encoder.encode(texts))
                ], pa.binary())], ["record"])

    made = source.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    made.write.option("maxRecordsPerFile", records_per_file).text(f"{path}/records")


_READ = "file string, task int, part int, offset long, length long, id string, before long, n_tokens long, ids_crc32 long"


def _file_order(name: str) -> tuple[int, int]:
    """Order of a file among those of one write: number of the task, number of the task's file."""
    found = re.search(r"part-(\d+)-.*?(?:-c(\d+))?\.[^-]*$", name)
    return int(found[1]), int(found[2] or 0)


def read_records(spark: SparkSession, path: str, tokens: bool = False) -> DataFrame:
    """Every record of `path`/records, checked: place, id, tokens before it in its file, count, checksum of the ids as
    unsigned 32-bit integers, and the ids themselves if `tokens`."""
    def rows(item):
        name, raw = item
        order, before = _file_order(name), 0
        for offset, data in unframe(raw):
            doc, ids = unpack(data)
            row = (name, *order, offset, len(data) + 17, doc, before, len(ids), zlib.crc32(ids.tobytes()))
            yield (*row, ids.tolist()) if tokens else row
            before += len(ids)

    return spark.createDataFrame(
        binary_files(spark, f"{path}/records").flatMap(rows), _READ + (", ids array<long>" if tokens else ""))


def write_index(spark: SparkSession, path: str) -> DataFrame:
    """Read the records back, write `path`/index with one row per record, and return it.

    `start` counts the tokens of all documents before; the totals of the files (one row each) pass through one task.
    """
    own = materialise(read_records(spark, path), "records")
    files = own.groupBy("task", "part").agg(F.sum("n_tokens").alias("total"))
    base = F.coalesce(F.sum("total").over(W.orderBy("task", "part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    index = own.join(files.select("task", "part", base.alias("base")), ["task", "part"]).select(
        "file", "offset", "length", "id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
    index.write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def read_shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """`place`, id and token ids of all records in a seeded order, which the index gives and reruns repeat."""
    index = spark.read.parquet(f"{path}/index").select(
        "file", "offset", F.xxhash64(F.lit(seed), "start").alias("place"))
    found = read_records(spark, path, tokens=True).join(index, ["file", "offset"])
    return found.select("place", "id", "ids").repartitionByRange("place").sortWithinPartitions("place")
