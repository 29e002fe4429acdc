import glob
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import cases
from fareloom.llm import token_records as t
from fareloom.session import fresh_path

FILE = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(FILE)


def ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def test_memo_equals_whole_texts():
    rng = random.Random(1)
    parts = ["a", "B", "é", "'s", "'", " ", "  ", "\n", "\n\n", "\t", "\r\n", "1", "23", ".", "!!", " the", "Ω", "中", "\x1c", "\x85",
             "<|endoftext|>", "_", "ß", "ŉ", "ǅ", "½", "'re", "x́", "​", "🙂", "don't", "\xa0", "　"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(6000)] + [cases.LONG, "x" * 5000]
    encoder = t.Encoder(FILE)
    for text, raw in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(raw, encoder.kind).tolist() == ids(text), repr(text)
    small = t.Encoder(FILE)
    t_memo, t.MEMO = t.MEMO, 10
    try:
        assert list(small.encode(texts[:600])) == list(encoder.encode(texts[:600]))
    finally:
        t.MEMO = t_memo


def test_round_trip(spark):
    path = fresh_path(spark, "tokens")
    t.write_records(cases.docs(spark), path, FILE, records_per_file=2)
    index = t.write_index(spark, path).collect()
    rows = cases.rows()
    assert len(index) == len(rows)
    want = sorted((r[0] is not None, r[0] or 0, len(ids(r[1])) + 1, zlib.crc32(np.array([*ids(r[1]), 2], "<u4").tobytes())) for r in rows)
    got = sorted((r.id is not None, int(r.id or 0), r.n_tokens, r.ids_crc32) for r in index)
    assert got == want
    start = 0
    for r in sorted(index, key=lambda r: r.start):  # ascending ids, null first, without a gap
        assert r.start == start
        start += r.n_tokens
    order = [int(r.id) if r.id else -1 for r in sorted(index, key=lambda r: r.start)]
    assert order == sorted(order)
    shuffled = [(r.id, tuple(r.ids)) for r in t.read_shuffled(spark, path, 3).collect()]
    again = [(r.id, tuple(r.ids)) for r in t.read_shuffled(spark, path, 3).collect()]
    assert shuffled == again and len(shuffled) == len(rows)
    assert sorted(len(x) for _, x in shuffled) == sorted(r.n_tokens for r in index)


def test_empty_table(spark):
    path = fresh_path(spark, "tokens")
    t.write_records(cases.none(spark), path, FILE)
    assert t.write_index(spark, path).collect() == []


def test_damage_is_noticed(spark):
    path = fresh_path(spark, "tokens")
    t.write_records(cases.docs(spark).limit(3), path, FILE)
    name = max(glob.glob(f"{path}/records/part-*"), key=lambda f: len(open(f, "rb").read()))
    raw = open(name, "rb").read()
    assert [d for _, d in t.unframe(raw)]
    for at in range(0, len(raw), max(1, len(raw) // 40)):
        broken = bytearray(raw)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            list(t.unframe(bytes(broken)))
    with pytest.raises(ValueError):
        list(t.unframe(raw[:-3]))


def test_words_after_spaces_are_learnt_without_line_ends():
    """A line end between new words cost a token and a split per word."""
    encoder, sent = t.Encoder(FILE), []
    words = ["anreer", "Übergrößen", "naïve", "ofthe", "Ġ", "ŉa", "x"] * 2 + [f"{a}{b}q" for a in "abcdé" for b in "xyzß"]

    class Kept:
        def encode_batch_fast(self, texts, **given):
            sent.extend(texts)
            return spaced.encode_batch_fast(texts, **given)

    spaced, encoder.spaced = encoder.spaced, Kept()
    encoder._learn_letters(words, " ")
    encoder._learn_letters(words, "")
    assert len(sent) == 1 and t.byte_letters()[10] not in sent[0]
    for word in words:
        for before in (" ", ""):
            assert np.frombuffer(encoder.memo[before][word], encoder.kind).tolist() == ids(before + word), (before, word)


def test_loose_texts():
    """As by a search for every pair of a space or line end and white space."""
    encoder, white = t.Encoder(FILE), [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts = [f"a{first}{x}b{more}" for first in (" ", "\n", "") for x in [*white, "é"] for more in ("", "é", "中", " c")] + ["", "a\n", "<|endoftext|>"]
    for text in texts:
        want = text.endswith("\n") or "<|endoftext|>" in text or any(p + x in text for p in " \n" for x in white)
        assert encoder._loose(text) == want, repr(text)


def test_equal_pieces_are_looked_up_once():
    """Every occurrence was, and a word with marks behind it was another word."""
    encoder, learnt = t.Encoder(FILE), []
    learn = encoder._learn
    encoder._learn = lambda words, before: (learnt.extend((before, w) for w in words), learn(words, before))
    texts = ["word, word. word", "", "word\nword! (word)", " word word's", "", "\nword a.b", "word\tword", "word  word", "é, word;"] * 3
    for text, raw in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(raw, encoder.kind).tolist() == ids(text), repr(text)
    assert len(learnt) == len(set(learnt)) and {w for before, w in learnt if before} == {"word", "(word", "word's", "a"}
    assert set(encoder.memo[" "]) == {"word", "(word", "word's", "a"}


@pytest.mark.parametrize("texts,chars", [(1, 10 ** 6), (7, 10 ** 6), (100, 30), (10 ** 6, 10 ** 6)])
def test_texts_in_parts(monkeypatch, texts, chars):
    monkeypatch.setattr(t, "TEXTS", texts)
    monkeypatch.setattr(t, "CHARS", chars)
    rows = [r[1] or "" for r in cases.rows()] * 2 + ["", "x" * 100 + " y", ""]
    encoder = t.Encoder(FILE, 3)
    for text, raw in zip(rows, encoder.encode(rows), strict=True):
        assert np.frombuffer(raw, encoder.kind).tolist() == ids(text)
    assert list(encoder.encode([])) == []
