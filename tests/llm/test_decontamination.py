import hashlib
import re

import cases
from fareloom.llm import decontamination as d

ITEM = "It was the best of times, it was the worst of times, it was the age of wisdom"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(text, items, window=10):
    words, hit, owners = split(text), set(), set()
    for item, raw in items:
        own = split(raw)
        n = min(window, len(own))
        for k in range(len(own) - n + 1 if own else 0):
            for at in range(len(words) - n + 1):
                if words[at:at + n] == own[k:k + n]:
                    hit |= set(range(at, at + n))
                    owners.add("null" if item is None else str(item))
    return len(words), len(hit), sorted(owners)


EXTRA = [(60, f"Before. {ITEM.upper()}!! after", "en", "a"), (61, "x the best-of times? it WAS the worst of times it was y", "en", "a"),
         (62, "only nine of times it was the worst of times end", "en", "a"), (63, "say: Kürzer als zehn, naïve!", "de", "a"),
         (64, f"é🙂 {ITEM}", "en", "a")]
ITEMS = [(1, ITEM), (2, "kürzer als zehn"), (3, None), (4, "!!"), (None, "naïve"), (1, ITEM), (5, ITEM)]


def test_against_all_positions(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = d.find_passages(cases.docs(spark, EXTRA), items)
    assert "hits" in found.columns and found.columns.count("hits") == 1
    want = {(r[0], r[1]): plain(r[1], ITEMS) for r in cases.rows(EXTRA)}
    for r in found.collect():
        n, hit, owners = want[r.doc_id, r.text]
        assert (r.n_words, sum(h.last - h.first + 1 for h in r.hits), r["items"]) == (n, hit, owners)
        for span in r.spans:
            assert split(r.text[span.start:span.end])[0] in split(r.text)
    row = next(r for r in found.collect() if r.doc_id == 64)
    assert [row.text[s.start:s.end] for s in row.spans] == [ITEM]


def test_several_passes_unite(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    one = d.find_passages(cases.docs(spark, EXTRA), items, keep=["doc_id"])
    many = d.find_passages(cases.docs(spark, EXTRA), items, keep=["doc_id"], max_item_chars=60)
    key = lambda rows: sorted(map(repr, rows))
    assert key(d.contamination(one, ["doc_id"]).collect()) == key(d.contamination(many, ["doc_id"]).collect())
    assert key(one.select("doc_id", "spans").collect()) == key(many.select("doc_id", "spans").collect())


def test_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    rows = d.contamination(d.find_passages(cases.docs(spark), items, keep=["doc_id"]), ["doc_id"]).collect()
    assert len(rows) == len(cases.rows()) and not any(r.contaminated for r in rows)
    assert {r.items_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}
    full = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert d.find_passages(cases.none(spark), full).collect() == []
