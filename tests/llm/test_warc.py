import hashlib
import random

import pytest

from fareloom.llm import warc
from fareloom.session import fresh_path

SCHEMA = "page_id long, url string, html string, page string, digest string, same string"
BIG = "<p>é" * 300


def pages(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


def round_trip(spark, rows, **options):
    path = fresh_path(spark, "warc")
    warc.write_archives(pages(spark, rows), path, **options)
    return warc.read_archives(spark, path)


ROWS = [(1, "http://a/1", "small"), (2, "http://a/2", "small"), (3, None, None), (4, "", ""), (5, "http://a/5\r\nx", BIG),
        (6, "http://a/6", BIG), (9, "http://a/9", BIG), (9, "http://a/9", BIG), (None, "http://a/n", BIG), (11, "u", "x" * 999),
        (12, "u", "x" * 999), (13, "u", "y" * 1000), (14, "u", "y" * 1000), (15, "u", "WARC/1.1\r\n\r\n\x1f\b" * 200), (16, "u", "z" * 300_000)]


def test_round_trip(spark):
    read = round_trip(spark, ROWS, records_per_file=3)
    assert warc.gaps(read).collect() == []
    got = {}
    for r in warc.records(read).collect():
        got.setdefault(r.id, []).append(r)
    assert sum(map(len, got.values())) == len(ROWS)
    for page, url, html in ROWS:
        raw = (html or "").encode()
        for r in got[None if page is None else str(page)]:
            assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
            keeper = {BIG: 9, "y" * 1000: 14}.get(html)
            if keeper in (None, page):
                assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, raw)
            else:
                assert (r.record_type, r.refers_to, r.payload) == ("revisit", str(keeper), None)
    assert got["3"][0].url is None and got["5"][0].url == "http://a/5%0D%0Ax"


def test_empty_table(spark):
    assert round_trip(spark, []).collect() == []


def archive(n=8):
    records = []
    for k in range(n):
        body = (f"page {k} " * 40).encode()
        records.append(warc.build_record(str(k), f"http://x/{k}", "2024-01-01T00:00:00Z", body, len(body),
                                         hashlib.sha1(body).hexdigest(), False, None))
    return records


@pytest.mark.parametrize("gzip", [True, False])
def test_salvage_after_every_kind_of_damage(gzip):
    parts = [warc._gzip(r) + warc._END for r in archive()] if gzip else archive()
    starts = [sum(map(len, parts[:k])) for k in range(len(parts))]
    whole = b"".join(parts)
    assert [r["id"] for r in warc.salvage(whole)] == [str(k) for k in range(8)]
    rng = random.Random(2)
    for trial in range(60):
        at, raw = starts[3] + rng.randrange(len(parts[3]) - (20 if gzip else 0)), bytearray(whole)
        kind = trial % 3
        if kind == 0:
            raw[at] ^= 1 << rng.randrange(8)
        elif kind == 1:
            del raw[at:at + rng.randint(1, 40)]
        else:
            raw[at:at] = rng.randbytes(rng.randint(1, 40))
        found = list(warc.salvage(bytes(raw)))
        ids = [r["id"] for r in found if r["kind"] == "record"]
        assert set(ids) >= {"0", "1", "2", "5", "6", "7"}
        covered = 0
        for r in found:  # everything is a record or a logged gap, or the padding between
            assert r["offset"] >= covered or not gzip
            covered = max(covered, r["end"])
        if len(ids) < 8:  # nothing protects the header lines of a plain record
            gaps = [r for r in found if r["kind"] == "gap"]
            assert gaps and gaps[0]["reason"]


def test_truncated_file_and_leading_garbage():
    parts = [warc._gzip(r) for r in archive(3)]
    found = list(warc.salvage(b"garbage" + b"".join(parts)[:-5]))
    assert [(r["kind"], r.get("id")) for r in found] == [("gap", None), ("record", "0"), ("record", "1"), ("gap", None)]
    assert (found[0]["offset"], found[0]["end"]) == (0, 7)
    assert list(warc.salvage(b"")) == []


def test_members_of_several_records():
    both = warc._gzip(b"".join(archive(2))) + warc._gzip(archive(3)[2])
    assert [r["id"] for r in warc.salvage(both)] == ["0", "1", "2"]
