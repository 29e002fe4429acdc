import re

import pytest

import cases
from fareloom.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(words):
    return [" ".join(words[k:k + 5]) for k in range(len(words) - 4)]


def split(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(text):
    """License -> best share of its shingles in a window, by looking at all windows."""
    own, out = shingles(split(text)), {}
    for name, template in licenses.TEMPLATES:
        want = set(shingles(split(template)))
        m = 1 << (len(shingles(split(template))) - 1).bit_length()
        best = max((len(want & set(own[s:s + 2 * m])) / len(want) for s in range(0, len(own), m)), default=0)
        if best >= 0.8:
            out[name] = best
    return out


LONG_NOTICE = dict(licenses.TEMPLATES)["MIT-notice"]
EXTRA = [
    (70, "aa bb cc\nReleased under the MIT License.\ndd", "en", "a"), (71, "LICENSED under CC-BY NC 4.0", "en", "a"),
    (72, "x " * 37 + LONG_NOTICE.upper() + " y" * 50, "en", "a"), (73, "x " * 50 + LONG_NOTICE.replace("charge", "cost"), "en", "a"),
    (74, LONG_NOTICE[:80], "en", "a"), (75, "Released under the MIT License. " * 3 + "z " * 20 + dict(licenses.TEMPLATES)["GPL-3.0"], "en", "a"),
    (76, "w " * 20_000 + dict(licenses.TEMPLATES)["Apache-2.0-header"], "en", "a"),
]


def test_against_all_windows(spark):
    found = licenses.scan(cases.docs(spark, EXTRA))
    assert found.columns.count("found") == 1
    rows = found.collect()
    assert len(rows) == len(cases.rows(EXTRA))
    for r in rows:
        assert {x.license: x.contained for x in r.found} == plain(r.text), r.doc_id
    assert {x.license for r in rows for x in r.found} >= {"MIT", "CC-BY-NC-4.0", "MIT-notice", "GPL-3.0", "Apache-2.0-header"}
    assert licenses.scan(cases.none(spark)).collect() == []


def test_several_steps(spark, monkeypatch):
    one = licenses.scan(cases.docs(spark, EXTRA), keep=["doc_id"]).collect()
    monkeypatch.setattr(licenses, "TEMPLATES_PER_STEP", 5)
    many = licenses.scan(cases.docs(spark, EXTRA), keep=["doc_id"]).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, many))


def test_bands_and_bounds(spark):
    n = licenses.bands()
    assert 1 - (1 - licenses.LEAST) ** n >= licenses.CERTAIN > 1 - (1 - licenses.LEAST) ** (n - 1)
    with pytest.raises(ValueError):
        licenses.scan(cases.docs(spark), templates=[("short", "too few words")])
    plan = licenses.scan(cases.docs(spark), keep=["doc_id"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
