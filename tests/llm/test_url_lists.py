import datetime as dt

from pyspark.sql import functions as F

from fareloom.llm import url_lists

T = dt.datetime
CAPTURES = "page_id long, url string, fetched timestamp, n long, key string, month int"
ENTRIES = "list string, kind string, pattern string, action string, at timestamp, since string"


def captures(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2) for r in rows], CAPTURES)


def entries(spark, rows):
    return spark.createDataFrame([(*r, "s") for r in rows], ENTRIES)


ROWS = [
    (1, "http://user@WWW.Bad.example.com:80/a/#x", T(2024, 3, 5)), (2, "https://www.bad.example.com/a", T(2024, 1, 1)),
    (3, "http://notbad.example.com/", T(2024, 3, 5)), (4, "http://x.org/page?q=1#frag", T(2024, 5, 1)), (5, "http://x.org/page?q=2", T(2024, 5, 1)),
    (6, None, T(2024, 5, 1)), (7, "no address", T(2024, 5, 1)), (8, "http://bad.example.com", None), (None, "http://bad.example.com.", T(2025, 1, 1)),
    (9, "http://bad.example.com", T(2024, 4, 1)), (9, "http://bad.example.com", T(2024, 4, 1)), (10, "http://sub.x.org/", T(2024, 5, 1)),
]
DATED = [
    ("l1", "domain", "Bad.example.com", "add", T(2024, 2, 1)), ("l1", "domain", "bad.example.com", "remove", T(2024, 4, 1)),
    ("l1", "domain", "bad.example.com", "add", T(2024, 12, 1)), ("l2", "url", "https://x.org/page?q=1", "add", T(2023, 1, 1)),
    ("l2", "host", "x.org", "add", T(2024, 1, 1)), ("l2", "host", "x.org", "remove", T(2024, 1, 1)), ("l3", "host", "x.org", "add", T(2024, 4, 30)),
    ("l3", "host", "x.org", "add", T(2024, 4, 30)), (None, "host", "x.org", "add", T(2024, 1, 1)), ("l4", "host", None, "add", T(2024, 1, 1)),
    ("l4", "other", "x.org", "add", T(2024, 1, 1)), ("l4", "host", "x.org", "add", None),
]


def test_validity_at_fetch_time(spark):
    got = {}
    for r in url_lists.evaluate(captures(spark, ROWS), entries(spark, DATED)).collect():
        got.setdefault(r.page_id, []).append((r.n_entries, r.lists, r.listed))
    assert got[1] == [(1, ["l1"], True)] and got[2] == [(0, [], False)] and got[3] == [(0, [], False)]
    assert got[4] == [(2, ["l2", "l3"], True)] and got[5] == [(1, ["l3"], True)]
    assert got[6] == got[7] == got[8] == [(0, [], False)]
    assert got[9] == [(0, [], False)] * 2 and got[None] == [(1, ["l1"], True)] and got[10] == [(0, [], False)]


def test_empty_tables(spark):
    rows = url_lists.evaluate(captures(spark, ROWS), entries(spark, [])).collect()
    assert len(rows) == len(ROWS) and not any(r.listed for r in rows)
    assert url_lists.evaluate(captures(spark, []), entries(spark, DATED)).collect() == []


def test_long_histories_against_plain_lookup(spark):
    start = T(2024, 1, 1)
    dated = [("l", "host", f"h{k % 3}.org", "add" if (k * 7) % 5 < 3 else "remove", start + dt.timedelta(days=11 * k % 700)) for k in range(150)]
    asked = [(k, f"http://h{k % 4}.org/", start + dt.timedelta(hours=13 * k)) for k in range(900)]

    def plain(url, t):
        own = sorted((e[4], e[3] == "remove") for e in dated if f"http://{e[2]}/" == url and e[4] <= t)
        return bool(own) and not own[-1][1]

    got = {r.page_id: r.listed for r in url_lists.evaluate(captures(spark, asked), entries(spark, dated)).collect()}
    assert got == {k: plain(u, t) for k, u, t in asked}


def test_only_built_in_functions(spark):
    plan = url_lists.evaluate(captures(spark, ROWS), entries(spark, DATED))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert url_lists.evaluate(captures(spark, ROWS), entries(spark, DATED)).filter(F.col("listed")).count() == 4
