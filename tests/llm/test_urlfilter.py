from __future__ import annotations

import datetime as dt

import pytest

from leftdeep.llm import urlfilter

D = dt.datetime
ENTRIES = [
    ("domain", "bad.com", "add", "spam", D(2024, 1, 1)),
    ("domain", "bad.com", "add", "spam", D(2024, 1, 1)),
    ("domain", "bad.com", "remove", "spam", D(2024, 3, 1)),
    ("domain", "bad.com", "add", "spam", D(2024, 5, 1)),
    ("domain", "sub.bad.com", "add", "b", D(2024, 1, 5)),
    ("domain", "sub.bad.com", "add", "a", D(2024, 1, 5)),
    ("domain", "tie.com", "add", "adult", D(2024, 1, 5)),
    ("domain", "tie.com", "add", "ad", D(2024, 1, 5)),
    ("host", "[2001:DB8::1]", "add", "six", D(2024, 1, 1)),
    ("prefix", "[2001:db8::1]/a//", "add", "six", D(2024, 1, 1)),
    ("domain", "dot.com.", "add", "dot", D(2024, 1, 1)),
    ("host", "Only.org", "add", None, D(2024, 1, 1)),
    ("prefix", "x.net/a/b", "add", "p", D(2024, 2, 1)),
    ("domain", "gone.com", "add", "q", D(2024, 1, 1)),
    ("domain", "gone.com", "remove", "q", D(2024, 1, 1)),
    (None, "n.com", "add", "z", D(2024, 1, 1)),
    ("domain", "n.com", "add", "z", None),
]
CASES = [
    ("http://bad.com/x", D(2024, 1, 1), "domain", "bad.com"),
    ("http://bad.com/x", D(2023, 12, 31, 23, 59), None, None),
    ("http://bad.com/x", D(2024, 3, 1), None, None),
    ("http://www.BAD.com:80/x", D(2024, 2, 29), "domain", "bad.com"),
    ("http://bad.com/x", D(2030, 1, 1), "domain", "bad.com"),
    ("http://notbad.com/", D(2024, 2, 1), None, None),
    ("https://u@t.sub.bad.com?q=1", D(2024, 2, 1), "domain", "sub.bad.com"),
    ("http://only.org", D(2024, 2, 1), "host", "only.org"),
    ("http://www.only.org", D(2024, 2, 1), None, None),
    ("http://x.net/a/b/c?d", D(2024, 2, 1), "prefix", "x.net/a/b"),
    ("http://x.net/a//b", D(2024, 2, 1), "prefix", "x.net/a/b"),
    ("http://x.net/a/bc", D(2024, 2, 1), None, None),
    ("http://gone.com", D(2024, 2, 1), None, None),
    ("http://n.com", D(2024, 2, 1), None, None),
    ("http://tie.com", D(2024, 2, 1), "domain", "tie.com"),
    ("http://u:p@[2001:db8::1]:8080/b", D(2024, 2, 1), "host", "[2001:db8::1]"),
    ("http://[2001:db8::1]/A/b", D(2024, 2, 1), "prefix", "[2001:db8::1]/a"),
    ("http://www.dot.com../x", D(2024, 2, 1), "domain", "dot.com"),
    ("http://x.net" + "/a" * 40_000, D(2024, 2, 1), None, None),
    ("http://x.net/a/b" + "/c" * 40_000, D(2024, 2, 1), "prefix", "x.net/a/b"),
    ("http://" + "a." * 40_000 + "bad.com", D(2024, 2, 1), "domain", "bad.com"),
    ("no url", D(2024, 2, 1), None, None),
    (None, D(2024, 2, 1), None, None),
    ("http://bad.com/x", None, None, None),
]
SCHEMA = "kind string, value string, action string, category string, since timestamp_ntz"


@pytest.mark.parametrize("limit", [urlfilter.LIST_LIMIT, -1])
def test_as_of_the_fetch(spark, limit):
    rows = [(i, u, t, "old", "mine") for i, (u, t, _, _) in enumerate(CASES)] * 2
    df = spark.createDataFrame(rows, "id long, url string, fetched timestamp_ntz, kind string, _url string")
    got = urlfilter.judge(df, spark.createDataFrame(ENTRIES, SCHEMA), salts=3, limit=limit).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["kind"], r["value"], r["blocked"]) == (*CASES[r["id"]][2:], CASES[r["id"]][2] is not None), CASES[r["id"]]
    assert {r["category"] for r in got if r["value"] == "sub.bad.com"} == {"a"}
    assert {r["category"] for r in got if r["value"] == "tie.com"} == {"ad"}
    assert {r["_url"] for r in got} == {"mine"}


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "http://bad.com", D(2024, 2, 1))], "id long, url string, fetched timestamp_ntz")
    assert urlfilter.judge(df, spark.createDataFrame([], SCHEMA)).first()["blocked"] is False
    assert urlfilter.judge(df.limit(0), spark.createDataFrame(ENTRIES, SCHEMA)).count() == 0
