"""List entries as people write them."""

import datetime as dt

from callmeter.llm import url_lists


def test_entries_are_read_as_captures_are(spark):
    day = lambda n: dt.date(2024, 1, n)
    captures = spark.createDataFrame([(1, "https://Sub.A.org:8443/x/y?q=1", day(5)), (2, "http://a.org./x//", day(5)), (3, "http://b.net/Z", day(5)), (4, "http://localhost/x", day(5)), (5, None, day(5))], "page_id long, url string, fetched date")
    same = lambda value: {(r.page_id, r.rule) for r in url_lists.judge(captures, spark.createDataFrame([("block", value, "add", day(1))], "verdict string, value string, action string, day date")).collect() if r.rule}
    for value in ("a.org", "A.org", " a.org. ", "*.a.org", ".a.org", "http://a.org", "HTTPS://user@A.ORG:80/?q#f"):
        assert same(value) == {(1, "a.org"), (2, "a.org")}, value
    for value in ("a.org/x", "a.org/x/", "http://A.org//x?z", "a.org./x"):
        assert same(value) == {(2, "a.org/x")}, value
    assert same("b.net/z") == set() and same("b.net/Z") == {(3, "b.net/Z")}  # paths keep their case
    odd = [(None, 1), ("", 1), ("org", 1), ("http://", 1), ("a b.org", 1), ("a..org", 1), ("a.org", None), ("good.org", 1)]
    events = spark.createDataFrame([("block", v, "add", d and day(d)) for v, d in odd], "verdict string, value string, action string, day date")
    assert sorted(repr(r.value) for r in url_lists.refused(events).collect()) == sorted(map(repr, [None, "", "org", "http://", "a b.org", "a..org", "a.org"]))
    assert [r.value for r in url_lists.intervals(events).collect()] == ["good.org"]


def test_two_spellings_are_one_entry(spark):
    day = lambda n: dt.date(2024, 1, n)
    events = spark.createDataFrame([("block", "A.org", "add", day(1)), ("block", "a.org/", "remove", day(9))], "verdict string, value string, action string, day date")
    assert [tuple(r) for r in url_lists.intervals(events).collect()] == [("block", "a.org", day(1), day(9))]
