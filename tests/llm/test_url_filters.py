from __future__ import annotations

import datetime as dt
import re

from eventloom.llm import url_filters as U

D = dt.datetime


def brute(captures, entries):
    held: dict[str, dict] = {}
    for key, action, dated in entries:
        if key is not None and dated is not None:
            own = held.setdefault(key, {})
            own[dated] = max(own.get(dated, ""), action)
    out = []
    for url, at in captures:
        best = None
        m = re.match(r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)", url or "")
        if m and at is not None:
            host = m[1].lower().removesuffix(".")
            path = re.match(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)?", url)[1] or ""
            labels, steps = host.split("."), [s for s in path.split("/") if s]
            keys = {".".join(labels[i:]) for i in range(max(1, len(labels) - 1))} | {f"{host}/{'/'.join(steps[: i + 1])}" for i in range(len(steps))}
            for k in keys:
                dates = [d for d in held.get(k, {}) if d <= at]
                if dates and held[k][max(dates)] != U.LIFT:
                    best = max(best or (0, "", "", D.min), (len(k), k, held[k][max(dates)], max(dates)))
        out.append((url, at, *((best[1], best[2], best[3]) if best else (None, None, None)), bool(best and best[2] == U.BLOCK)))
    return out


def test_against_brute_force(spark):
    days = [D(2024, 1, d) for d in (1, 5, 9, 20)]
    urls = ["http://a.b.org/x/y", "https://B.org./", "http://u:p@c.b.org:8080/x?q", "ftp://d.com", "d.com/none", "http://", "", None, "http://a.b.org/x//y/z#f", "http://localhost/p", "http://[::1]:80/x", "http://u@[2001:DB8::1]/y"]
    captures = [(u, t) for u in urls for t in [*days, None]] * 2
    entries = [("b.org", "block", days[1]), ("b.org", "lift", days[2]), ("a.b.org/x", "allow", days[0]), ("a.b.org/x", "block", days[3]), ("a.b.org/x/y", "block", days[2]), ("d.com", "block", days[1]), ("d.com", "allow", days[1]), ("d.com", "block", days[1]), (None, "block", days[0]), ("x", "block", None), ("localhost", "block", days[0]), ("[::1]", "block", days[0]), ("[2001:db8::1]/y", "block", days[1])]
    c = spark.createDataFrame(captures, "url string, fetched_at timestamp").selectExpr("*", "7 AS blocked", "'k' AS key", "1 AS salt", "2 AS u")
    e = spark.createDataFrame(entries, "key string, action string, dated timestamp")
    out = U.evaluate(c, e)
    assert set(out.columns) == {"url", "fetched_at", "key", "salt", "u", "list_key", "list_action", "listed_since", "blocked"}
    got = [tuple(r) for r in out.select("url", "fetched_at", "list_key", "list_action", "listed_since", "blocked").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(captures, entries)))


def test_empty_tables(spark):
    c = spark.createDataFrame([], "url string, fetched_at timestamp")
    e = spark.createDataFrame([], "key string, action string, dated timestamp")
    assert U.evaluate(c, e).count() == 0
    one = spark.createDataFrame([("http://a.org/", D(2024, 1, 1))], c.schema)
    assert [r.blocked for r in U.evaluate(one, e).collect()] == [False]


def test_bounds_are_half_open(spark):
    e = spark.createDataFrame([("a.org", "block", D(2024, 1, 2)), ("a.org", "lift", D(2024, 1, 4))], "key string, action string, dated timestamp")
    c = spark.createDataFrame([("http://a.org/", D(2024, 1, d)) for d in (1, 2, 3, 4)], "url string, fetched_at timestamp")
    assert [r.blocked for r in U.evaluate(c, e).orderBy("fetched_at").collect()] == [False, True, True, False]


def test_very_long_urls_and_clashing_columns(spark):
    deep = "http://a.org/x/" + "/".join(f"{i:05d}" for i in range(170_000))  # 1 MB
    many = "http://" + "l." * 200_000 + "b.org/x"
    days = [D(2024, 1, 1), D(2024, 1, 9)]
    entries = [("a.org/x", "block", days[0]), ("a.org/x/00000/00001", "allow", days[1]), ("b.org", "block", days[0]), ("org", "block", days[0])]
    rows = [(u, days[1], 1, "a", "b") for u in (deep, many, "http://org/q", "http://c.org")]
    c = spark.createDataFrame(rows, "url string, fetched_at timestamp, List_Key int, `a.b` string, SALT string")
    out = U.evaluate(c, spark.createDataFrame(entries, "key string, action string, dated timestamp"))
    assert sorted(out.columns) == sorted(["url", "fetched_at", "a.b", "SALT", "list_key", "list_action", "listed_since", "blocked"])
    assert {r.url: (r.list_key, r.blocked) for r in out.collect()} == {deep: ("a.org/x/00000/00001", False), many: ("b.org", True), "http://org/q": ("org", True), "http://c.org": (None, False)}
