"""Cursor lists by doubling against a loop that follows them."""

import json
import random

from tarifa.sources import cursors


def follow(pages, first):
    by_url = {}
    for url, status, payload in sorted(pages, key=lambda p: (p[0], p[1], p[2] or "")):
        by_url.setdefault(url, (status, payload))
    out, url, seen = [], first, set()
    while True:
        if url not in by_url:
            return [*out, (url, "missing_page")]
        seen.add(url)
        status, payload = by_url[url]
        body = json.loads(payload) if payload and payload.startswith("{") else None
        if status != 200:
            return [*out, (url, f"http_{status}")]
        if body is None or not isinstance(body.get("data"), list):
            return [*out, (url, "page_error")]
        if not body["data"]:
            return [*out, (url, "empty_page")]
        after = (body.get("cursor") or {}).get("next")
        if not after:
            return [*out, (url, "exhausted")]
        if "/en/api/" in first and "/en/api/" not in after:
            after = after.replace("/api/", "/en/api/", 1)
        if after in seen:
            return [*out, (url, "cycle")]
        out.append((url, None))
        url = after


def body(ids, after):
    return json.dumps({"data": [{"id": str(i), "name": f"n{i}", "price": "5"} for i in ids], "cursor": {"next": after}})


def test_lists_are_those_that_a_loop_finds(spark):
    r = random.Random(8)
    url = lambda n: f"https://s.example/en/api/p{n}"
    pages = []
    for n in range(120):
        after = r.choice([n + 1] * 12 + [r.randint(0, 119), 500, None])
        shown = None if after is None else url(after).replace("/en/api/", r.choice(["/api/", "/en/api/"]))
        pages.append((url(n), r.choice([200] * 25 + [500]), r.choice([body([n, n // 2], shown)] * 25 + [body([], shown), "<html>", None, '{"other": 1}'])))
    pages += pages[:3]
    firsts = [(f"w{n}", url(n)) for n in r.sample(range(120), 40)] + [("gone", url(900))]
    frame, starts = spark.createDataFrame(pages, "url string, status int, payload string"), spark.createDataFrame(firsts, "walk string, url string")
    got = {}
    for row in cursors.linked(frame, starts).orderBy("rank").collect():
        got.setdefault(row.walk, []).append((row.rank, row.url, row.stop))
    for walk, first in firsts:
        expected = follow(pages, first)
        assert got[walk] == [(n, u, s) for n, (u, s) in enumerate(expected, 1)], walk
    items, outcome = cursors.listed(frame, starts)
    good = {w: [u for u, s in follow(pages, f) if s in (None, "exhausted", "cycle")] for w, f in firsts}
    assert {(x.walk, x.pages, x.stop) for x in outcome.collect()} == {(w, len(good[w]), follow(pages, f)[-1][1]) for w, f in firsts}
    ids = {(w, str(i)) for w in good for u in good[w] for i in (int(u.rpartition("p")[2]), int(u.rpartition("p")[2]) // 2)}
    assert {(x.walk, x.id) for x in items.collect()} == ids


def test_a_list_of_a_hundred_thousand_pages_takes_some_twenty_rounds(spark):
    n = 100_000
    pages = spark.range(n).selectExpr("concat('u', id) AS url", "200 AS status", f"concat('{{\"data\": [{{\"id\": \"', id, '\"}}], \"cursor\": {{\"next\": ', CASE WHEN id < {n - 1} THEN concat('\"u', id + 1, '\"') ELSE 'null' END, '}}}}') AS payload")
    found = cursors.linked(pages, spark.createDataFrame([("w", "u0")], "walk string, url string"))
    assert found.selectExpr("count(*)", "max(rank)", "count_if(url <> concat('u', rank - 1))", "max(stop)").first()[:] == (n, n, 0, "exhausted")
