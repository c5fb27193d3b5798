"""Titles and contents in one verdict, the second look at crowded clusters, and redirects in the directories above."""

import random

from mendweave.operators import patterns as P
from mendweave.operators import similarity as S
from mendweave.operators import verify as V


def test_unique_titles(spark):
    """A title elsewhere on the site counts only at another URL with another text."""
    rng = random.Random(4)
    rows = [(i, rng.choice("st"), rng.choice(["", "A", "B", "C"]), rng.choice("kl"), rng.choice("xyz")) for i in range(60)] + [(100, "u", "Only", "k", "x"), (101, "v", "Same", "k", "x"), (102, "v", "Same", "l", "x")]
    got = {r["id"]: r["unique"] for r in S.unique_titles(spark.createDataFrame(rows, "id int, site string, title string, key string, text string"), "id", "site", "title", "key", "text").collect()}
    assert got == {a[0]: a[2] != "" and not any(a[1:3] == b[1:3] and a[3] != b[3] and a[4] != b[4] for b in rows) for a in rows}
    assert got[100] and got[101]


def test_titles_and_contents(spark):
    pages = [
        (0, "s", "Harbour bridge opens", True), (1, "s", "Harbour bridge opens today", True), (2, "s", "Harbour festival", True), (3, "s", "Bridge opens", False),
        (4, "other", "Harbour bridge opens", True), (50, "s", "Quiet week", True), (51, "s", "Loud week", True),
    ]
    frame = spark.createDataFrame(pages, "id int, site string, title string, unique boolean")
    title = S.title_similar(frame.where("id % 50 = 0"), frame, "id", "site", "title")
    rows = {(r["query"], r["doc"]): r["cosine"] for r in title.collect()}
    assert rows.keys() == {(0, 1)} and 0.7 < rows[0, 1] < 1
    content = spark.createDataFrame([(0, 2, 0.9), (0, 3, 0.85), (50, 51, 0.95), (50, 2, 0.1)], "query int, doc int, cosine double")
    best = lambda **k: {(r["query"], r["type"]): (r["doc"], r["rank"]) for r in S.similar(title, content, **k).collect()}
    assert best(threshold=0.7) == {(0, "title"): (1, 1), (50, "content"): (51, 1)}  # two contents are alike: neither tells the page
    assert best(threshold=0.7, strict=False, order=("content", "title")) == {(0, "content"): (2, 1), (0, "title"): (1, 2), (50, "content"): (51, 1)}


def test_second_look(spark):
    """Four candidates are looked at again: the confirmed one stays; of those of the others none is confirmed, or none is asked for."""
    rows = [("a", f"c{k}", f"http://h.com/x/{k}", "fuzzy", [3, 0]) for k in range(4)] + [("b", f"c{k}", f"http://h.com/x/{k}", "fuzzy", [3, 0]) for k in range(4)]
    rows += [("c", f"c{k}", f"http://h.com/x/{k}", "archive_canonical" if k == 0 else "fuzzy", [3, 0]) for k in range(4)] + [("d", f"c{k}", f"http://h.com/x/{k}", "token", [3, 1]) for k in range(3)]
    frame = spark.createDataFrame(rows, "nurl string, ncand string, cand string, method string, rule array<int>")
    seen = spark.createDataFrame([("a", "c2", "content"), ("a", "c2", "title"), ("c", "c1", "title"), ("d", "c1", "title")], "nurl string, ncand string, type string")
    got = {(r["nurl"], r["ncand"], r["method"]) for r in V.rematch(frame, seen).collect()}
    assert got == {("a", "c2", "title")} | {(r[0], r[1], r[3]) for r in rows if r[0] != "a"}
    assert {r["nurl"] for r in V.crowded(frame).collect()} == {"a", "b"}


def test_redirects_above(spark):
    """The own directory first; the one above only if nothing else redirects there; no further than that."""
    moved = [f"http://h.com/a/b/{k}.html" for k in (11, 12)] + [f"http://h.com/c/{x}/{k}.html" for x in "de" for k in (1, 2)] + ["http://h.com/a/b/x.pdf", "http://h.com/q/alone.html"]
    targets = [(1, "http://h.com/a/b/13.html"), (2, "http://h.com/c/f/9.html"), (3, "http://h.com/c/f/g/h/9.html"), (4, "http://h.com/q/alone.html"), (5, "http://h.com/a/b/y.pdf")]
    own, redirects = spark.createDataFrame(targets, "id int, url string"), spark.createDataFrame([(u,) for u in moved], "url string")
    got = {(r["id"], r["level"], r["pattern"], r["n"]) for r in P.redirected(own, redirects, "id").collect()}
    assert {g[0] for g in got} == {1, 2} and {g[1] for g in got if g[0] == 1} == {0} and {g[1] for g in got if g[0] == 2} == {1}
    assert (1, 0, "h.com|a|b|*AN", 2) in got and (2, 1, "h.com|c|*A|*AN", 4) in got
