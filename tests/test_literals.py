"""Golden rows of functions whose queries run on tables."""

from pyspark.sql import functions as F

from mendweave.functions import text as X
from mendweave.functions import urls as U
from mendweave.operators import graph as G
from mendweave.operators import ledger as L
from mendweave.operators import liveness as V

ARCHIVED = [
    ("http://web.archive.org/web/20100101000000/http://a.com/x", "20100101000000", "http://a.com/x"),
    ("http://web.archive.org/web/20120304050607id_/http:/b.com/y?z=1", "20120304050607", "http://b.com/y?z=1"),
    ("https://c.org/", None, "https://c.org/"),
]
LINKS = [
    ("http://a.com/d/e.html?q=1", "f.html", "http://a.com/d/f.html"),
    ("http://a.com/d/e.html", "../x/./y", "http://a.com/x/y"),
    ("http://a.com/d/e.html", "/root", "http://a.com/root"),
    ("http://a.com/d/e.html", "//b.org/z", "http://b.org/z"),
    ("http://a.com/d/e.html?q=1", "?p=2", "http://a.com/d/e.html?p=2"),
    ("http://a.com/d/e.html#t", "#u", "http://a.com/d/e.html#u"),
    ("http://a.com", "x?y=1#z", "http://a.com/x?y=1#z"),
    ("http://a.com/d/", "https://c.net/", "https://c.net/"),
]
CLASSES = [("404", "4/5xx"), ("503", "4/5xx"), ("DNSError", "DNSOther"), ("OtherError", "DNSOther"), ("Similar to a sibling", "Soft-404"), ("200", "200"), ("301", "301")]
ROBOTS = [("http://a.com/private/x", False), ("http://a.com/public", True), ("http://b.com/private/x", True)]
AGES = [("2024-01-01 00:00:00", "max-age=60", "2024-01-31 00:00:00"), ("2024-01-01 00:00:00", "public, max-age=5184000", "2024-03-01 00:00:00"), ("2024-01-01 00:00:00", "no-store", "2024-01-31 00:00:00")]
TIMES = [("20100102030405", "2010-01-02 03:04:05"), ("20100102", "2010-01-02 00:00:00"), ("2010", "2010-01-01 00:00:00"), ("x", None)]
LETTERS = [(0, "A"), (25, "Z"), (26, "AA"), (51, "AZ"), (52, "BA"), (701, "ZZ"), (702, "AAA")]
WHOLE = [("a b c d", "b d", "a c"), ("x y", "", "x y"), ("p q r", "q p", "p r")]
STATES = [(False, False, False, False, "NotLinked"), (True, False, False, False, "NoDrop"), (True, True, False, False, "NoMatch"), (True, True, True, False, "Broken"), (True, True, True, True, "Found")]


def rows(spark, values, schema, *columns):
    return {tuple(r) for r in spark.createDataFrame(values, schema).select(*columns).collect()}


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def test_archive_urls(spark):
    assert rows(spark, ARCHIVED, "url string, ts string, live string", "url", U.archive_ts("url"), U.strip_archive("url")) == set(ARCHIVED)


def test_resolved_links(spark):
    assert rows(spark, LINKS, "base string, link string, r string", "base", "link", U.resolve("base", "link")) == set(LINKS)


def test_status_classes(spark):
    assert rows(spark, CLASSES, "status string, c string", "status", U.status_class("status")) == set(CLASSES)


def test_robots(spark):
    rules = spark.createDataFrame([("a.com", "/private/"), ("a.com", "/tmp"), ("b.com", "")], "host string, disallow string")
    urls = spark.createDataFrame(ROBOTS, "url string, a boolean").select("url")
    assert {tuple(r) for r in V.allowed(urls, rules).collect()} == set(ROBOTS)


def test_ages(spark):
    fetched = F.col("fetched").cast("timestamp_ntz")
    own = spark.createDataFrame(AGES, "fetched string, header string, e string").withColumn("at", fetched)
    assert {tuple(r) for r in own.select("fetched", "header", stamp(L.ttl("at", F.col("header")))).collect()} == set(AGES)


def test_lenient_times(spark):
    assert rows(spark, TIMES, "raw string, t string", "raw", stamp(X.lenient_ts("raw"))) == set(TIMES)


def test_sheet_columns(spark):
    assert rows(spark, LETTERS, "n bigint, l string", "n", X.sheet_column("n")) == set(LETTERS)


def test_complements(spark):
    assert rows(spark, WHOLE, "whole string, part string, r string", "whole", "part", X.complement("whole", "part")) == set(WHOLE)


def test_backlink_states(spark):
    flags = ["linked", "dropped", "matched", "works"]
    assert rows(spark, STATES, ", ".join(f"{c} boolean" for c in flags) + ", s string", *flags, G.state(*map(F.col, flags))) == set(STATES)


def test_steps_along_links(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("d", "e")], "src string, dst string")
    starts = spark.createDataFrame([("a",)], "node string")
    assert {(r["node"], r["depth"]) for r in G.reach(edges, starts, 2).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 2)}
    best = G.best_first(edges, starts, F.ascii("dst"), depth=3, trim=1)
    assert [tuple(r["path"]) for r in best.orderBy("depth").collect()] == [("a",), ("a", "b"), ("a", "b", "c")]


def test_archive_links(spark):
    at = "http://web.archive.org/web/2010id_/http://a.com/d/e.html"
    want = [(at, "f.html", "http://web.archive.org/web/2010/http://a.com/d/f.html"), (at, "/web/2011/http://b.com/", "http://web.archive.org/web/2011/http://b.com/"), (at, "http://web.archive.org/web/2012/http://c.com/x", "http://web.archive.org/web/2012/http://c.com/x"), ("http://a.com/d/", "x", "http://a.com/d/x")]
    assert rows(spark, want, "base string, link string, r string", "base", "link", U.archive_join("base", "link")) == set(want)
    plain = [("https://a.com/x", "http://a.com/x"), ("//a.com", "http://a.com"), ("a.com/x", "http://a.com/x"), ("http://a.com", "http://a.com")]
    assert rows(spark, plain, "u string, r string", "u", U.plain_scheme("u")) == set(plain)


def test_robots_that_failed(spark):
    rules = spark.createDataFrame([("a.com", "/p/"), ("b.com", "/p/")], "host string, disallow string")
    urls = spark.createDataFrame([("http://a.com/p/1",), ("http://b.com/p/1",), ("http://c.com/p/1",)], "url string")
    answers = spark.createDataFrame([("a.com", "404"), ("b.com", "200")], "host string, status string")
    assert {tuple(r) for r in V.allowed(urls, rules, answers=answers).collect()} == {("http://a.com/p/1", True), ("http://b.com/p/1", False), ("http://c.com/p/1", True)}
