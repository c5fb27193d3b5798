"""What decides whether and how pages are fetched, on golden rows."""

from pyspark.sql import functions as F

from mendweave.operators import crawl as C


def test_readable(spark):
    rows = [("http://a.com/x", "200", "Text/HTML; charset=utf-8", True), ("http://a.com/x", "404", "text/html", False), ("http://a.com/x.PDF", "200", "text/html", False), ("http://a.com/x", "200", "image/png", False), ("http://a.com/x", None, "text/html", False), ("http://a.com/x", "200", None, False)]
    frame = spark.createDataFrame(rows, "url string, status string, type string, ok boolean")
    assert frame.where(C.readable("url", "status", "type") != F.col("ok")).count() == 0


def test_proxies(spark):
    urls = spark.createDataFrame([(k,) for k in range(7)], "id int")
    assert {r["id"]: r["proxy"] for r in C.assigned(urls, ["a", "b", "c"], ["id"]).collect()} == {k: "abc"[k % 3] for k in range(7)}
    assert {r["proxy"] for r in C.assigned(urls, ["a", "b", "c"], ["id"], fixed=4).collect()} == {"b"}


def test_sitemaps(spark):
    """Named ones first, in any spelling; else the usual one, if it answers."""
    hosts = spark.createDataFrame([("a.com",), ("b.com",), ("c.com",), ("a.com",)], "host string")
    robots = spark.createDataFrame([("a.com", "User-agent: *\nSITEMAP: http://a.com/1.xml\n sitemap : http://a.com/2.xml"), ("b.com", "Disallow: /"), ("d.com", "Sitemap: http://d.com/x")], "host string, text string")
    answers = spark.createDataFrame([("http://b.com/sitemap.xml", 200), ("http://c.com/sitemap.xml", 404)], "url string, status int")
    got = {tuple(r) for r in C.sitemaps(hosts, robots, answers).collect()}
    assert got == {("a.com", "http://a.com/1.xml"), ("a.com", "http://a.com/2.xml"), ("b.com", "http://b.com/sitemap.xml")}


def test_technologies(spark):
    answers = [(1, '{"urls": {}, "technologies": [{"name": "Nginx", "categories": [{"id": 22, "slug": "x"}, {"id": 64}]}, {"name": "Apache", "categories": [{"id": 22}]}, {"name": "Ads", "categories": [{"id": 36}]}]}'), (2, "no json"), (3, None), (4, '{"technologies": []}')]
    got = {(r["id"], r["category"]): r["names"] for r in C.technologies(spark.createDataFrame(answers, "id int, answer string"), "id", "answer").collect()}
    assert got == {(1, "Web servers"): ["Apache", "Nginx"]}


def test_moved(spark):
    rows = [("http://a.com/1", "http://www.a.com/1/", None), ("http://a.com/2", "http://a.com/new?x=1", "http://a.com/new"), ("http://a.com/3", "http://a.com/other", None), ("http://a.com/4", None, None)]
    got = {tuple(r) for r in C.moved_alias(spark.createDataFrame(rows, "url string, final_url string, canonical string")).collect()}
    assert got == {("http://a.com/2", "http://a.com/new"), ("http://a.com/3", "http://a.com/other")}
