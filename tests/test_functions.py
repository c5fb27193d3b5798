"""Golden values and laws of the URL, text and HTML functions."""

import pytest
from pyspark.sql import functions as F

from mendweave.functions import html as H
from mendweave.functions import text as X
from mendweave.functions import urls as U
from mendweave.operators import verify as V


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())] if values else [(1,)], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()) or "i int")
    return frame.select(column.alias("x")).first()["x"]


MATCHES = [
    ("http://www.A.com:80/x/", "https://a.com/X", True),
    ("http://a.com/index.html", "http://a.com", True),
    ("http://a.com/d/index.php?b=2&a=1", "http://a.com/d?a=1&b=2", True),
    ("http://a.com/x?y", "http://a.com/x?z", False),
    ("http://a.com/x?a=&b=1", "http://a.com/x?b=1", True),
    ("http://web.archive.org/web/20100101000000/http://a.com/x", "https://www.a.com/x", True),
    ("http://a.com/x", "http://b.com/x", False),
]


@pytest.mark.parametrize(("a", "b", "same"), MATCHES)
def test_match_key(spark, a, b, same):
    assert one(spark, U.match_key("a") == U.match_key("b"), a=a, b=b) is same
    assert one(spark, U.match_key("b") == U.match_key("a"), a=a, b=b) is same


@pytest.mark.parametrize(("path", "want"), [("/a/b/123/c.html", "/a/b"), ("/politics/2010/03/18/story", "/politics"), ("/c.html", ""), ("/a/", ""), ("/", "")])
def test_nondigit_dir(spark, path, want):
    assert one(spark, U.nondigit_dir("p"), p=path) == want


@pytest.mark.parametrize(("url", "index", "want"), [("http://www.sup.org:80/book.cgi?id=1", False, "sup.org|"), ("http://a.com/docs/index.php", True, "a.com|")])
def test_netloc_dir(spark, url, index, want):
    assert one(spark, U.netloc_dir("u", exclude_index=index), u=url) == want


def test_tokens_and_queries(spark):
    assert one(spark, U.tokens("u"), u="http://www.a.com/X/Y-1.html?b=2&a=Q") == ["a.com", "x", "y-1.html", "q", "2"]
    assert one(spark, U.query_map("q"), q="a=1&a=2&b=3") == {"a": ["1", "2"], "b": ["3"]}
    assert one(spark, U.query_map("q"), q="plain") == {"NoKey": ["plain"]}
    assert one(spark, U.digit_runs("u"), u="http://a.com/2010/12345/x-99.html?p=778") == ["778", "12345"]


@pytest.mark.parametrize(("dest", "src", "want"), [("/a/b/c", "/a/b/d", 1), ("/a/b/c", "/a/b/c", 0), ("/a/b/c", "/a/b/c/d", -1)])
def test_prefix_diff(spark, dest, src, want):
    assert one(spark, U.prefix_diff("a", "b"), a=f"http://h.com{dest}", b=f"http://h.com{src}") == want


def test_tree_diff(spark):
    assert one(spark, U.tree_diff("a", "b"), a="http://a.com/x/y", b="http://a.com/x/z") == 1
    assert one(spark, U.tree_diff("a", "b"), a="http://a.com/x/y", b="http://a.com/x/y") == 0


@pytest.mark.parametrize("url", ["http://www.a.com/X?b=2&a=1#f", "https://a.com", "http://a.com/x/?q"])
def test_norm_is_idempotent(spark, url):
    first = one(spark, U.norm("u", trim_www=True, trim_slash=True), u=url)
    assert one(spark, U.norm("u", trim_www=True, trim_slash=True), u=first) == first


def test_predicates(spark):
    assert one(spark, U.is_na("u"), u="http://a.com/user/login.php") and not one(spark, U.is_na("u"), u="http://a.com/blogin.php")
    assert one(spark, U.is_suspicious("a", "b"), a="http://a.com/x", b="http://a.com/")
    assert not one(spark, U.is_suspicious("a", "b"), a="http://a.com/x", b="http://a.com/y")
    assert one(spark, U.is_parent("a", "b"), a="http://a.com/x/", b="http://www.a.com/x/y") and not one(spark, U.is_parent("a", "b"), a="http://a.com/x/", b="http://a.com/x/y/z")
    assert one(spark, U.is_prefix("a", "b"), a="http://a.com/x/", b="http://b.a.com/x/y/z")
    assert one(spark, U.shrinks("a", "b"), a="http://a.com/x/y", b="http://a.com/x")
    assert one(spark, U.suffix_site(U.host("u")), u="http://www.shop.co.uk/") == "shop.co.uk"


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("hopping", "hop"), ("feed", "feed"), ("conformabli", "conform"), ("vietnamization", "vietnam"), ("dying", "die"), ("generic", "generic"), ("by", "by"), ("sky", "sky"), ("controlling", "control"), ("consistency", "consist"), ("knightly", "knight")])
def test_stem(word, want):
    assert X.stem(word) == want


def test_shingles(spark):
    assert one(spark, X.shingles(F.col("w"), 2), w=["a", "b", "a", "b"]) == ["a b", "b a"]
    assert one(spark, X.shingles(F.col("w"), 5), w=["a", "b"]) == ["a b"]
    assert one(spark, X.shingles(F.col("w"), 5), w=[]) == []


def test_titles(spark):
    assert one(spark, X.title_parts("t"), t="Big News | Site :: Home — x-y_z") == ["Big News", "Site", "Home", "x-y", "z"]
    assert one(spark, X.plain_title("t"), t="It's 50% Off! | Shop") == "Its 50 Off"


def test_html(spark):
    page = '<html lang="de-AT"><head><title>A &amp; B |  Site</title></head><body><script>x</script><h1>A &amp; <b>B</b></h1><p>Hi <a href="/x">there</a><a href="#t">no</a></p></body></html>'
    assert one(spark, H.title("h"), h=page) == "A & B | Site"
    assert one(spark, H.heading_title("h"), h=page) == "A & B"
    assert one(spark, H.lang("h"), h=page) == "de"
    assert one(spark, H.text("h"), h=page) == "A & B | Site A & B Hi there no"
    assert [(r["href"], r["anchor"]) for r in one(spark, H.links("h"), h=page)] == [("/x", "there")]
    assert one(spark, H.title("h"), h="<title>Internet Archive Wayback Machine</title>") == ""


GRADES = [("8", "08", V.PRED), ("a-b", "a-b-c-d", V.PRED), ("a-b", "a-b-c-d-e", V.MIX), ("a-b", "x", V.UNPRED), ("x", "x", V.PRED)]


@pytest.mark.parametrize(("token", "source", "want"), GRADES)
def test_grades(spark, token, source, want):
    assert one(spark, V._grade(F.col("t"), F.col("s")), t=token, s=source) == want
