"""Golden rows of functions on HTML, aliases, probes and stems, whose queries run on tables, and trees of odd pages."""

from difflib import SequenceMatcher

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mendweave.functions import diffs as D
from mendweave.functions import html as H
from mendweave.functions import text as X
from mendweave.functions import trees as T
from mendweave.functions import urls as U
from mendweave.operators import liveness as V
from mendweave.operators import search as Q

SAMPLES = [
    ("http://a.com/1", '<html lang="en-GB"><head><base href="http://a.com/d/"><link rel="canonical" href="http://a.com/one"></head><body><time datetime="2019-05-06T10:00">May</time></body></html>', "http://a.com/one", "http://a.com/d/", None, "2019-05-06"),
    ("http://a.com/2", '<html><body><p class="impatient"><a href="http://b.com/two">Impatient?</a></p></body></html>', None, None, "http://b.com/two", None),
    ("http://a.com/3", "<p>nothing here</p>", None, None, None, None),
]
CRUMBS = [
    ("a", '<ul class="breadcrumb"><li><a href="/">Home</a></li><li><a href="/news/">News</a></li></ul><p><a href="/x">x</a></p>', "/ /news/"),
    ("b", '<div id="wm-ipp-base"><a href="/w">archive</a></div><div id="main-breadcrumbs"><a href="/s/">S</a></div>', "/s/"),
    ("c", "<p>none</p>", ""),
]
DIFFS = [
    ("http://a.com/x/1.html", "http://b.com/x/1.html", "000 C b.com"),
    ("http://a.com/old/1", "http://a.com/new/1", "001 C"),
    ("http://a.com/old/2", "http://a.com/newer/2", "001 C"),
    ("http://a.com/p", "http://a.com/q/p", "001 A"),
    ("http://a.com/q/p", "http://a.com/p", "001 D"),
    ("http://a.com/p", "http://a.com/p", ""),
]
OVERLAPS = [("big-news-2.html", "Big News: number 2", 1.0), ("news-big", "Big News", 0.5), ("", "Big", 0.0), ("a-b-c", "x", 0.0)]
TRAILS = [("a", '<nav id="Breadcrumbs"><a href="/">H</a><div class="breadcrumb"><a href="/s">S</a></div></nav><a href="/x">x</a>', "/ /s"), ("b", "<p>none</p>", "")]
SAME = [("http://a.com/x", "http://www.a.com/x/", None, None, None, 0.0, True), ("http://a.com/x", "http://a.com/y", "http://a.com/z", "http://a.com/z", None, 0.0, True), ("http://a.com/x", "http://a.com/y", "http://a.com/x", "http://a.com/y", "http://a.com/y", 0.0, True), ("http://a.com/x", "http://a.com/y", "http://a.com/x", "http://a.com/y", None, 0.96, True), ("http://a.com/x", "http://a.com/y", "http://a.com/x", "http://a.com/y", None, 0.5, False)]
STATUS = [
    ("http://a.com/x", "http://a.com/x", 200, None, "200", "no redirection"),
    ("http://a.com/x", "http://a.com/", 200, None, "200", "homepage redirection"),
    ("http://a.com/x", "http://a.com/y", 200, None, "200", "non-home redirection"),
    ("http://a.com/x", "http://a.com/x", 404, None, "404", "no redirection"),
    ("http://b.com/x", None, None, "DNS lookup failed", "DNSError", "DNS lookup failed"),
    ("http://b.com/x", None, None, "read timed out", "OtherError", "read timed out"),
]
PAGES = [
    ("http://a.com/1", True, "404", True, "http://a.com/1", None, "true", "404"),
    ("http://a.com/2", False, "200", True, "http://a.com/2", None, "N/A", "Not allowed"),
    ("http://a.com/", True, "200", True, "http://a.com/", None, "false", "Homepage"),
    ("http://a.com/3", True, "200", True, "http://a.com/", None, "true", "Redirected to homepage"),
    ("http://a.com/4", True, "200", True, "http://a.com/4", "https://www.a.com/4", "false", "Canonical"),
    ("http://a.com/5", True, "200", True, "http://a.com/5", None, "true", "Similar content"),
    ("http://a.com/6", True, "200", True, "http://a.com/6", None, "false", "Content differs; Similar content"),
    ("http://a.com/7", True, "200", True, "http://a.com/c", None, "true", "Similar redirection"),
    ("http://a.com/8", True, "200", False, "http://a.com/8", None, "N/A", "Not html"),
    ("http://a.com/9", True, "200", True, "http://a.com/9", None, "N/A", "No probe"),
    ("http://a.com/10", True, "200", True, "http://a.com/10", None, "true", "Error text"),
]
PROBES = [
    ("http://a.com/5", "200", "http://a.com/5x", 0, True, 300, "a long text", 0.95),
    ("http://a.com/6", "200", "http://a.com/6x", 0, True, 300, "a long text", 0.95),
    ("http://a.com/6", "200", "http://a.com/6y", 0, True, 300, "another text", 0.2),
    ("http://a.com/7", "200", "http://a.com/c", 1, True, 300, "a long text", 0.1),
    ("http://a.com/10", "200", "http://a.com/10x", 0, True, 4, "Page not found here", 0.5),
]
HOPS = [("a", "http://a.com/x https://a.com/x https://b.com/y", "http://a.com/x https://b.com/y"), ("b", "http://a.com/x", "http://a.com/x")]
STEMS = [("connections", "connect"), ("running", "run"), ("happily", "happili"), ("relational", "relat"), ("skies", "sky"), ("agreed", "agre"), ("hoping", "hope"), ("generously", "generous"), ("national", "nation"), ("cats", "cat")]
TREES = [
    ("a", '<ul><li><b><a href="/1">One</a></b> uno</li><li>dos <a href="/2">Two</a></li></ul>', "/1|One|-|uno /2|Two|dos|-"),
    ("b", '<p><a href="#x">no</a><a href="/3"> </a></p><div><a href="/4">Four</a></div><p>after</p>', "/4|Four|no|after"),
]


def rows(spark, values, schema, *columns):
    return {tuple(r) for r in spark.createDataFrame(values, schema).select(*columns).collect()}


def test_samples(spark):
    got = rows(spark, SAMPLES, "url string, html string, c string, b string, r string, p string", "url", H.canonical("html"), H.base("html"), H.archive_redirect("html"), H.publish_date("html").cast("string"))
    assert got == {(u, c, b, r, p) for u, _, c, b, r, p in SAMPLES}


def test_crumbs(spark):
    by_words = rows(spark, CRUMBS, "id string, html string, l string", "id", F.array_join(F.transform(H.breadcrumb(H.without_toolbar("html")), lambda x: x["href"]), " "))
    assert by_words == {(i, t) for i, _, t in CRUMBS}
    assert rows(spark, TRAILS, "id string, html string, t string", "id", F.array_join(T.breadcrumbs("html"), " ")) == {(i, t) for i, _, t in TRAILS}


def test_signatures(spark):
    dash = F.lit("-")
    text = F.array_join(F.transform(T.link_signatures("html"), lambda x: F.concat_ws("|", x["href"], x["anchor"], F.coalesce(x["before"], dash), F.coalesce(x["after"], dash))), " ")
    assert rows(spark, TREES, "id string, html string, l string", "id", text) == {(i, t) for i, _, t in TREES}


def test_deltas(spark):
    delta = D.signature(D.token_diffs(U.tokens("url"), U.tokens("alias")))
    assert rows(spark, DIFFS, "url string, alias string, x string", "url", "alias", delta) == set(DIFFS)
    assert rows(spark, OVERLAPS, "filename string, title string, s double", "filename", "title", D.title_overlap("filename", "title")) == set(OVERLAPS)


@given(st.lists(st.sampled_from("abcd"), max_size=7), st.lists(st.sampled_from("abcd"), max_size=7))
def test_edits_make_the_other(old, new):
    """As many tokens change, go and come as the matching blocks leave."""
    ops = [op[0] for _, op, _ in D.edits(old, new)]
    same = sum(m.size for m in SequenceMatcher(None, old, new, autojunk=False).get_matching_blocks())
    assert ops.count("C") + ops.count("D") == len(old) - same and ops.count("C") + ops.count("A") == len(new) - same


def test_same_page(spark):
    same = F.coalesce(Q.is_canonical("a", "b", "fa", "fb", "ca", "jaccard"), F.lit(False))
    assert rows(spark, SAME, "a string, b string, fa string, fb string, ca string, jaccard double, s boolean", "a", "b", "jaccard", same) == {(a, b, j, s) for a, b, _, _, _, j, s in SAME}


def test_probes(spark):
    own = rows(spark, STATUS, "url string, final_url string, code int, error string, s string, t string", "url", "final_url", "code", "error", V.status("url", "final_url", "code", "error")["status"], V.status("url", "final_url", "code", "error")["detail"])
    assert own == set(STATUS)
    pages = spark.createDataFrame(PAGES, "url string, allowed boolean, status string, html boolean, final_url string, canonical string, b string, r string").drop("b", "r")
    probes = spark.createDataFrame(PROBES, "url string, status string, final_url string, n_redirects int, same_redirects boolean, words int, text string, jaccard double")
    assert {tuple(r) for r in V.verdicts(pages, probes).collect()} == {(p[0], p[6], p[7]) for p in PAGES}
    assert rows(spark, HOPS, "id string, raw string, h string", "id", "raw", F.array_join(V.real_hops(F.split("raw", " ")), " ")) == set(HOPS)


def test_stems(spark):
    assert rows(spark, STEMS, "word string, s string", "word", X.stems(F.array("word"))[0]) == set(STEMS)


def test_hits_without_a_look(spark):
    """The page itself and error pages go; an exact phrase counts beside many plain hits only; canonical targets must be alive."""
    asked = spark.createDataFrame([("http://a.com/1", "title_site", "q"), ("http://a.com/1", "title_exact", '"q"'), ("http://a.com/1", "token", "t")], "url string, kind string, query string")
    results = spark.createDataFrame([("q", ["http://www.a.com/1/", "http://a.com/2", "http://a.com/404.html"]), ('"q"', ["http://a.com/3"]), ("t", ["http://a.com/2"])], "query string, results array<string>")
    assert {tuple(r) for r in Q.fuzzy(asked, results).collect()} == {("http://a.com/1", "http://a.com/2", 2, "fuzzy")}
    many = spark.createDataFrame([("q", [f"http://a.com/n{k}" for k in range(8)]), ('"q"', ["http://a.com/3"])], "query string, results array<string>")
    assert ("http://a.com/3", 1) in {(r["cand"], r["kinds"]) for r in Q.fuzzy(asked, many).collect()}
    named = spark.createDataFrame([("http://a.com/1", "http://a.com/x"), ("http://a.com/2", "http://a.com/y"), ("http://a.com/3", "http://www.a.com/3/"), ("http://a.com/4", None)], "url string, canonical string")
    alive = spark.createDataFrame([("http://www.a.com/x/", True), ("http://a.com/y", False)], "u string, alive boolean").select(U.match_key("u").alias("key"), "alive")
    assert {tuple(r) for r in Q.working(Q.canonical_alias(named), alive).collect()} == {("http://a.com/1", "http://a.com/x")}


# --- trees ----------------------------------------------------------------------------------------------------------------


def test_deep_pages():
    deep = "<div>" * 5000 + '<a href="/x">x</a>' + "</div>" * 5000 + "<p>end</p>"
    assert T.links(deep) == [("/x", "x", None, "end")]
    assert T.title_and_body(deep) == ("", "end", 2, 1)
    assert T.breadcrumb(deep, "http://h.com/a/b") == []


def test_odd_pages():
    for html in (None, "", "<", "</p>", "<a href='/1'>", "text only", "<p></div></p>", "<script>var a = '<p>no</p>'</script>", "<a href=''>x</a>"):
        assert T.links(html) == [] and T.breadcrumb(html, "http://h.com/a") == []
    assert T.title_and_body("text <b>and</b> more") == ("", "text and more", 1, 1)


def test_blocks_and_title():
    """Elements within a line belong to the text around them; the page's frame, and blocks that are mostly links, do not count."""
    html = (
        "<html><head><title>Big News - Site</title><style>x</style></head><body><nav><a href='/'>Home</a></nav><h2>Other</h2><h1>Big <i>News</i></h1>"
        "<p>One <b>bold</b> and <a href='/l'>a link</a>.</p><ul><li><a href='/1'>first of many links</a></li></ul><div>loose<p>inner</p>again</div><footer>end</footer></body></html>"
    )
    title, body, n, kept = T.title_and_body(html)
    assert title == "Big News" and body.split("\n") == ["Other", "Big News", "One bold and a link .", "loose", "inner", "again"] and (n, kept) == (7, 6)
    assert T.title_and_body("<title>Wayback Machine</title><p>x</p>")[0] == ""


def test_likely_trails():
    """Links that all lead upwards, the widest element of them; not with another link in it, nor more than the path has parts."""
    page = "<div><p><a href='/'>Home</a> &gt; <a href='/news/'>News</a> &gt; <a href='/news/2010'>2010</a></p></div><p><a href='/'>Home</a><a href='/x'>x</a></p>"
    assert T.breadcrumb(page, "http://www.h.com/news/2010/a.html") == ["/", "/news/", "/news/2010"]
    assert T.breadcrumb(page, "http://h.com/news") == []
    assert T.breadcrumb(page, "http://h.com/other/a/b/c") == []
    based = "<base href='http://h.com/news/'><ol><li><a href='..'>up</a></li><li><a href='.'>here</a></li></ol>"
    assert T.breadcrumb(based, "http://h.com/news/2010/x") == ["..", "."]
