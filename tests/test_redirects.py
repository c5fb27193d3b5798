"""Each test that a redirect's target must pass, and links matched by anchors and by what stands beside them."""

from mendweave.operators import links as L
from mendweave.operators import redirects as R


def verdicts(spark, moves, dead=(), hosts=(), **tests):
    found = R.neighbors(spark.createDataFrame(moves, "url string, target string"))
    names = {u.split("/")[2] for m in moves for u in m}
    finals = R.final_hosts(spark.createDataFrame([(h,) for h in names], "host string"), spark.createDataFrame([("none", "http://none/"), *hosts], "host string, target string"))
    from mendweave.functions import urls as U

    alive = spark.createDataFrame([(t, t not in dead) for _, t in moves], "u string, alive boolean").select(U.match_key("u").alias("key"), "alive")
    return {r["url"]: r["verdict"] for r in R.verified(found, finals, alive, **tests).collect()}


def test_verdicts(spark):
    moves = [
        ("http://a.com/n/1", "http://a.com/new/1"), ("http://a.com/n/2", "http://a.com/new/2"), ("http://a.com/n/3", "http://other.org/story3"),
        ("http://a.com/n/4", "http://a.com/dead"), ("http://a.com/", "http://www.a.com/"), ("http://a.com/x/y/z", "http://a.com/x"),
        ("http://b.com/p/1", "http://b.com/search"), ("http://b.com/p/2", "http://b.com/search"), ("http://b.com/p/3", "http://b.com/q/3"),
    ]
    got = verdicts(spark, moves, dead={"http://a.com/dead"})
    assert got == {
        "http://a.com/n/1": "ok", "http://a.com/n/2": "ok", "http://a.com/n/3": "other site", "http://a.com/n/4": "broken", "http://a.com/": "homepage",
        "http://a.com/x/y/z": "cut", "http://b.com/p/1": "shared", "http://b.com/p/2": "shared", "http://b.com/p/3": "ok",
    }
    # a host that leads elsewhere takes its pages along; without strictness and working targets other tests decide
    assert verdicts(spark, moves, hosts=[("a.com", "http://www.other.org/")])["http://a.com/n/3"] == "ok"
    loose = verdicts(spark, moves, dead={"http://a.com/dead"}, strict=False, working=False, need_neighbor=True)
    assert loose["http://a.com/n/4"] == "ok" and loose["http://a.com/x/y/z"] == "alone" and loose["http://b.com/p/1"] == "shared"


def test_neighbors(spark):
    """Other forms of the URL do not count, nearer directories come first, and no more than two are climbed."""
    moves = [(f"http://h.com/a/b{k}/p", f"http://h.com/t{k}") for k in (1, 2)] + [("http://h.com/a/b1/q", "http://h.com/u"), ("http://www.h.com/a/b1/q/", "http://h.com/v"), ("http://h.com/z/y/x", "http://h.com/w"), ("http://g.com/a/b1/p", "http://g.com/t")]
    got = {r["url"]: [n["url"] for n in r["near"]] for r in R.neighbors(spark.createDataFrame(moves, "url string, target string"), block=2).collect()}
    assert got["http://h.com/a/b1/p"] == ["http://h.com/a/b1/q", "http://h.com/a/b2/p", "http://h.com/z/y/x"]
    assert got["http://g.com/a/b1/p"] == []
    shallow = {r["url"]: [n["url"] for n in r["near"]] for r in R.neighbors(spark.createDataFrame(moves, "url string, target string"), levels=2).collect()}
    assert shallow["http://h.com/a/b1/p"] == ["http://h.com/a/b1/q", "http://h.com/a/b2/p"]


def test_aliases(spark):
    checked = spark.createDataFrame([("http://a.com/1", "http://a.com/x?s=1", "ok"), ("http://a.com/2", "http://a.com/login", "ok"), ("http://a.com/3", "http://a.com/y", "cut"), ("http://a.com/", "http://b.a.com/", "homepage")], "url string, target string, verdict string")
    named = spark.createDataFrame([("http://www.a.com/x/?s=1", "http://a.com/x"), ("http://a.com/y", None)], "url string, canonical string")
    assert {tuple(r) for r in R.aliases(checked, named).collect()} == {("http://a.com/1", "http://a.com/x"), ("http://a.com/", "http://b.a.com/")}


def page(*items):
    return "<ul>" + "".join(f'<li><a href="{h}">{t}</a></li>' for h, t in items) + "</ul>"


def test_same_links(spark):
    """An anchor alone, two of the same text told apart by their neighbours, and two that cannot be."""
    old = page(("/1", "Harbour news"), ("/2", "read more"), ("/3", "Council votes"), ("/4", "nothing alike"))
    new = page(("/a", "Harbour news"), ("/b", "read more"), ("/c", "Council votes"), ("/d", "Other town"), ("/e", "read more"), ("/f", "Weather"))
    blank = '<p><a href="/b">read more</a></p><p><a href="/e">read more</a></p>'
    pages = spark.createDataFrame([(1, "http://h.com/p", old), (2, "http://h.com/p", new), (3, "http://web.archive.org/web/2010/http://h.com/p", blank)], "page_id bigint, url string, html string")
    links = L.signatures(pages, "page_id")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "page_id bigint, id2 bigint")
    rows = L.matched(pairs, links, "page_id", "id2", "page_id")
    got = {(r["id2"], r["link"]): (r["found"], r["way"]) for r in L.same_link(rows, "page_id", "id2").collect()}
    at = "http://h.com"
    assert got == {(2, f"{at}/1"): (f"{at}/a", "anchor"), (2, f"{at}/2"): (f"{at}/b", "sig"), (2, f"{at}/3"): (f"{at}/c", "anchor")}
    top = [(r["found"], r["rank"]) for r in L.likely_links(rows.where("id2 = 2"), "page_id", "id2", 2).where(f"link = '{at}/2'").orderBy("rank").collect()]
    assert top == [(f"{at}/b", 1), (f"{at}/e", 2)]
