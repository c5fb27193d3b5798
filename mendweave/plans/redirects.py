"""Redirects between pages, and the tests that a target must pass. Events are looks at pages in turn: the k-th of n pages has the
events whose id leaves k when divided by n, a click or sign-up is a redirect to the page that its user looks at next, an error a
broken page."""

from __future__ import annotations

from mendweave.functions import html as H
from mendweave.functions import urls as U
from mendweave.operators import ordered as O
from mendweave.operators import redirects as R

from .common import KEY, URLS, F, query, table, written
from .html import TITLE
from .snapshots import _STATUS

_NA = "list_has_any(string_split_regex(lower(regexp_extract(regexp_extract({0}, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '([^/]*)/?$', 1)), '[^a-z0-9]+'), [" + ", ".join(f"'{w}'" for w in U.ERROR_WORDS) + "])"
_SITE2 = "array_to_string(string_split({0}, '.')[-2:], '.')"

#: Looks at pages, and the latest redirect of each.
LOOKS = f"""{URLS}, o AS (SELECT *, row_number() OVER (ORDER BY page_id) - 1 AS nth, {KEY} AS mk FROM s), ev AS (
  SELECT event_id, user_id, ts, {_STATUS} AS status, event_id % (SELECT count(*) FROM pages) AS nth FROM events
), vi AS (SELECT event_id, ts, status, page_id, url, lead(url) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nexturl FROM ev JOIN o USING (nth)),
la AS (SELECT url, arg_max(nexturl, (ts, event_id)) AS target FROM vi WHERE status LIKE '3%' AND nexturl IS NOT NULL GROUP BY 1)"""
#: Of the URLs with one form the first; then the five nearest in the sort order of host, depth and directory.
NEAR = LOOKS + r""", fm AS (
  SELECT form, min(url) AS url FROM (SELECT la.url, o.bare || CASE WHEN lower(o.path) IN ('', '/') THEN '/' ELSE regexp_replace(lower(o.path), '/$', '') END
    || CASE WHEN o.query = '' THEN '' WHEN len(o.pairs) > 0 THEN '?' || array_to_string(list_sort(list_transform(o.pairs, lambda x: lower(x))), '&') ELSE '?' || lower(o.query) END AS form
    FROM la JOIN o USING (url)) GROUP BY 1
), pl AS (
  SELECT fm.url, form, host, mk, len(segs) AS depth, list_filter(string_split(lower(dir), '/'), lambda x: x <> '') AS dirs FROM fm JOIN o USING (url)
), pn AS (SELECT pl.*, la.target, t.mk AS tk, row_number() OVER (ORDER BY pl.host, pl.depth, array_to_string(pl.dirs, '/'), pl.form) AS rn FROM pl JOIN la USING (url) JOIN o t ON t.url = la.target),
cl AS (
  SELECT a.url, b.url AS near, b.mk AS nk, b.tk AS ntk, abs(a.rn - b.rn) AS away, b.rn,
    len(a.dirs) - (SELECT count(*) FROM range(1, len(a.dirs) + 1) t(i) WHERE a.dirs[1:i::INT] = b.dirs[1:i::INT]) AS up
  FROM pn a JOIN pn b ON a.host = b.host AND a.depth = b.depth AND a.rn <> b.rn AND abs(a.rn - b.rn) <= 5
), nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY up, away, rn) AS k FROM cl WHERE up < 3) x WHERE k <= 5)"""
#: Verdicts on the redirects.
CHECKED = NEAR + f""", st AS (SELECT o.mk, bool_or(status NOT LIKE '4%') AS alive FROM (SELECT url, arg_max(status, (ts, event_id)) AS status FROM vi GROUP BY 1) v JOIN o USING (url) GROUP BY 1),
hm AS (SELECT DISTINCT host FROM o), fh AS (SELECT a.host, coalesce(b.host, a.host) AS final FROM hm a LEFT JOIN hm b ON b.host = regexp_replace(a.host, '^(m|blog|www)\\.', '') AND b.host <> a.host),
ck AS (SELECT url, bool_or(ntk = (SELECT tk FROM pn WHERE pn.url = c.url)) AS shared FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY k) AS j FROM nb WHERE nk <> ntk) c WHERE j <= 2 GROUP BY 1),
vd AS (
  SELECT pn.url, pn.target, CASE
    WHEN {_SITE2.format('fa.final')} <> {_SITE2.format('fb.final')} THEN 'other site'
    WHEN NOT coalesce(st.alive, false) THEN 'broken'
    WHEN a.path IN ('', '/') AND a.query = '' AND b.path IN ('', '/') AND b.query = '' THEN 'homepage'
    WHEN a.query = '' AND b.query = '' AND contains(a.path, b.path) THEN 'cut'
    WHEN coalesce(ck.shared, false) THEN 'shared' ELSE 'ok' END AS verdict
  FROM pn JOIN o a ON a.url = pn.url JOIN o b ON b.url = pn.target JOIN fh fa ON fa.host = a.host JOIN fh fb ON fb.host = b.host LEFT JOIN st ON st.mk = b.mk LEFT JOIN ck ON ck.url = pn.url)"""


def looks(spark, d):
    """(event_id, ts, status, page_id, url, target): snapshots of pages, and where the next look of the same user goes."""
    own = O.ranked(table(spark, d, "pages").select("page_id", "url"), "page_id", rank="nth")
    n = own.count()
    seen = table(spark, d, "events").select("event_id", "user_id", "ts", F.expr(_STATUS).alias("status"), (F.col("event_id") % n).alias("nth"))
    return O.followed(seen.join(own, "nth"), ["user_id"], ["ts", "event_id"], {"target": "url"})


def redirecting(rows):
    """(url, target): the latest redirect of each page."""
    return R.latest(rows.where("status LIKE '3%' AND target IS NOT NULL").select("url", "target", "ts", "event_id"), ["url"], "ts", "event_id").select("url", "target")


def home_moves(pages):
    """Hosts named m, blog or www that lead to the one without, where there is one."""
    hosts = pages.select(U.host("url").alias("host")).distinct()
    bare = F.regexp_replace("host", r"^(m|blog|www)\.", "")
    other = hosts.select(F.col("host").alias("bare"))
    return hosts, hosts.join(other, (bare == F.col("bare")) & (F.col("host") != F.col("bare"))).select("host", F.concat(F.lit("http://"), "bare", F.lit("/")).alias("target"))


def checked(spark, d, **tests):
    rows = written(looks(spark, d))
    last = R.latest(rows.select("url", "status", "ts", "event_id"), ["url"], "ts", "event_id")
    alive = last.select(U.match_key("url").alias("key"), (~F.col("status").startswith("4")).alias("alive"))
    finals = R.final_hosts(*home_moves(table(spark, d, "pages").select("url")))
    return R.verified(R.neighbors(redirecting(rows)), finals, alive, **tests)


@query("redir_neighbors", f"WITH {NEAR} SELECT url, near, k FROM nb")
def redir_neighbors(spark, d):
    """The redirecting URLs that each redirecting URL is compared with, in order."""
    own = R.neighbors(redirecting(looks(spark, d)), copies=written(table(spark, d, "pages").select("url")))
    return own.select("url", F.posexplode("near").alias("k", "n")).select("url", F.col("n.url").alias("near"), (F.col("k") + 1).cast("bigint").alias("k"))


@query("redir_checked", f"WITH {CHECKED} SELECT url, target, verdict FROM vd")
def redir_checked(spark, d):
    """Is a redirect's target the page's replacement? The first test that fails, or ok."""
    return checked(spark, d)


@query("redir_any", f"WITH {CHECKED}, va AS (SELECT pn.url, CASE WHEN verdict = 'other site' THEN verdict WHEN coalesce(ck.shared, false) THEN 'shared' WHEN NOT EXISTS (SELECT 1 FROM nb WHERE nb.url = pn.url AND nk <> ntk) THEN 'alone' ELSE 'ok' END AS verdict FROM pn JOIN vd USING (url) LEFT JOIN ck USING (url)) SELECT verdict, count(*) AS n FROM va GROUP BY 1")
def redir_any(spark, d):
    """Verdicts where the target need not work today and may be a part of the path, but a neighbour must have been checked."""
    return checked(spark, d, strict=False, need_neighbor=True, working=False).groupBy("verdict").agg(F.count("*").alias("n"))


#: A target's canonical URL is that without a query, if one of its forms has a query.
_ALIAS = CHECKED + """, cn AS (SELECT mk, min(regexp_replace(url, '[?#].*$', '')) AS canonical FROM o WHERE query <> '' GROUP BY 1),
al AS (SELECT vd.url, coalesce(canonical, vd.target) AS alias FROM vd JOIN o b ON b.url = vd.target LEFT JOIN cn ON cn.mk = b.mk WHERE verdict IN ('ok', 'homepage'))"""


def canonicals(spark, d):
    """What pages with a query would name as their canonical URL: themselves without it."""
    return table(spark, d, "pages").where(U.query("url") != "").select("url", F.regexp_replace("url", "[?#].*$", "").alias("canonical"))


@query("redir_alias", f"WITH {_ALIAS} SELECT url, alias FROM al WHERE NOT {_NA.format('alias')}")
def redir_alias(spark, d):
    """Replacements found in redirects, by the canonical URL of the target."""
    return R.aliases(checked(spark, d), canonicals(spark, d))


@query("redir_titles", f"WITH {CHECKED}, ti AS (SELECT url, CASE WHEN {TITLE} LIKE '%Wayback Machine%' THEN '' ELSE {TITLE} END AS title FROM pages) SELECT vd.url, a.title, b.title AS moved_title FROM vd JOIN ti a ON a.url = vd.url JOIN ti b ON b.url = vd.target WHERE verdict IN ('ok', 'homepage')")
def redir_titles(spark, d):
    """The title of a page, and that of the page that it was moved to."""
    t = table(spark, d, "pages").select("url", H.title("html").alias("title"))
    own = checked(spark, d).where("verdict IN ('ok', 'homepage')")
    return own.join(t, "url").join(t.select(F.col("url").alias("target"), F.col("title").alias("moved_title")), "target").select("url", "title", "moved_title")


@query("redir_same_site", f"WITH {CHECKED} SELECT url, target, verdict <> 'other site' AS same FROM vd")
def redir_same_site(spark, d):
    """Are the final hosts of a redirect's two sides of one site?"""
    pages = table(spark, d, "pages").select("url")
    finals = R.final_hosts(*home_moves(pages)).select("host", U.suffix_site("final").alias("site"))
    own = R.neighbors(redirecting(looks(spark, d))).select("url", "target")
    a, b = finals.select(F.col("host").alias("ha"), F.col("site").alias("a")), finals.select(F.col("host").alias("hb"), F.col("site").alias("b"))
    return own.join(a, U.host("url") == F.col("ha")).join(b, U.host("target") == F.col("hb")).select("url", "target", (F.col("a") == F.col("b")).alias("same"))
