"""Snapshot look-ups over events: a user is a URL, a click or sign-up a redirect, an error a broken snapshot."""

from __future__ import annotations

from mendweave.operators import snapshots as N

from .common import URLS, F, query, table

_STATUS = "CASE event_type WHEN 'view' THEN '200' WHEN 'purchase' THEN '200' WHEN 'click' THEN '301' WHEN 'signup' THEN '302' ELSE '404' END"
SNAPS = f"sn AS (SELECT event_id, user_id, ts, value, {_STATUS} AS status FROM events)"


def snaps(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "ts", "value", F.expr(_STATUS).alias("status"))


def wanted(spark, d):
    """The times to look up: those of every fiftieth event."""
    return snaps(spark, d).where("event_id % 50 = 0").select(F.col("event_id").alias("want_id"), "user_id", (F.col("ts") + F.expr("INTERVAL 3 HOURS")).alias("at"))


_ORDER = {
    "closest": "(abs(epoch_us(t0) - epoch_us(ts)), event_id)",
    "later": "((ts < t0)::INT, CASE WHEN ts >= t0 THEN epoch_us(ts) ELSE -epoch_us(ts) END, event_id)",
    "earlier": "((ts > t0)::INT, CASE WHEN ts <= t0 THEN -epoch_us(ts) ELSE epoch_us(ts) END, event_id)",
    "latest": "(-epoch_us(ts), event_id)",
    "earliest": "(epoch_us(ts), event_id)",
}


def _register(policy: str) -> None:
    sql = f"""WITH {SNAPS}, w AS (SELECT event_id AS want_id, user_id, ts + INTERVAL 3 HOURS AS t0 FROM sn WHERE event_id % 50 = 0)
SELECT want_id, arg_min(event_id, {_ORDER[policy]}) AS event_id FROM w JOIN sn USING (user_id) GROUP BY 1"""

    @query(f"snap_{policy}", sql)
    def run(spark, d):
        return N.as_of(wanted(spark, d), snaps(spark, d), "user_id", "at", "ts", "event_id", policy).select("want_id", "event_id")


for _policy in N.POLICIES:
    _register(_policy)


@query("snap_all", f"WITH {SNAPS} SELECT user_id, count(*) AS n, count(DISTINCT status) AS kinds FROM sn GROUP BY 1")
def snap_all(spark, d):
    return snaps(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("status").alias("kinds"))


@query("snap_collapse_day", f"WITH {SNAPS} SELECT user_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, arg_min(event_id, (ts, event_id)) AS event_id FROM sn GROUP BY 1, 2")
def snap_collapse_day(spark, d):
    return N.collapse(snaps(spark, d), "user_id", "ts", "event_id").select("user_id", F.date_format("unit", "yyyy-MM-dd").alias("day"), "event_id")


@query("snap_ts_arrays", f"WITH {SNAPS} SELECT user_id, count(*) FILTER (status LIKE '2%') AS n_ts, count(*) FILTER (status LIKE '2%' OR status LIKE '3%') AS n_nb, strftime(min(ts) FILTER (status LIKE '2%'), '%Y-%m-%d %H:%M:%S') AS first_ts FROM sn GROUP BY 1")
def snap_ts_arrays(spark, d):
    return N.ts_arrays(snaps(spark, d), "user_id", "ts", "status").select("user_id", F.size("ts").cast("bigint").alias("n_ts"), F.size("ts_nb").cast("bigint").alias("n_nb"), F.date_format(F.get("ts", 0), "yyyy-MM-dd HH:mm:ss").alias("first_ts"))


@query(
    "snap_rep",
    f"""WITH {SNAPS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, max(ts) OVER (PARTITION BY user_id) AS last FROM sn),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM r WHERE k <= 3 AND ts >= last - INTERVAL 180 DAYS)
SELECT user_id, event_id FROM t WHERE r = (n - 1) // 2 + 1""",
)
def snap_rep(spark, d):
    return N.representative(snaps(spark, d), "user_id", "ts", "value", "event_id")


@query("snap_monthly", f"WITH {SNAPS}, r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts, event_id) AS k FROM sn) SELECT user_id, event_id FROM r WHERE k = 1")
def snap_monthly(spark, d):
    return N.monthly(snaps(spark, d), "user_id", "ts", "event_id").select("user_id", "event_id")


@query(
    "snap_gap",
    f"""WITH RECURSIVE {SNAPS}, o AS (SELECT user_id, epoch_us(ts) // 1000000 AS s FROM sn), k AS (
  SELECT user_id, min(s) AS s FROM o GROUP BY 1 UNION ALL
  SELECT k.user_id, (SELECT min(o.s) FROM o WHERE o.user_id = k.user_id AND o.s >= k.s + 259200) FROM k WHERE k.s IS NOT NULL)
SELECT user_id, count(s) AS n, max(s)::BIGINT AS last FROM k GROUP BY 1""",
)
def snap_gap(spark, d):
    """Snapshots at least three days apart, kept greedily from the first."""
    sec = F.timestamp_diff("SECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), F.col("ts"))
    own = snaps(spark, d).groupBy("user_id").agg(N.thin(F.array_sort(F.collect_list(sec)), 259200).alias("kept"))
    return own.select("user_id", F.size("kept").cast("bigint").alias("n"), F.element_at("kept", -1).alias("last"))


@query("snap_before_break", f"WITH {SNAPS}, c AS (SELECT *, min(ts) FILTER (status = '404') OVER (PARTITION BY user_id) AS cut FROM sn) SELECT user_id, count(*) AS n FROM c WHERE cut IS NULL OR ts < cut GROUP BY 1")
def snap_before_break(spark, d):
    return N.before_break(snaps(spark, d), "user_id", "ts", F.col("status") == "404").groupBy("user_id").agg(F.count("*").alias("n"))


@query(
    "link_dropped",
    f"""WITH {SNAPS}, m AS (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS k FROM sn),
s AS (SELECT *, max((value > 50)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seen FROM m WHERE k = 1)
SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM s WHERE seen = 1 AND NOT value > 50 GROUP BY 1""",
)
def link_dropped(spark, d):
    return N.first_dropped(snaps(spark, d), "user_id", "ts", F.col("value") > 50, "event_id", "day")


@query(
    "redir_history",
    f"""WITH RECURSIVE {SNAPS}, o AS (SELECT user_id, epoch_us(ts) // 1000000 AS s FROM sn WHERE status LIKE '3%'), k AS (
  SELECT user_id, max(s) AS s FROM o GROUP BY 1 UNION ALL
  SELECT k.user_id, (SELECT max(o.s) FROM o WHERE o.user_id = k.user_id AND o.s < k.s - 432000) FROM k WHERE k.s IS NOT NULL)
SELECT user_id, count(s) AS n, min(s)::BIGINT AS oldest FROM k GROUP BY 1""",
)
def redir_history(spark, d):
    return N.redirects_back(snaps(spark, d), "user_id", "ts", "status", days=5)


@query("redir_latest", f"WITH {SNAPS} SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM sn GROUP BY 1 HAVING arg_max(status, (ts, event_id)) LIKE '3%'")
def redir_latest(spark, d):
    """URLs whose latest snapshot redirects."""
    last = snaps(spark, d).groupBy("user_id").agg(F.max_by(F.struct("event_id", "status"), F.struct("ts", "event_id")).alias("x"))
    return last.where(F.col("x.status").startswith("3")).select("user_id", "x.event_id")


@query("redir_shared_target", f"""WITH {SNAPS}, t AS (SELECT user_id, list_distinct(list(value::BIGINT) FILTER (status LIKE '3%')) AS targets FROM sn GROUP BY 1)
SELECT a.user_id, b.user_id AS neighbor, coalesce(list_has_any(a.targets, b.targets), false) AS shared FROM t a JOIN t b ON b.user_id = a.user_id + 1""")
def redir_shared_target(spark, d):
    own = snaps(spark, d).groupBy("user_id").agg(F.collect_set(F.when(F.col("status").startswith("3"), F.round("value").cast("bigint"))).alias("targets"))
    near = own.select(F.col("user_id").alias("neighbor"), F.col("targets").alias("near"))
    return N.shared_targets(own.join(near, F.col("neighbor") == F.col("user_id") + 1), "user_id", "neighbor", "targets", "near")


@query("snap_year_urls", f"WITH {SNAPS} SELECT strftime(ts, '%Y-%m') AS month, status, count(DISTINCT user_id) AS urls FROM sn WHERE status LIKE '2%' GROUP BY 1, 2")
def snap_year_urls(spark, d):
    own = snaps(spark, d).where(F.col("status").startswith("2"))
    return own.groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "status").agg(F.countDistinct("user_id").alias("urls"))


@query("snap_median_ts", f"WITH {SNAPS} SELECT user_id, quantile_cont(epoch_us(ts) / 1e6, 0.5) AS median FROM sn GROUP BY 1".replace("quantile_cont(epoch_us(ts) / 1e6, 0.5)", "round(quantile_cont(epoch_us(ts) / 1e6, 0.5), 3)"))
def snap_median_ts(spark, d):
    us = F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), F.col("ts"))
    return snaps(spark, d).groupBy("user_id").agg(F.round(F.percentile(us / 1e6, 0.5), 3).alias("median"))


@query("snap_prefixes", rf"""WITH {URLS}, {SNAPS}, n AS (SELECT page_id, bare || CASE WHEN lower(path) IN ('', '/') THEN '/' ELSE lower(path) END || CASE WHEN query = '' THEN '' WHEN len(pairs) > 0 THEN '?' || array_to_string(list_sort(list_transform(pairs, lambda x: lower(x))), '&') ELSE '?' || lower(query) END AS key, bare || lower(dir) AS section FROM s),
nn AS (SELECT *, row_number() OVER (ORDER BY page_id) - 1 AS nth FROM n), se AS (SELECT nn.*, sn.status FROM sn JOIN nn ON nn.nth = sn.event_id % (SELECT count(*) FROM pages)),
px AS (SELECT DISTINCT section AS prefix FROM n WHERE page_id % 50 = 0 UNION SELECT DISTINCT bare FROM s WHERE page_id % 50 = 0)
SELECT prefix, count(*) AS n, count(DISTINCT key) AS urls, count(*) FILTER (status LIKE '2%') AS good FROM se JOIN px ON starts_with(se.key, px.prefix) GROUP BY 1""")
def snap_prefixes(spark, d):
    """Snapshots below the sections and hosts of the targets (ids divisible by 50), found in one scan; an event is a look at a page."""
    from mendweave.functions import urls as U

    from .redirects import looks

    seen = looks(spark, d).select(N.url_key("url").alias("key"), "status")
    own = table(spark, d, "pages").where("page_id % 50 = 0")
    prefixes = own.select(F.concat(U.bare_host("url"), F.lower(U.nondigit_dir(U.path("url")))).alias("prefix")).union(own.select(U.bare_host("url")))
    found = N.under_prefixes(seen, prefixes)
    return found.groupBy("prefix").agg(F.count("*").alias("n"), F.countDistinct("key").alias("urls"), F.count_if(F.col("status").startswith("2")).alias("good"))
