"""Liveness over written probes, and ledgers over events."""

from __future__ import annotations

from mendweave.functions import urls as U
from mendweave.operators import ledger as L
from mendweave.operators import liveness as V

from .common import URLS, F, query, table
from .snapshots import SNAPS, snaps

@query("robots_allowed", f"WITH {URLS}, r AS (SELECT DISTINCT host, '/' || segs[1] || '/' AS disallow FROM s WHERE page_id % 10 = 0 AND len(segs) > 0) SELECT url, NOT EXISTS (SELECT 1 FROM r WHERE r.host = s.host AND starts_with(s.path, r.disallow)) AS allowed FROM s")
def robots_allowed(spark, d):
    """Which pages may be fetched, where each host forbids the first folders of its pages with an id divisible by 10."""
    own = table(spark, d, "pages").select("page_id", "url")
    first = F.get(U.segments(U.path("url")), 0)
    rules = own.where("page_id % 10 = 0").select(U.host("url").alias("host"), F.concat(F.lit("/"), first, F.lit("/")).alias("disallow")).where("disallow IS NOT NULL").distinct()
    return V.allowed(own.select("url"), rules)


_TURN = "substr('{0}', k::INT + 1) || left('{0}', k::INT)"
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


@query(
    "url_perturb",
    f"""WITH {URLS}, h AS (SELECT *, ('0x' || left(md5(url), 8))::BIGINT % 7 + 3 AS k FROM s)
SELECT page_id, url, scheme || '://' || host || regexp_replace(path, '[^/]*/?$', '') || translate(leaf, '{_LOWER}{_UPPER}{_DIGITS}', {_TURN.format(_LOWER)} || {_TURN.format(_UPPER)} || {_TURN.format(_DIGITS)}) AS sibling FROM h""",
)
def url_perturb(spark, d):
    return table(spark, d, "pages").select("page_id", "url", V.perturb("url").alias("sibling"))


_OLD, _NEW = "sn WHERE event_id % 2 = 0", "sn WHERE event_id % 3 = 0"


@query("ledger_upsert", f"WITH {SNAPS}, o AS (SELECT event_id, user_id, status FROM {_OLD}), n AS (SELECT event_id, user_id, status || 'x' AS status FROM {_NEW}) SELECT coalesce(n.event_id, o.event_id) AS event_id, coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.status, o.status) AS status FROM o FULL JOIN n ON o.event_id = n.event_id")
def ledger_upsert(spark, d):
    s = snaps(spark, d).select("event_id", "user_id", "status")
    return L.upsert(s.where("event_id % 2 = 0"), s.where("event_id % 3 = 0").withColumn("status", F.concat("status", F.lit("x"))), "event_id")


@query("ledger_insert_absent", f"WITH {SNAPS} SELECT event_id, status FROM {_OLD} UNION ALL SELECT event_id, status || 'x' FROM {_NEW} AND event_id % 2 <> 0")
def ledger_insert_absent(spark, d):
    s = snaps(spark, d).select("event_id", "status")
    return L.insert_absent(s.where("event_id % 2 = 0"), s.where("event_id % 3 = 0").withColumn("status", F.concat("status", F.lit("x"))), "event_id")


@query("ledger_anti", f"WITH {SNAPS} SELECT event_id FROM sn WHERE user_id NOT IN (SELECT user_id FROM sn WHERE status = '404' AND value > 90)")
def ledger_anti(spark, d):
    s = snaps(spark, d)
    return L.pending(s, s.where("status = '404' AND value > 90"), "user_id").select("event_id")


@query("ledger_latest", f"WITH {SNAPS} SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM sn GROUP BY 1")
def ledger_latest(spark, d):
    return L.latest(snaps(spark, d), ["user_id"], "ts", "event_id").select("user_id", "event_id")


@query("ledger_expire", f"WITH {SNAPS} SELECT event_id, CASE WHEN ts + INTERVAL 10 DAYS > TIMESTAMP '2024-01-20' THEN status END AS status FROM sn")
def ledger_expire(spark, d):
    s = snaps(spark, d).select("event_id", "status", (F.col("ts") + F.expr("INTERVAL 10 DAYS")).alias("expires"))
    return L.expire(s, F.lit("2024-01-20").cast("timestamp_ntz"), "expires", "status").select("event_id", "status")


@query("ledger_ttl", "SELECT event_id, strftime(ts + to_seconds(greatest(CASE WHEN event_id % 3 = 0 THEN event_id * 5000 ELSE 0 END, 2592000)), '%Y-%m-%d %H:%M:%S') AS expires FROM events")
def ledger_ttl(spark, d):
    """When pages expire; every third has a header with an age, the others forbid to store them."""
    header = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("public, max-age="), (F.col("event_id") * 5000).cast("string"))).otherwise("no-store")
    return snaps(spark, d).select("event_id", F.date_format(L.ttl("ts", header), "yyyy-MM-dd HH:mm:ss").alias("expires"))


@query("trace_merge", f"WITH {SNAPS} SELECT user_id, status AS name, arg_max(value, event_id) AS value FROM sn GROUP BY 1, 2")
def trace_merge(spark, d):
    return L.merge_traces(snaps(spark, d).withColumnRenamed("status", "name"), "user_id", "name", "value", "event_id")


@query("json_props", "SELECT event_id, (props::JSON->>'$.k')::BIGINT AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("json_roundtrip", "SELECT event_id, '{\"k\":' || (props::JSON->>'$.k') || '}' AS json FROM events")
def json_roundtrip(spark, d):
    return table(spark, d, "events").select("event_id", F.to_json(F.from_json("props", "k bigint")).alias("json"))


@query("sample_corpus", "SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR) LIMIT 100")
def sample_corpus(spark, d):
    """A sample that stays the same: the 100 documents with the smallest hash of their ids."""
    return table(spark, d, "documents").select("doc_id").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary"))).limit(100)


@query("sample_per_source", "WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR)) AS k FROM documents) SELECT source, doc_id FROM r WHERE k <= 5")
def sample_per_source(spark, d):
    from .common import Window

    k = F.row_number().over(Window.partitionBy("source").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary"))))
    return table(spark, d, "documents").select("source", "doc_id", k.alias("k")).where("k <= 5").drop("k")


@query("year_cells", f"WITH {SNAPS} SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM sn GROUP BY 1, 2 HAVING count(*) >= 3")
def year_cells(spark, d):
    return snaps(spark, d).groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")).where("n >= 3")
