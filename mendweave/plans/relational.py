"""Plain relational queries over the star schema: joins, aggregates, set operations, windows."""

from __future__ import annotations

from .common import F, Window, query, table


def _t(spark, d, *names):
    return [table(spark, d, n) for n in names]


@query("rel_pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def rel_pricing_summary(spark, d):
    (l,) = _t(spark, d, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return l.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(net), 2).alias("sum_disc"), F.round(F.sum(net * (1 + F.col("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("rel_shipping_priority", """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, strftime(o_orderdate, '%Y-%m-%d') AS o_date, o_orderpriority FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 3, 4 ORDER BY round(sum(l_extendedprice * (1 - l_discount)), 2) DESC, l_orderkey LIMIT 10""")
def rel_shipping_priority(spark, d):
    c, o, l = _t(spark, d, "customer", "orders", "lineitem")
    met = c.where("c_mktsegment = 'BUILDING'").join(o, F.col("c_custkey") == F.col("o_custkey")).join(l, F.col("l_orderkey") == F.col("o_orderkey"))
    sums = met.groupBy("l_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_date"), "o_orderpriority").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return sums.orderBy(F.desc("revenue"), "l_orderkey").limit(10)


@query("rel_region_volume", "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def rel_region_volume(spark, d):
    l, s, n, r = _t(spark, d, "lineitem", "supplier", "nation", "region")
    pre = l.groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))  # a row a supplier before the joins
    met = pre.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return met.groupBy("r_name", "n_name").agg(F.round(F.sum("v"), 2).alias("revenue"))


_KINDS = {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "full": "FULL JOIN"}


@query("rel_join_kinds", " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS n, count(c_custkey) AS n_left, count(o_orderkey) AS n_right FROM customer {j} orders ON c_custkey = o_custkey" for k, j in _KINDS.items()))
def rel_join_kinds(spark, d):
    c, o = _t(spark, d, "customer", "orders")
    out = [c.join(o, F.col("c_custkey") == F.col("o_custkey"), k).agg(F.count("*").alias("n"), F.count("c_custkey").alias("n_left"), F.count("o_orderkey").alias("n_right")).select(F.lit(k).alias("kind"), "n", "n_left", "n_right") for k in _KINDS]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query("rel_semi_anti", "SELECT c_mktsegment, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)) AS big, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders)) AS none FROM customer GROUP BY 1")
def rel_semi_anti(spark, d):
    c, o = _t(spark, d, "customer", "orders")
    big = c.join(o.where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("big"))
    none = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("none"))
    return c.select("c_mktsegment").distinct().join(big, "c_mktsegment", "left").join(none, "c_mktsegment", "left").select("c_mktsegment", F.coalesce("big", F.lit(0)).alias("big"), F.coalesce("none", F.lit(0)).alias("none"))


@query("rel_range_join", "SELECT a.event_id, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 2 HOURS GROUP BY 1")
def rel_range_join(spark, d):
    """Later events of the same user within two hours, by an equi-join on two-hour buckets."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    us = F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), F.col("ts"))
    b = e.withColumn("us", us).withColumn("bucket", F.floor(F.col("us") / 7_200_000_000))
    a = b.select("event_id", "user_id", F.col("us").alias("t0"), F.explode(F.array("bucket", F.col("bucket") + 1)).alias("bucket"))
    met = a.join(b.select("user_id", "us", "bucket"), ["user_id", "bucket"]).where("us > t0 AND us <= t0 + 7200000000")
    return met.groupBy("event_id").agg(F.count("*").alias("n"))


@query("rel_asof", "WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT * FROM events WHERE event_type = 'view') SELECT p.event_id, arg_max(v.event_id, (v.ts, v.event_id)) AS view_id FROM p JOIN v ON p.user_id = v.user_id AND v.ts <= p.ts GROUP BY 1")
def rel_asof(spark, d):
    """The last view before each purchase: one sorted pass over both, no join."""
    e = table(spark, d, "events").where("event_type IN ('purchase', 'view')")
    own = Window.partitionBy("user_id").orderBy("ts", F.expr("IF(event_type = 'view', 0, 1)"), "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(own)
    return e.withColumn("view_id", last).where("event_type = 'purchase' AND view_id IS NOT NULL").select("event_id", "view_id")


_GROUPED = "SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY {0}"


def _grouped(spark, d, how):
    (l,) = _t(spark, d, "lineitem")
    l.createOrReplaceTempView("mw_lineitem")
    return spark.sql(_GROUPED.format(how).replace("lineitem", "mw_lineitem"))


@query("rel_grouping_sets", _GROUPED.format("GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())"))
def rel_grouping_sets(spark, d):
    return _grouped(spark, d, "GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")


@query("rel_cube", _GROUPED.format("CUBE (l_returnflag, l_linestatus)"))
def rel_cube(spark, d):
    (l,) = _t(spark, d, "lineitem")
    return l.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty")).select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n", "qty")


@query("rel_rollup", _GROUPED.format("ROLLUP (l_returnflag, l_linestatus)"))
def rel_rollup(spark, d):
    (l,) = _t(spark, d, "lineitem")
    return l.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty")).select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n", "qty")


@query("rel_set_ops", "SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'except', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0) UNION ALL SELECT 'except_all', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)")
def rel_set_ops(spark, d):
    c, s = _t(spark, d, "customer", "supplier")
    a, b = c.select(F.col("c_nationkey").alias("k")), s.select(F.col("s_nationkey").alias("k"))
    ops = {"union": a.union(b).distinct(), "intersect": c.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).intersect(b), "except": a.subtract(s.where("s_acctbal > 0").select(F.col("s_nationkey").alias("k"))), "except_all": a.exceptAll(b)}
    out = [x.agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "n") for k, x in ops.items()]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query("rel_window_frames", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS rk, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS tile, coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), -1) AS prev FROM orders")
def rel_window_frames(spark, d):
    (o,) = _t(spark, d, "orders")
    own = Window.partitionBy("o_custkey")
    time = own.orderBy("o_orderdate", "o_orderkey")
    return o.select("o_orderkey", F.round(F.sum("o_totalprice").over(time.rowsBetween(-2, 0)), 2).alias("last3"), F.rank().over(own.orderBy(F.desc("o_totalprice"))).cast("bigint").alias("rk"), F.ntile(4).over(own.orderBy("o_orderkey")).cast("bigint").alias("tile"), F.coalesce(F.lag("o_orderkey").over(time), F.lit(-1)).alias("prev"))


@query("rel_topk", "WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) SELECT p_brand, p_partkey, k FROM r WHERE k <= 3")
def rel_topk(spark, d):
    (p,) = _t(spark, d, "part")
    k = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return p.select("p_brand", "p_partkey", k.cast("bigint").alias("k")).where("k <= 3")


@query("rel_distinct_aggs", "SELECT l_shipmode_ AS flag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, count(*) FILTER (l_quantity > 25) AS many, round(stddev_samp(l_quantity), 6) AS sd, round(median(l_quantity), 6) AS med FROM (SELECT *, l_returnflag AS l_shipmode_ FROM lineitem) GROUP BY 1")
def rel_distinct_aggs(spark, d):
    (l,) = _t(spark, d, "lineitem")
    return l.groupBy(F.col("l_returnflag").alias("flag")).agg(F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("l_partkey").alias("parts"), F.count_if(F.col("l_quantity") > 25).alias("many"), F.round(F.stddev_samp("l_quantity"), 6).alias("sd"), F.round(F.median("l_quantity"), 6).alias("med"))


@query("rel_pivot", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def rel_pivot(spark, d):
    (o,) = _t(spark, d, "orders")
    return o.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0).select("o_orderpriority", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("rel_mode", "SELECT user_id, arg_min(event_type, (-n, event_type)) AS event_type FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def rel_mode(spark, d):
    """The most common type of event of each user; of equals the first by name."""
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("n"), F.col("event_type"))).alias("event_type"))


@query("dialogue_turns", "SELECT conv_id, count(*) AS turns, max(turn) AS last_turn, arg_min(role, turn) AS opener, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY 1")
def dialogue_turns(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("turn").alias("last_turn"), F.min_by("role", "turn").alias("opener"), F.sum(F.length("text")).alias("n_chars"))


@query("dialogue_replies", "SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS to_role, coalesce(length(text) - lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS longer FROM conversations")
def dialogue_replies(spark, d):
    own = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.lag("role").over(own).alias("to_role"), F.coalesce(F.length("text") - F.lag(F.length("text")).over(own), F.lit(0)).cast("bigint").alias("longer"))


@query("label_rates", "SELECT lang, count(*) AS n, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def label_rates(spark, d):
    docs, labels = _t(spark, d, "documents", "labels")
    return docs.join(labels, "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"))
