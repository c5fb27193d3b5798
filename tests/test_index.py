"""Prefixes of many hosts in one scan, an index of which only the hosts' parts are read, and outcomes of inferred aliases."""

import random

from pyspark.sql import functions as F

from mendweave.functions import urls as U
from mendweave.operators import snapshots as N
from mendweave.operators import verify as V


def test_prefixes(spark, tmp_path):
    rng = random.Random(2)
    keys = [f"h{rng.randrange(30)}.com/{'/'.join(rng.choice('abc') for _ in range(rng.randrange(5)))}" for _ in range(400)]
    prefixes = sorted({k[: rng.randint(6, len(k))] for k in rng.sample(keys, 40)} | {keys[0], keys[0] + "x", "none"})
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id int, key string")
    frame = spark.createDataFrame([(p,) for p in prefixes], "prefix string")
    want = {(i, p) for i, k in enumerate(keys) for p in prefixes if k.startswith(p)}
    assert {(r["id"], r["prefix"]) for r in N.under_prefixes(rows, frame).collect()} == want
    assert N.under_prefixes(rows, frame.where("1 = 0")).count() == 0
    folder = str(tmp_path / "index")
    N.write_index(rows, folder, 8)
    whole = [f"h{k}.com/{x}" for k in (3, 4) for x in ("", "a/")]
    found = N.scan_index(spark, folder, spark.createDataFrame([(p,) for p in whole], "prefix string"), 8)
    assert {(r["id"], r["prefix"]) for r in found.collect()} == {(i, p) for i, k in enumerate(keys) for p in whole if k.startswith(p)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:80]


def test_inferred_outcomes(spark):
    cands = [("u1", "dead"), ("u2", "/"), ("u3", "new"), ("u4", "t"), ("u5", "c"), ("u6", "k"), ("u7", "n")]
    at = lambda x: f"http://h.com/{x.strip('/')}"
    pairs = spark.createDataFrame([(at(u), at(c)) for u, c in cands], "url string, cand string")
    alive = spark.createDataFrame([(at(c), c != "dead") for _, c in cands], "u string, alive boolean").select(U.match_key("u").alias("key"), "alive")
    known = pairs.where(F.col("url") != at("u3"))
    pick = lambda *names: pairs.where(F.col("url").isin([at(n) for n in names]))
    got = {r["url"][-2:]: r["outcome"] for r in V.inferred_outcome(pairs, alive, known, pick("u1", "u2", "u4"), pick("u4", "u5"), pick("u5", "u6")).collect()}
    assert got == {"u1": "none", "u2": "none", "u3": "nocomp_check", "u4": "title", "u5": "content", "u6": "token", "u7": "none"}
