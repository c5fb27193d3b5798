"""Sources, sinks, ledgers' laws, inference and the entry module."""

import json
import os
import subprocess
import sys


from mendweave.operators import ledger as L
from mendweave.sources import tables as S
from tests.conftest import ROOT, SMALL


def test_jobs(spark, tmp_path):
    file = tmp_path / "jobs.json"
    file.write_text(json.dumps([{"netloc_dir": "a.com|", "urls": ["http://a.com/1", "http://a.com/2"]}, {"netloc_dir": "b.com|", "urls": []}]))
    assert sorted(map(tuple, S.jobs(spark, str(file)).collect())) == [("a.com|", "http://a.com/1"), ("a.com|", "http://a.com/2")]


def test_sheet_and_cdx(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Url,Title,Output\nhttp://a.com/1,One,x\nhttp://a.com/2,Two,\n")
    rows = S.sheet(spark, str(tmp_path / "s.csv")).collect()
    assert [(r["Title"], r["Output"]) for r in rows] == [("One", "x"), ("Two", None)]
    (tmp_path / "i.cdx").write_text("http://a.com/ 20100101000000 200 text/html\n")
    assert S.cdx(spark, str(tmp_path / "i.cdx")).first()["statuscode"] == "200"


def test_results(spark, tmp_path):
    found = spark.createDataFrame([("a.com|", "http://a.com/1", "T", "http://a.com/n", "title")], "netloc_dir string, url string, title string, alias string, reason string")
    S.write_results(found, str(tmp_path / "out"))
    row = spark.read.json(str(tmp_path / "out")).first()
    assert row["netloc_dir"] == "a.com|" and row["aliases"][0]["alias"] == "http://a.com/n"


def test_bucketed_table_joins_without_a_shuffle(spark):
    spark.sql("DROP TABLE IF EXISTS mw_orders")
    spark.sql("DROP TABLE IF EXISTS mw_lines")
    S.write_bucketed(S.table(spark, SMALL, "orders").select("o_orderkey", "o_totalprice"), "mw_orders", "o_orderkey", 4)
    S.write_bucketed(S.table(spark, SMALL, "lineitem").selectExpr("l_orderkey AS o_orderkey", "l_quantity"), "mw_lines", "o_orderkey", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("mw_orders").join(spark.table("mw_lines"), "o_orderkey")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE mw_orders")
        spark.sql("DROP TABLE mw_lines")
    assert S.duplicate_keys(S.table(spark, SMALL, "orders"), "o_orderkey").count() == 0


def test_upsert_twice_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "k int, x string, y int")
    new = spark.createDataFrame([(2, None, 6), (3, "c", 7)], "k int, x string, y int")
    once = L.upsert(old, new, "k")
    assert sorted(map(tuple, once.collect())) == [(1, "a", None), (2, "b", 6), (3, "c", 7)]
    assert sorted(map(tuple, L.upsert(once, new, "k").collect())) == sorted(map(tuple, once.collect()))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_data_operators(tmp_path):
    """The rest imports and lists its queries where the folder and the pipeline are missing."""
    for name in os.listdir(ROOT):
        if name in ("mendweave", "__spark_entry__.py"):
            subprocess.run(["cp", "-r", f"{ROOT}/{name}", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "mendweave" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'replacement_candidates' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
