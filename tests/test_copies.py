"""Queries against their SQL on tables as they grow: URLs that several pages have, large ids, titles that end in half an entity."""

import shutil

import pytest

from mendweave import catalog
from tests.conftest import SMALL
from tests.oracle import TABLES, assert_same, connect


@pytest.fixture(scope="module")
def grown(tmp_path_factory):
    """Every fifth page has the URL of the page five before it, every seventh a title cut within an entity; ids of events are shifted."""
    folder = str(tmp_path_factory.mktemp("grown"))
    con = connect(SMALL)
    for name in TABLES:
        shutil.copy(f"{SMALL}/{name}.parquet", f"{folder}/{name}.parquet")
    html = "CASE WHEN a.page_id % 7 = 0 THEN regexp_replace(a.html, '(?is)<title[^>]*>.*?</title>', '<title>cut &amp</title>') ELSE a.html END"
    con.execute(f"COPY (SELECT a.page_id, CASE WHEN a.page_id % 5 = 0 AND b.url IS NOT NULL THEN b.url ELSE a.url END AS url, {html} AS html FROM pages a LEFT JOIN pages b ON b.page_id = a.page_id - 5) TO '{folder}/pages.parquet'")
    con.execute(f"COPY (SELECT * REPLACE ((event_id + 300000)::BIGINT AS event_id) FROM events) TO '{folder}/events.parquet'")
    return folder


@pytest.mark.parametrize("name", ["cache_hits", "ledger_ttl", "search_canonical", "live_status", "cand_is_canonical", "infer_outcomes", "live_rules", "html_title_body", "link_paths", "redir_neighbors", "neigh_rank", "search_candidates"])
def test_query_equals_oracle_on_copies(spark, grown, name):
    con = connect(grown)
    assert con.execute("SELECT count(*) > count(DISTINCT url) FROM pages").fetchone()[0]
    assert_same(catalog.queries()[name](spark, grown).toPandas(), catalog.oracle_sql()[name], con)
