"""The search for aliases: tables in which pages have the same URL, and what is done for targets alone."""

import duckdb

from mendweave import catalog
from mendweave.operators import similarity as S
from mendweave.plans import finder
from tests.conftest import LARGER, SMALL
from tests.oracle import TABLES, assert_same, connect


def test_credit_of_repeated_urls(spark, tmp_path):
    """A candidate counts for each pair of pages that have the two URLs."""
    for name in TABLES:
        if name != "pages":
            (tmp_path / f"{name}.parquet").symlink_to(f"{LARGER}/{name}.parquet")
    copies = "SELECT page_id + 1000 * k AS page_id, url, html FROM pages, range(3) t(k) WHERE k = 0 OR page_id % (k + 2) = 0"
    duckdb.connect().execute(f"COPY ({copies.replace('FROM pages', f"FROM '{LARGER}/pages.parquet'")}) TO '{tmp_path}/pages.parquet' (FORMAT parquet)")
    assert_same(catalog.queries()["find_aliases"](spark, str(tmp_path)).toPandas(), catalog.oracle_sql()["find_aliases"], connect(str(tmp_path)))


def test_weights_of_targets_alone(spark, monkeypatch):
    """The heaviest words are found for the targets, with counts of all pages."""
    seen, weights = [], S.weights
    monkeypatch.setattr(S, "weights", lambda terms, idfs, key: (seen.append(terms.where("page_id % 50 <> 0").count()), weights(terms, idfs, key))[1])
    finder.dead(spark, SMALL)
    assert seen == [0]
