"""Cosines by packs: the same as by a join, with few and many known terms, several packs, stop words, and odd texts; and what is written."""

import random

import pytest
from pyspark.sql import functions as F

from mendweave import catalog
from mendweave.functions import text as X
from mendweave.operators import cosines
from mendweave.operators import similarity as S
from tests.conftest import SMALL


def texts(spark, n=60):
    rng = random.Random(n)
    words = [f"w{k}" for k in range(30)]
    rows = [(i, " ".join(rng.choices(words, range(30, 0, -1), k=rng.randint(1, 12)) + [f"own{i}"] * (i % 3))) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, ""), (n + 2, "the"), (n + 3, "w1 w1"), (n + 4, "w1")], "doc_id bigint, text string")


@pytest.mark.parametrize("queries,known,entries", [("doc_id % 3 = 0", 1 << 18, 1 << 21), ("doc_id % 3 = 0", 4, 40), ("true", 0, 100), ("doc_id < 0", 5, 50)])
def test_packs_equal_a_join(spark, queries, known, entries):
    docs = texts(spark)
    terms = S.term_counts(docs, "doc_id", X.words("text"), ("the",))
    weighted = S.weights(terms, S.idf(terms, docs.count()), "doc_id")
    joined = S.cosine(weighted.where(queries), weighted, "doc_id").collect()
    key = lambda r: (r["query"], r["doc"], round(r["cosine"], 9))
    own = cosines.packs(docs, "doc_id", X.words("text"), ("the",), queries, entries, known)
    best = S.top_matches(spark.createDataFrame(joined, "query bigint, doc bigint, cosine double"), 2)
    assert sorted(map(key, S.top_matches(cosines.best(own, 2), 2).collect())) == sorted(map(key, best.collect()))
    assert sorted(map(key, cosines.kept(own, lambda x, _, __: x >= 0.4).collect())) == sorted(key(r) for r in joined if r["cosine"] >= 0.4)


def test_terms_are_not_rows(spark):
    """Of 65 documents with over 300 terms, one row a pack is kept, and no more rows a query than tasks."""
    own = cosines.packs(texts(spark), "doc_id", X.words("text"), (), "true")
    assert own.rows.count() <= own.parts and own.rows.agg(F.sum(F.length("data"))).first()[0] < 60_000
    found = cosines.best(own, 1)
    assert found.groupBy("query").count().agg(F.max("count")).first()[0] <= cosines.TASKS * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["cand_separable", "cand_match_order", "text_cosine_pairs"])
def test_no_row_for_each_term(spark, monkeypatch, name):
    """What a query needs of documents' terms it gets without a table of them."""
    monkeypatch.setattr(S, "weights", None)
    assert catalog.queries()[name](spark, SMALL).count() >= 0


@pytest.mark.parametrize("name", ["cand_best_content", "text_similar_topn"])
def test_every_document_is_asked_for(spark, monkeypatch, name):
    monkeypatch.setattr(S, "weights", None)
    ids = {r["query"] for r in catalog.queries()[name](spark, SMALL).select("query").distinct().collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert len(ids) >= 0.9 * docs.count() and any(i % 50 for i in ids)
