"""Nulls, empty and long texts, repeated rows, empty tables and clashing names, for every operator."""

import pytest
from pyspark.sql import functions as F

from mendweave.llm import context_tree, cover_tree, decontaminate, language_mix, line_chunks, packing, quality, simhash, toxicity, url_model

LONG = "the quick brown fox jumps over the lazy dog and runs away\n" * 20_000
ROWS = [
    (1, "The quick brown fox.\nA second line of it here\nand a third line of some words", "en", "s", 5, 0.5, "x"),
    (1, "The quick brown fox.\nA second line of it here\nand a third line of some words", "en", "s", 5, 0.5, "x"),
    (2, None, "en", None, None, None, None),
    (3, "", None, "s", 0, 1.0, "y"),
    (4, "  \n\t \n", "de", "s", 3, 2.0, "z"),
    (5, "12345 !!! ???", "fr", "s", 3, 2.0, "z"),
    (None, "le chat est sur la table et il dort", "fr", "s", 3, 2.0, "z"),
    (None, "le chat est sur la table et il dort", "fr", "s", 3, 2.0, "z"),
    (6, LONG, "en", "s", len(LONG), 2.0, "z"),
    (7, "Ünïcödé ſtraße 中文 \U0001f642 \x00 zero", "de", "s", 3, 2.0, "z"),
    (8, "<|endoftext|> and <|STARTOFTEXT|>", "en", "s", 3, 2.0, "z"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, component_id string"
IDS = sorted((r[0] for r in ROWS), key=lambda x: (x is None, x))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (3, 0, None), (None, 1, 1), (6, 1, 0), (99, 1, 1)], "doc_id bigint, quality int, toxic int")


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=lambda x: (x is None, x))


def none(df):
    return df.where("1 = 0")


def test_language(docs):
    out = language_mix.identify(docs, docs, ["doc_id", "score"])
    rows = {r["doc_id"]: r for r in out.collect()}
    assert ids(out) == IDS
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (2, 3, 4, 5))
    assert rows[6]["lang_pred"] == "en" and rows[None]["lang_pred"] == "fr"
    assert {r["lang_pred"] for r in language_mix.identify(docs, none(docs), ["doc_id"]).collect()} == {"und"}
    assert language_mix.identify(none(docs), docs, ["doc_id"]).count() == 0


def test_quality(docs, labels):
    out = quality.classify(docs, labels, ["doc_id"])
    assert ids(out) == IDS and all(0 <= r["score"] <= 1 for r in out.collect())
    assert {r["score"] for r in quality.classify(docs, none(labels), ["doc_id"]).collect()} == {0.5}
    assert quality.classify(none(docs), labels, ["doc_id"]).count() == 0


def test_toxicity(docs, labels):
    out = toxicity.score_toxicity(docs, labels, ["doc_id"])
    assert ids(out) == IDS and all(0 <= r["score"] <= 1 for r in out.collect())
    assert max(r["score"] for r in toxicity.score_toxicity(docs, none(labels), ["doc_id"]).collect()) < 1e-6
    assert toxicity.score_toxicity(none(docs), labels, ["doc_id"]).count() == 0


def test_context_tree(docs):
    rows = context_tree.score_texts(docs, docs, ["doc_id", "score"]).collect()
    assert len(rows) == len(ROWS)
    assert all(r["score"] < 0 and r["n_tokens"] >= 1 and r["n_known"] == r["n_tokens"] for r in rows)
    empty = context_tree.score_texts(docs, none(docs), ["doc_id"]).collect()
    assert all(abs(r["bits_per_byte"] - 8) < 1e-6 and abs(r["base_score"]) < 1e-6 and r["n_known"] == 0 for r in empty)
    assert context_tree.score_texts(none(docs), docs, ["doc_id"]).count() == 0


def test_lines(docs):
    out = line_chunks.dedup_lines(docs.withColumn("n_removed", F.lit("old")))
    rows = out.collect()
    assert len(rows) == len(ROWS) and set(out.columns) == {*docs.columns, "n_removed"}
    assert [r["text"] for r in rows if r["doc_id"] == 2] == [None]
    assert [r["text"] for r in rows if r["doc_id"] == 1] == [ROWS[0][1]] * 2  # repeated rows are one document
    assert line_chunks.dedup_lines(none(docs)).count() == 0


def test_decontaminate(spark, docs):
    bench = spark.createDataFrame([(1, "quick brown fox"), (1, "quick brown fox"), (2, None), (3, ""), (None, "second line"), (4, "!!")], "item_id bigint, text string")
    rows = {r["doc_id"]: r for r in decontaminate.judged(decontaminate.find_items(docs, bench, ["doc_id"])).collect()}
    assert len(rows) == len({*IDS})
    assert rows[1]["items"] == [1] and rows[1]["n_hit"] == 5 and rows[1]["contaminated"]
    assert rows[6]["n_hit"] == 60_000 and rows[2]["n_words"] == 0 and not rows[2]["contaminated"]
    assert not any(r["contaminated"] for r in decontaminate.judged(decontaminate.find_items(docs, none(bench), ["doc_id"])).collect())
    assert decontaminate.find_items(none(docs), bench, ["doc_id"]).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "no scheme"), (None, "http://A.example.net"), (4, "http://x.example.net/en/1"), (4, "http://x.example.net/en/1"), (5, "https://b.org/fr/?q=://x")], "page_id bigint, url string")
    rows = url_model.judge(pages).collect()
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert len(rows) == 7
    assert got == {(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (None, "a.example.net", "", None, "allow"), (4, "x.example.net", "/en/1", "example.net/en/", "allow"), (5, "b.org", "/fr/", "org/fr/", "allow")}
    assert url_model.judge(none(pages)).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 0.0]), (9, []), (10, [1.0, 0.0, 0.0]), (11, [0.0, -1.0]), (3, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cover_tree.link(vectors).collect()}
    assert got[1] == (3, 1) and got[2] == (3, 1) and got[3] == (3, 1)
    assert all(got[i] == (0, i) for i in (4, 5, 6, 7, 8, 9, 10, 11)) and got[None] == (0, None)
    assert cover_tree.link(none(vectors)).count() == 0


def test_simhash(docs):
    rows = simhash.group(docs).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ROWS)
    assert by[2]["fp"] == by[3]["fp"] == by[4]["fp"] == 0 and by[4]["component_id"] == 2
    assert by[None]["component_id"] is None and by[6]["component_id"] == 6
    assert simhash.group(none(docs)).count() == 0


def test_packing(docs):
    rows = packing.pack_documents(docs, packing.tokenizer_path()).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] in (2, 3, 4)) == 3
    assert {r["doc_id"] for r in rows} == {*IDS}
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(none(docs), packing.tokenizer_path()).count() == 0


def test_pipeline_keeps_clashing_columns(spark, docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "of no text here")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for frame in (docs, none(docs)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, str(tmp_path))
            assert out.columns == docs.columns, name
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).collect()
