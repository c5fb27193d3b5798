"""Pairs of queries and rows by blocks: the same as by a join, with several blocks, ties, groups and copies."""

import random

import pytest
from pyspark.sql import functions as F

from mendweave.operators import copies
from mendweave.operators import pairs as P
from mendweave.operators import similarity as S


def weights(spark, n=60):
    rng = random.Random(n)
    rows = [(i, f"t{t}", float(rng.randint(1, 3)), "ab"[i % 2]) for i in range(n) for t in rng.sample(range(25), rng.randint(1, 6))]
    return spark.createDataFrame(rows, "id bigint, term string, w double, g string")


@pytest.mark.parametrize("entries,cells,dense", [(1 << 21, 1 << 21, 512), (10, 40, 3), (25, 500, 0)])
def test_best_and_kept(spark, monkeypatch, entries, cells, dense):
    monkeypatch.setattr(P, "CELLS", cells)
    monkeypatch.setattr(P, "DENSE", dense)
    w = weights(spark)
    joined = S.cosine(w.where("id % 3 = 0"), w, "id").collect()
    found = P.best(P.gathered(w.where("id % 3 = 0"), "id"), P.gathered(w, "id"), 2, entries)
    key = lambda r: (r["query"], r["doc"], round(r["cosine"], 9))
    assert sorted(map(key, S.top_matches(found, 2).collect())) == sorted(map(key, S.top_matches(spark.createDataFrame(joined), 2).collect()))
    found = P.kept(P.gathered(w.where("id % 3 = 0"), "id"), P.gathered(w, "id"), lambda x, _, __: x >= 9, entries)
    assert sorted(map(key, found.collect())) == sorted(key(r) for r in joined if r["cosine"] >= 9)
    found = P.best(P.gathered(w.where("id % 3 = 0"), "id", "g"), P.gathered(w, "id", "g"), 60, entries)
    assert sorted(map(key, found.collect())) == sorted(key(r) for r in joined if r["query"] % 2 == r["doc"] % 2)
    assert P.best(P.gathered(w.where("id < 0"), "id"), P.gathered(w, "id"), 2).count() == 0


def test_no_row_for_each_pair(spark):
    """60 rows that all share a term are 1,200 pairs of 20 queries; a join would shuffle them all."""
    w = spark.createDataFrame([(i, "all", 1.0) for i in range(60)], "id bigint, term string, w double")
    assert S.best_cosine(w, "id % 3 = 0", "id", 1).count() <= 20 * w.rdd.getNumPartitions() * 4


def test_containing(spark):
    rows = spark.createDataFrame([(0, ["a", "b"]), (1, ["a"]), (2, ["a", "b", "c"]), (3, ["c", "d"]), (4, []), (5, ["a", "b"])], "id bigint, w array<string>")
    got = {tuple(r) for r in S.containing(rows, "id IN (0, 3, 4)", "id", "w").collect()}
    assert got == {(0, 1, 1), (0, 2, 2), (0, 5, 2)}
    assert S.containing(rows, "id = 2", "id", "w").select(F.sum("k")).first()[0] == 5


def test_near_duplicates_of_large_groups(spark):
    """Links of each text by brute force: a group of more near copies than a cell holds, a passage that many texts share, copies,
    texts of few words and of none. No pair's row holds shingles."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, common = [word() for _ in range(60)], [word() for _ in range(12)]
    texts = []
    for _ in range(copies.PART + 44):
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2])):
            own[rng.randrange(60)] = word()
        texts.append(" ".join(own))
    texts += [" ".join([word() for _ in range(10)] + common) for _ in range(40)] + ["one two", "One  two", "", None, "one two three"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in S.near_duplicates(frame, "doc_id", "text").collect()}
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    known = {}
    for i, w in enumerate(words):
        known.setdefault(tuple(w) if texts[i] is not None else None, i)
    for i, w in enumerate(words):
        k = known[tuple(w) if texts[i] is not None else None]
        links = sum(len(sets[k] & sets[j]) >= 0.8 * len(sets[k] | sets[j]) - 1e-9 for j in known.values() if j != k and sets[j] and sets[k])
        assert got[i] == (k, links), (i, got[i], k, links)


@pytest.mark.parametrize("entries,cells", [(1 << 21, 1 << 21), (30, 10)])
def test_nested_by_the_rarest_element(spark, monkeypatch, entries, cells):
    """Equal to brute force, with several blocks, equal sets and sets of one element; and pairs are not multiplied."""
    monkeypatch.setattr(P, "CELLS", cells)
    monkeypatch.setattr(P, "_met", None)
    rng = random.Random(2)
    sets = {i: set(rng.choices(range(14), range(14, 0, -1), k=rng.randint(1, 9))) for i in range(150)}
    own = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id bigint, h array<bigint>")
    got = sorted(tuple(r) for r in P.nested(own.where("id % 3 = 0"), own, entries).collect())
    assert got == sorted((i, j, len(sets[i] & sets[j])) for i in sets if i % 3 == 0 for j in sets if i != j and (sets[i] <= sets[j] or sets[j] <= sets[i]))
    words = spark.createDataFrame([(0, ["a", "b"]), (1, ["a"])], "id bigint, w array<string>")
    assert [tuple(r) for r in S.containing(words, "id = 0", "id", "w").collect()] == [(0, 1, 1)]
