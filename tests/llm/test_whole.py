"""Whole results: nothing that is left out for its size, place or rarity."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mendweave.llm import context_tree, near_copies, simhash, url_model


def brute_groups(ids, sets, least):
    label = dict(zip(ids, ids, strict=True))
    alike = [(i, j) for i in ids for j in ids if i < j and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]
    for _ in ids:
        for i, j in alike:
            label[i] = label[j] = min(label[i], label[j])
    return label


@pytest.mark.parametrize("late", [0, 1 << 18])
def test_near_copies(spark, monkeypatch, late):
    """Near copies at all similarities about 0.8, a passage that many texts share, and short, empty and null texts."""
    monkeypatch.setattr(near_copies, "SAMPLE", 1)
    monkeypatch.setattr(near_copies, "LATE", max(1, late))
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    common, texts = [word() for _ in range(12)], ["", None, "one two", "one  TWO", "one two three"]
    for _ in range(8):
        base = [word() for _ in range(100)] + common
        for k in range(9):
            copy = list(base)
            for at in rng.sample(range(100), k):
                copy[at] = word()
            texts.append(" ".join(copy))
    got = near_copies.group(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    words = [(t or "").lower().split() for t in texts]
    sets = {i: {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in enumerate(words)}
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_groups(list(range(len(texts))), sets, 0.8)


def test_pipeline_drops_near_copies(spark):
    """Two texts alike in over 0.8 of their five-word shingles, but not within two bits of each other."""
    import corpus_pipeline

    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    other = [*words[:60], "changed", *words[61:140], "again", *words[141:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(reversed(words)))], "doc_id bigint, text string")
    from mendweave.llm import simhash

    a, b = (simhash.fingerprint(" ".join(x).encode()) for x in (words, other))
    assert (a ^ b).bit_count() > 2
    assert sorted(r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()) == [1, 3]


def test_long_passages_all_go(spark):
    """No run of whole lines with more than 50 words that stands in an earlier text stays, of one line or of many."""
    import corpus_pipeline

    rng = random.Random(11)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    shapes = [[60], [51], [30, 30], [5, 51], [20, 20, 20], [13] * 4, [9] * 9, [50, 1], [50], [10, 10]]
    passages = [[line(n) for n in shape] for shape in shapes]
    rows = [(k, "\n".join(p)) for k, p in enumerate(passages)]
    rows += [(100 * c + k, "\n".join([line(7) for _ in range(c)] + p + [line(8) for _ in range(c % 3)])) for c in range(1, 6) for k, p in enumerate(passages)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"].split("\n") for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    texts = dict(rows)
    for k, (shape, passage) in enumerate(zip(shapes, passages, strict=True)):
        assert got[k] == passage
        for c in range(1, 6):
            left = got[100 * c + k]
            own = [x for x in texts[100 * c + k].split("\n") if x not in passage]
            assert [x for x in left if x not in passage] == own
            if sum(shape) > 50:
                assert left == (own or [""]), (shape, c)
            if len(shape) == 1 and shape[0] <= 50:
                assert passage[0] in left


def test_url_scores_at_every_share(spark):
    """Rare substrings enter the scores too, however few may be broadcast."""
    rng = random.Random(4)
    urls = [("".join(rng.choice("abcdef/12.") for _ in range(rng.randrange(5, 25))), k % 2 == 0) for k in range(60)]
    labelled = spark.createDataFrame(urls, "text string, good boolean").dropDuplicates(["text"])
    texts = spark.createDataFrame([(t,) for t, _ in urls[:30]] + [("xyz/none",)], "text string").distinct()
    whole, part = ({r["text"]: r["score"] for r in url_model.score(texts, url_model.fit(labelled, share=share)).collect()} for share in (17, 3))
    assert whole.keys() == part.keys() and all(abs(whole[t] - part[t]) < 1e-8 for t in whole)


def test_decontamination_tables_stay_small():
    """Memory of the tables of a block as large as one may be, against its text."""
    import subprocess
    import sys

    from tests.conftest import ROOT

    code = """
import random
from mendweave.llm import decontaminate as d
rng = random.Random(1)
words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(20000)]
items = [(i, " ".join(rng.choices(words, k=100))) for i in range(d.PASS_BYTES // 650)]
size = sum(len(t) for _, t in items) / 2**20
def rss():
    return int(next(x for x in open("/proc/self/status") if x.startswith("VmRSS")).split()[1]) / 1024
before = rss()
tables = d._tables(type("B", (), {"value": items}), "x", 13)
from mendweave.llm.common import tidy
tidy()
assert rss() - before < 20 * size + 20, (rss() - before, size)
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=300)


def test_decontamination_of_a_large_benchmark(spark):
    """A benchmark of many blocks: every planted window is found, and the items that share one are all named."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 9))) for _ in range(5000)]
    items = [(i, " ".join(rng.choices(words, k=60))) for i in range(3000)]
    items += [(10_000 + i, items[i][1]) for i in range(5)]
    docs = [(i, " ".join(rng.choices(words, k=30) + items[i][1].split()[7 : 7 + 13] + rng.choices(words, k=30))) for i in range(0, 3000, 37)] + [(-1, " ".join(rng.choices(words, k=900)))]
    from mendweave.llm import decontaminate

    frames = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {r["doc_id"]: r for r in decontaminate.find_items(*frames, ["doc_id"], pass_bytes=200_000).collect()}
    assert got.keys() == {i for i, _ in docs} and got[-1]["items"] == []
    for i, _ in docs[:-1]:
        assert set(got[i]["items"]) == {i} | ({10_000 + i} if i < 5 else set()) and (got[i]["hit_start"], got[i]["hit_end"]) == ([30], [43])


def test_one_of_each_group_whatever_its_ids(spark):
    """Near copies with one id, with none, and with some: one row of each group stays."""
    import corpus_pipeline

    rng = random.Random(5)
    base = [["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(120)] for _ in range(5)]
    near = lambda w: " ".join([*w[:60], "changed", *w[61:]])
    rows = [(1, " ".join(base[0])), (1, near(base[0])), (None, " ".join(base[1])), (None, near(base[1])), (None, " ".join(base[2])), (7, near(base[2])), (3, " ".join(base[3])), (3, " ".join(base[3])), (3, " ".join(base[4]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()]
    of = sorted((next(k for k, w in enumerate(base) if w[0] in t), i is None, i) for i, t in got)
    assert [(k, i) for k, _, i in of] == [(0, 1), (1, None), (2, 7), (3, 3), (4, 3)]


def test_pipeline_from_end_to_end(spark, tmp_path):
    """Each stage drops what it is there for, and what is left is packed whole."""
    import corpus_pipeline
    from mendweave.llm.packing import tokenizer_path
    from tokenizers import Tokenizer

    rng = random.Random(8)
    words = {k: ["".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(300)] for k, letters in (("en", "abcdefghi"), ("fr", "klmnopqrs"))}
    prose = lambda k, n: "\n".join(" ".join(rng.choice(words[k]) for _ in range(12)) for _ in range(n))
    texts = {i: (prose(k, 12), k) for i in range(40) for k in ["en" if i % 2 else "fr"]}
    passage, item = prose("en", 6), prose("en", 4)
    texts |= {100: ("12345 !!! 67", None), 101: (None, "en"), 102: (passage + "\n" + prose("en", 9), "en"), 103: (prose("en", 9) + "\n" + passage, "en")}
    texts |= {104: (texts[1][0] + " tail", "en"), 105: (item + "\n" + prose("en", 5), "en")}
    spark.createDataFrame([(i, t, k, "s", len(t or "")) for i, (t, k) in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("q", item.replace("\n", " "))], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {*texts} - {*left["language_id"]} == {100, 101}
    assert {*left["line_dedup"]} == {*left["language_id"]} and passage in left["line_dedup"][102] and passage.split("\n")[2] not in left["line_dedup"][103]
    assert {*left["line_dedup"]} - {*left["simhash_near_dedup"]} <= {1, 104} and len(left["line_dedup"]) - len(left["simhash_near_dedup"]) in (0, 1)
    assert {*left["simhash_near_dedup"]} - {*left["benchmark_decontamination"]} == {105}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = Tokenizer.from_file(tokenizer_path())
    want = {i: len(tokens.encode(t, add_special_tokens=False).ids) + 1 for i, t in left["benchmark_decontamination"].items()}
    got = {}
    for r in packed:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want
    assert len({r["sequence_id"] for r in packed}) == -(-sum(want.values()) // 4096)


def test_many_languages(spark):
    """Two hundred languages: the rarest is learned too, mixtures of several are told, and likelihoods are looked up in parts."""
    from mendweave.llm import language_mix

    rng = random.Random(12)
    names = [f"l{k:03d}" for k in range(200)]
    vocabulary = {x: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 7))) for _ in range(40)] for x in names}
    prose = lambda x, n: " ".join(rng.choice(vocabulary[x]) for _ in range(n))
    train = spark.createDataFrame([(prose(x, 150), x) for i, x in enumerate(names) for _ in range(1 if i % 7 else 3)], "text string, lang string")
    docs = [(i, prose(x, 60)) for i, x in enumerate(names)] + [(1000, prose("l003", 120) + " " + prose("l150", 80)), (1001, " ".join(prose(x, 60) for x in names[:5]))]
    rows = {r["doc_id"]: r for r in language_mix.identify(spark.createDataFrame(docs, "doc_id bigint, text string"), train, ["doc_id"]).collect()}
    assert [rows[i]["lang_pred"] for i in range(200)] == names
    assert rows[1000]["languages"] == ["l003", "l150"] and abs(rows[1000]["score"] - 0.6) < 0.1
    assert sorted(rows[1001]["languages"][:5]) == names[:5]


def test_word_logs_in_parts(monkeypatch):
    import numpy as np

    from mendweave.llm import language_mix

    rng = np.random.default_rng(3)
    table = np.where(rng.random((1 << language_mix.BITS, 3)) < 1e-3, rng.normal(-3, 1, (1 << language_mix.BITS, 3)), np.nan).astype(np.float32)
    slot, lang = np.nonzero(~np.isnan(table))
    model = {"langs": ["a", "b", "c"], "first": np.searchsorted(slot, np.arange((1 << language_mix.BITS) + 1)), "lang": lang.astype(np.int32), "logp": table[slot, lang], "rest": np.array([-9, -8, -7], np.float32)}
    slots = np.where(rng.random(500) < 0.5, slot[rng.integers(0, len(slot), 500)], rng.integers(0, 1 << language_mix.BITS, 500))
    bounds = np.concatenate(([0], np.sort(rng.choice(np.arange(1, 500), 80, replace=False)), [500]))
    want = np.add.reduceat(np.where(np.isnan(table[slots]), model["rest"], table[slots]), bounds[:-1], axis=0)
    for cells in (1, 30, 1 << 22):
        monkeypatch.setattr(language_mix, "CELLS", cells)
        assert np.allclose(language_mix.word_logs(model, slots, bounds), want, atol=1e-3)


def test_simhash_components_of_documents(spark):
    """The query's fingerprints and components on whole tables, against all pairs."""
    import xxhash

    from mendweave.llm import simhash
    from tests.conftest import SMALL

    def plain(text):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        parts = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))

    docs = {r["doc_id"]: plain(r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    label = {i: i for i in docs}
    pairs = [(i, j) for i in docs for j in docs if i < j and (docs[i] ^ docs[j]).bit_count() <= 2]
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            low = min(label[i], label[j])
            changed |= (label[i], label[j]) != (low, low)
            label[i] = label[j] = low
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op9_simhash(spark, SMALL).collect()}
    assert got == {i: (f"{docs[i]:016x}", label[i]) for i in docs}


def test_context_tree_keeps_rare_contexts(spark):
    """Over several buckets and blocks, the score is that of a tree of all contexts, built at once."""
    rng, depth = random.Random(8), context_tree.DEPTH
    texts = ["".join(rng.choice("abcde é\n") for _ in range(rng.choice([0, 1, 5, 900]))) for _ in range(40)] + [None, "A"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    learn = F.col("doc_id") % 3 != 0
    got = {r["doc_id"]: r["score"] for r in context_tree.scored(frame, learn, F.lit(True), ["doc_id"], buckets=5).collect()}
    apart = {r["doc_id"]: r["score"] for r in context_tree.score_texts(frame, frame.where(learn), ["doc_id"], buckets=2).collect()}

    def keys(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        return context_tree.grams(data, np.array([0, len(data)]), 0, 1, depth)[0]

    all_keys = np.concatenate([keys(t) for i, t in enumerate(texts) if i % 3])
    model = context_tree.build(context_tree.depths(*np.unique(all_keys, return_counts=True), 0, depth))
    assert len(model[depth]["ctx"]) > 2000  # most of them occur once
    for i, t in enumerate(texts):
        want = context_tree.log_probabilities(keys(t), model).sum()
        assert abs(got[i] - want) < 1e-9 * max(1, abs(want)) and abs(apart[i] - want) < 1e-9 * max(1, abs(want))


def test_pipeline_links_by_simhash_and_by_sets(spark):
    """Fingerprints within two bits link texts whose sets are less alike than 0.8; sets that are, link others; chains of both are one group."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    apart = lambda x, y: (simhash.fingerprint(" ".join(x).encode()) ^ simhash.fingerprint(" ".join(y).encode())).bit_count()
    share = lambda x, y: (lambda a, b: len(a & b) / len(a | b))(*({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (x, y)))
    base = [word() for _ in range(300)]

    def changed(places, fits):
        while True:
            own = list(base)
            for k in places:
                own[k] = word()
            if fits(own):
                return own

    by_print = changed(range(20, 300, 35), lambda x: apart(base, x) <= 2)
    by_set = changed(range(10, 300, 50), lambda x: apart(base, x) > 2 and apart(by_print, x) > 2)
    assert share(base, by_print) < 0.8 <= share(base, by_set) and share(by_print, by_set) < 0.8
    other = [word() for _ in range(300)]
    rows = [(5, " ".join(by_print)), (6, " ".join(base)), (7, " ".join(by_set)), (8, " ".join(other)), (None, " ".join(other))]
    got = corpus_pipeline.simhash_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    assert sorted(r["doc_id"] for r in got.collect()) == [5, 8]
