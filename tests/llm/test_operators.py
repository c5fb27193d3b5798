"""Operators against brute force, exact round trips and held-out rows."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash

from mendweave.llm import cover_tree, decontaminate, language_mix, line_chunks, packing, quality, simhash, toxicity, url_model
from mendweave.llm import context_tree as ctw

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{DATA}/documents.parquet").set_index("doc_id")


@pytest.fixture(scope="module")
def labels():
    return pd.read_parquet(f"{DATA}/labels.parquet").set_index("doc_id")


def low(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


def test_languages_of_held_out_rows(spark, documents):
    got = language_mix.op1_language_mix(spark, DATA).toPandas().set_index("doc_id").join(documents)
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.index]).all()
    assert (got.lang_pred == got.lang)[got.held_out].mean() > 0.98


def test_mixtures(spark, documents):
    en = " ".join(documents[documents.lang == "en"].text.str[:600].head(4))
    de = " ".join(documents[documents.lang == "de"].text.str[:600].head(4))
    frame = spark.createDataFrame([(1, f"{en} {de}", None), (2, en, None)], "doc_id bigint, text string, lang string")
    train = spark.createDataFrame(documents.reset_index()[["doc_id", "text", "lang"]])
    rows = {r["doc_id"]: r for r in language_mix.identify(frame, train, ["doc_id"]).collect()}
    assert sorted(rows[1]["languages"]) == ["de", "en"] and rows[2]["languages"] == ["en"]
    assert 0.35 < rows[1]["score"] < 0.65


def test_expectation_maximisation_finds_the_best_proportions():
    rng = np.random.default_rng(0)
    like = rng.uniform(0.01, 1, (200, 2))
    mix, gained = language_mix._em(like, np.array([0, 200]), np.full((1, 2), 0.5), 500)
    best = max((np.log(like @ [p, 1 - p]).sum(), p) for p in np.linspace(0, 1, 1001))
    assert abs(gained[0] - best[0]) < 0.05 and abs(mix[0, 0] - best[1]) < 0.05


def test_quality_of_held_out_rows(spark, labels):
    got = quality.op2_quality(spark, DATA).toPandas().set_index("doc_id").join(labels, how="inner")
    held = got[got.held_out]
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    assert np.mean([g > b for g in good for b in bad]) > 0.95  # area under the curve


def test_toxicity_of_held_out_rows(spark):
    labels = pd.read_parquet("/root/testdata/sf0.1/labels.parquet").set_index("doc_id")
    got = toxicity.op7_toxicity(spark, "/root/testdata/sf0.1").toPandas().set_index("doc_id").join(labels, how="inner")
    held = got[got.held_out]
    caught, right = (held.predicted[held.toxic == 1] == 1).mean(), (held.toxic[held.predicted == 1] == 1).mean()
    assert caught >= 0.9 and right >= 0.9


def test_folding_and_exceptions():
    assert toxicity.fold("1D10T, ѕtuріd fool!") == " idiot stupid fool "
    machine = toxicity.automaton({" trash ": 2.0, " idio": 3.0}, ("trash can",))
    found = lambda t: [m[2] for m in toxicity.matches(machine, toxicity.fold(t))]
    assert found("The trash can is full") == []
    assert found("You trash! idiotic") == [" trash ", " idio"]


def test_context_tree_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    rows, depth = [], 2
    text = rng.choice(list(b"abcab \xff"), 3000).astype(np.uint64)
    for d in range(depth + 1):
        ctx = np.zeros(len(text) - depth, np.uint64)
        for k in range(d, 0, -1):
            ctx = (ctx << np.uint64(8)) | text[depth - k : len(text) - k]
        pairs = collections.Counter(zip(ctx.tolist(), text[depth:].tolist(), strict=True))
        total = collections.Counter(ctx.tolist())
        kept = sorted((c, b, n) for (c, b), n in pairs.items() if total[c] >= 60)
        rows.append((np.array([x[0] for x in kept], np.uint64), np.array([x[1] for x in kept], np.uint64), np.array([x[2] for x in kept], float)))
    model = ctw.build(rows)
    for context in (b"ab", b"zz", b"\xff\xff", b"a "):
        keys = np.array([(int.from_bytes(context, "big") << 8) | b for b in range(256)], np.uint64)
        assert abs((10 ** ctw.log_probabilities(keys, model)).sum() - 1) < 1e-9


def test_context_tree_weights_of_one_binary_tree():
    """A source of two symbols that differ in one bit: the mixture by direct recursion over block probabilities."""
    rng = random.Random(3)
    text = [0x61]
    for _ in range(400):
        text.append(0x60 if rng.random() < (0.9 if text[-1] == 0x61 else 0.2) else 0x61)
    counts = collections.Counter(zip(text[:-1], text[1:], strict=True))
    rows0 = sorted(collections.Counter(text[1:]).items())
    rows1 = sorted((c, b, n) for (c, b), n in counts.items())
    model = ctw.build([(np.zeros(len(rows0), np.uint64), np.array([b for b, _ in rows0], np.uint64), np.array([n for _, n in rows0], float)), tuple(np.array([r[i] for r in rows1], t) for i, t in enumerate((np.uint64, np.uint64, float)))])

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    zero, one = dict(rows0)[0x60], dict(rows0)[0x61]
    leaf, split = kt(zero, one), sum(kt(counts[c, 0x60], counts[c, 0x61]) for c in (0x60, 0x61))
    stop = 1 / (1 + math.exp(split - leaf))
    want = stop * (one + 0.5) / (zero + one + 1) + (1 - stop) * (counts[0x60, 0x61] + 0.5) / (counts[0x60, 0x60] + counts[0x60, 0x61] + 1)
    got = [10 ** ctw.log_probabilities(np.array([(0x60 << 8) | b], np.uint64), model)[0] for b in (0x60, 0x61)]
    assert abs(got[1] / (got[0] + got[1]) - want) < 1e-9


def test_context_tree_base(spark, documents):
    got = ctw.op3_context_tree(spark, DATA).toPandas().set_index("doc_id")
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", low(t)) + [None] for i, t in documents.text.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in words}
    counts = collections.Counter(itertools.chain.from_iterable(w for i, w in words.items() if not held[i]))
    n, v = sum(counts.values()), len(counts)
    for i, w in words.items():
        r = got.loc[i]
        want = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert r.held_out == held[i] and r.n_tokens == len(w) and r.train_tokens == n and r.n_known == sum(counts[x] > 0 for x in w)
        assert abs(r.base_score - want) < 1e-6 * abs(want)
    assert got.score[got.held_out].sum() / got.n_symbols[got.held_out].sum() / math.log10(2) > -2.5


def chunks(lines, window, every, seed):
    """Chunks by the same rule, cut in Python (Spark's hash of longs, from its definition)."""

    def of_long(value, seed):
        return xxhash.xxh64_intdigest((value & (2**64 - 1)).to_bytes(8, "little"), seed)

    def signed(x):
        return x - 2**64 if x >= 2**63 else x

    hashes = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in lines]
    out, start = [], 0
    for i in range(1, len(lines) + 1):
        cut = i == len(lines)
        if not cut and i >= window:
            h = 42
            for k in range(window, 0, -1):
                h = of_long(hashes[i - k], h)
            h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), h)
            cut = signed(h) % every == 0
        if cut:
            out.append((start, i))
            start = i
    return out


def runs(counts, most):
    """The shortest runs of more than ``most`` words that begin and that end with each line that has words."""
    out = set()
    for i in (k for k, n in enumerate(counts) if n):
        stop = next((j for j in range(i + 1, len(counts) + 1) if sum(counts[i:j]) > most), None)
        start = next((j for j in range(i, -1, -1) if sum(counts[j : i + 1]) > most), None)
        out |= ({(i, stop)} if stop else set()) | ({(start, i + 1)} if start is not None else set())
    return out


def test_line_chunks(spark, documents):
    got = line_chunks.op4_line_chunks(spark, DATA).toPandas().set_index("doc_id")
    places = collections.defaultdict(list)
    lines = {i: t.split("\n") for i, t in documents.text.items()}
    for i, own in lines.items():
        found = set()
        for seed, window in enumerate(line_chunks.WINDOWS):
            found.update(chunks(own, window, line_chunks.EVERY, seed))
        counts = [len([w for w in x.split(" ") if w]) for x in own]
        for a, b in {(a, b) for a, b in found if b - a >= 2} | runs(counts, line_chunks.PASSAGE):
            if sum(counts[a:b]) >= line_chunks.WORDS:
                places[tuple(own[a:b])].append((i, a))
    gone = collections.defaultdict(set)
    for key, where in places.items():
        for i, a in sorted(where, key=lambda p: (p[0], p[1]))[1:]:
            gone[i].update(range(a, a + len(key)))
    for i, own in lines.items():
        assert got.loc[i].text == "\n".join(x for k, x in enumerate(own) if k not in gone[i]), i
    assert {x for own in lines.values() for x in own} <= {x for t in got.text for x in t.split("\n")}


def test_passages_shift_resistant(spark):
    """Of ten passages in twelve documents each, at shifting places, most lines go from all but the first."""
    rng = random.Random(5)
    line = lambda: " ".join(rng.choice("alpha beta gamma delta rho tau pi mu nu xi".split()) for _ in range(9))
    passages = [[line() for _ in range(12)] for _ in range(10)]
    rows = [(12 * p + i, "\n".join([line() for _ in range(i % 5)] + passage + [line() for _ in range(3)])) for p, passage in enumerate(passages) for i in range(12)]
    got = {r["doc_id"]: r["text"] for r in line_chunks.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    left = sum(x in got[12 * p + i] for p, passage in enumerate(passages) for i in range(1, 12) for x in passage)
    assert left < 0.25 * 10 * 11 * 12
    assert all(x in got[12 * p] for p, passage in enumerate(passages) for x in passage)


def test_decontamination_in_blocks(spark, documents):
    docs = spark.createDataFrame(documents.reset_index()[["doc_id", "text"]].head(300))
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").unionByName(spark.createDataFrame([(900, "the"), (901, "of the")], "item_id bigint, text string"))
    one = decontaminate.judged(decontaminate.find_items(docs, bench, ["doc_id"])).toPandas().set_index("doc_id").sort_index()
    many = decontaminate.judged(decontaminate.find_items(docs, bench, ["doc_id"], pass_bytes=3000)).toPandas().set_index("doc_id").sort_index()
    assert (one.n_hit == many.n_hit).all() and (one.items_sha256 == many.items_sha256).all()
    items = {r["item_id"]: decontaminate.words(r["text"]) for r in bench.collect()}
    for i, text in documents.text.head(300).items():
        own, hit, ids = decontaminate.words(text), set(), set()
        at = collections.defaultdict(list)
        for k, w in enumerate(own):
            at[w].append(k)
        for item, w in items.items():
            for s in range(max(1, len(w) - 12)):
                win = w[s : s + 13]
                for k in at[win[0]]:
                    if own[k : k + len(win)] == win:
                        hit.update(range(k, k + len(win)))
                        ids.add(item)
        assert one.loc[i].n_hit == len(hit) and sorted(map(str, one.loc[i]["items"])) == sorted(map(str, ids))


def test_url_scores(spark):
    """The table's telescoped sums are the log ratios of the longest context seen."""
    rng = random.Random(2)
    rows = [("".join(rng.choice("ab/") for _ in range(8)), rng.random() < 0.5) for _ in range(60)]
    texts = spark.createDataFrame(sorted(set(rows)), "text string, good boolean").dropDuplicates(["text"])
    own = {r["text"]: r["good"] for r in texts.collect()}
    got = {r["text"]: r["score"] for r in url_model.score(texts.select("text"), url_model.fit(texts)).collect()}
    k_max, counts = url_model.ORDER, [collections.Counter(), collections.Counter()]
    grams = lambda t: [(k, p[i - k : i + 1]) for p in ["^" * k_max + t + "$"] for i in range(k_max, len(p)) for k in range(k_max + 1)]
    for t, good in own.items():
        counts[good].update(grams(t))
    seen = [collections.Counter(), collections.Counter()]
    for g in (0, 1):
        for (k, s), n in counts[g].items():
            seen[g][k, s[:-1]] += n

    def p(g, k, s):
        lower = 1 / url_model.ALPHABET if k == 0 else p(g, k - 1, s[1:])
        return (counts[g][k, s] + url_model.WEIGHT * lower) / (seen[g][k, s[:-1]] + url_model.WEIGHT)

    for t in own:
        padded, total = "^" * k_max + t + "$", 0.0
        for i in range(k_max, len(padded)):
            k = max(k for k in range(k_max + 1) if counts[0][k, padded[i - k : i + 1]] + counts[1][k, padded[i - k : i + 1]])
            total += math.log(p(1, k, padded[i - k : i + 1]) / p(0, k, padded[i - k : i + 1]))
        assert abs(got[t] - total / (len(t) + 1)) < 1e-6


@pytest.mark.parametrize("dims", [2, 5, 16])
def test_cover_tree(dims):
    rng = np.random.default_rng(dims)
    base = rng.normal(size=(150, dims))
    tight = base[:1] + 0.05 * rng.normal(size=(120, dims))
    points = cover_tree.unit(np.concatenate([base, tight, 3 * base[:5], base[7:8] + 0.3 * rng.normal(size=(60, dims))]))
    other = cover_tree.unit(np.concatenate([tight[:40] + 0.02, rng.normal(size=(50, dims))]))
    a, b = cover_tree.Tree(points, 0.05), cover_tree.Tree(other, 0.05)
    x, y = points[a.order], other[b.order]
    n_a, n_b = rng.integers(1, 4, len(x)), rng.integers(1, 4, len(y))
    near = x @ y.T >= 0.9
    count_a, count_b, _ = cover_tree.linked(x, a, n_a, y, b, n_b, False)
    assert (count_a == near @ n_b).all() and (count_b == near.T @ n_a).all()
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    count, _, label = cover_tree.linked(x, a, n_a, x, a, n_a, True)
    assert (count == near @ n_a).all()
    want = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min(want[i], want[near[i]].min() if near[i].any() else want[i]) for i in range(len(x))])
        if (new == want).all():
            break
        want = new
    assert (want == label).all()


def test_cover_tree_blocks(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(40, 8))
    rows = np.concatenate([base, base[:10] * 2, base[3:4] + 0.05 * rng.normal(size=(60, 8)), base[:5]]).astype(np.float32)
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "vec_id bigint, embedding array<float>")
    got = cover_tree.link(frame, block=16).toPandas().set_index("vec_id").sort_index()
    double = cover_tree.link(frame.selectExpr("vec_id", "cast(embedding AS array<double>) AS embedding"), block=16).toPandas().set_index("vec_id").sort_index()
    assert (got.n_links == double.n_links).all()
    # cells are split again and again, and other sessions' settings stay
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for most in (1, 2):
        deep = cover_tree.link(frame, block=4, most=most).toPandas().set_index("vec_id").sort_index()
        assert (deep.n_links == got.n_links).all() and (deep.component_id == got.component_id).all()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == size
    u = cover_tree.unit(rows)
    near = u @ u.T >= 0.9
    assert (got.n_links == near.sum(1) - 1).all()
    want = np.arange(len(u))
    for _ in range(len(u)):
        want = np.array([want[near[i]].min() for i in range(len(u))])
    assert (got.component_id == want).all()


def brute_components(fps, bits):
    label = list(range(len(fps)))
    for _ in range(len(fps)):
        new = [min(label[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= bits) for i in range(len(fps))]
        if new == label:
            break
        label = new
    return label


@pytest.mark.parametrize("crowd", [64, 1])
def test_simhash_links(spark, crowd):
    rng = random.Random(crowd)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = list(dict.fromkeys(base + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base * 3] + [b ^ (7 << rng.randrange(60)) for b in base]))
    frame = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp bigint")
    from mendweave.llm.components import components

    got = {r["node"] & (2**64 - 1): r["root"] & (2**64 - 1) for r in components(simhash.links(frame, crowd)).collect()}
    groups = brute_components(fps, 2)
    roots = [got.get(f, f) for f in fps]
    assert all((roots[i] == roots[j]) == (groups[i] == groups[j]) for i in range(len(fps)) for j in range(i))


def test_simhash_fingerprints(spark, documents):
    got = simhash.op9_simhash(spark, DATA).toPandas().set_index("doc_id")
    for i, text in documents.text.iloc[::25].items():
        words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert got.loc[i].fingerprint == f"{want:016x}"


def test_golay_code():
    code = simhash.Golay()
    assert all(w.bit_count() <= 3 for w in code.leader.tolist()) and len(set(code.leader.tolist())) == 2048
    words = np.random.default_rng(0).integers(0, 1 << 23, 500)
    near = words ^ code.leader[code.syndrome(words)]
    assert (code.syndrome(near) == 0).all()


def test_tokens_round_trip(documents):
    encoder = packing.Encoder(packing.tokenizer_path())
    rng = random.Random(1)
    alphabet = list("abcXYZ'’s.,!?$%*#0129 éÉèÀ×÷ßñ \n\t\xa0αΣς́̈ÅİIıﬁ中文日本🙂|>_-\x1c\x85\x00\x7f²½ªº‍ำา")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + documents.text.head(200).tolist()
    data = [t.encode() for t in texts]
    ids, bounds = encoder.encode(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in data]))))
    for k, e in enumerate(encoder.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == e.ids, texts[k]


def test_plan_is_best_fit_decreasing():
    rng = random.Random(4)
    for size in (7, 20, 64):
        counts = collections.Counter(rng.choices(range(1, size + 1), k=300))
        slots = collections.defaultdict(list)
        taken = collections.Counter()
        for length, rank, n, first, offset in packing.plan(counts, size):
            taken[length] += n
            assert n > 0 and rank + n == taken[length]
            for k in range(n):
                slots[first + k].append((offset, length))
        assert taken == counts
        for places in slots.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= size
        rooms = []
        for length in sorted(counts.elements(), reverse=True):
            fit = [r for r in rooms if r >= length]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - length)
            else:
                rooms.append(size - length)
        assert len(slots) == len(rooms) and max(slots) == len(slots) - 1


def test_packing(spark, documents):
    got = packing.op10_packing(spark, DATA).toPandas()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.tokenizer_path())
    ids = {i: np.array([*e.ids, 1], "<u4") for i, e in zip(documents.index, plain.encode_batch(documents.text.tolist(), add_special_tokens=False), strict=True)}
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in got.itertuples())
    assert got.length.sum() == sum(map(len, ids.values()))
    assert got.sequence_id.nunique() <= 1.01 * math.ceil(got.length.sum() / 4096) + 1


def thue_morse(n):
    """Two words of n letters that wrapping polynomial hashes of 64 bits cannot tell apart from 1,024 letters on."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1, 7, 8, 15, 16, 1024, 2048])
def test_tokens_of_words_that_hashes_confuse(n):
    encoder = packing.Encoder(packing.tokenizer_path())
    texts = [x for w in thue_morse(n) for x in (w, f"{w} {w}", w[:-1] + "\0", w + "\0")]
    data = [t.encode() for t in texts]
    ids, bounds = encoder.encode(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in data]))))
    for k, e in enumerate(encoder.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == e.ids, texts[k][:40]


def test_packing_of_null_ids_and_repeated_rows(spark):
    frame = spark.createDataFrame([(None, "same words here")] * 300 + [(4, "same words here")] * 300 + [(k, "x " * k) for k in range(50)], "doc_id bigint, text string").repartition(7)
    got = packing.pack_documents(frame, packing.tokenizer_path(), size=16).toPandas()
    assert len(got[got.doc_id.isna()]) == 300
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum()[:-1]] and own.length.sum() <= 16


def test_no_link_below_the_limit_at_near_equal_points():
    """Two points up to 1.4e-8 apart, one opposite, and queries whose cosine with them lies 4e-9 about 0.9."""
    rng = np.random.default_rng(5)
    for k in range(400):
        a = cover_tree.unit(rng.normal(size=(1, 3)))[0]
        side = cover_tree.unit(np.cross(a, rng.normal(size=3))[None])[0]
        near = cover_tree.unit((a + rng.uniform(0, 1.4e-8) * side)[None])[0]
        points = np.stack([a, near, -a])
        c = 0.9 + rng.uniform(-4e-9, 4e-9)
        query = cover_tree.unit((c * a + math.sqrt(1 - c * c) * (side if k % 2 else -side))[None])
        ta, tb = cover_tree.Tree(points, 0.05), cover_tree.Tree(query, 0.05)
        x, y = points[ta.order], query[tb.order]
        count, _, _ = cover_tree.linked(x, ta, np.ones(3, int), y, tb, np.ones(1, int), False)
        want = np.einsum("ij,ij->i", x, np.repeat(y, 3, 0)) >= 0.9
        assert (count == want).all()


def test_quality_is_the_same_for_repeated_rows(spark):
    rows = [(i, f"good plain words {i % 7}" if i % 2 else f"!! b4d $$ w0rds {i % 5}") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    once = spark.createDataFrame(rows, "doc_id bigint, text string")
    many = once.union(spark.createDataFrame([rows[3]] * 500 + [rows[4]] * 300, "doc_id bigint, text string")).repartition(5)
    a = {(r["doc_id"], r["score"]) for r in quality.classify(once, labels, ["doc_id"]).collect()}
    assert a == {(r["doc_id"], r["score"]) for r in quality.classify(many, labels, ["doc_id"]).collect()}
    assert quality.labelled_sample(many, labels, "quality", 50).count() == 50
    assert quality.labelled_sample(many, labels, "quality", 50, most_bytes=100).count() == 5


def test_learned_exceptions(spark):
    rows = [(i, 1, f"you scum number {i}") for i in range(20)] + [(100 + i, 0, f"pond scum grows in lake {i}") for i in range(6)] + [(200 + i, 0, f"nice day {i}") for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, _, t in rows] + [(900, "the pond scum"), (901, "what scum")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, x) for i, x, _ in rows], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels, ["doc_id"]).collect()}
    assert got[900]["matched"] == [] and got[901]["matched"] != [] and got[901]["score"] > got[900]["score"]


def test_base_tells_words_that_hashes_confuse(spark):
    for n in (1024, 2048):
        one, other = thue_morse(n)
        docs = spark.createDataFrame([(1, f"{one} {one} a"), (2, other)], "doc_id bigint, text string")
        train = docs.where("doc_id = 1")
        got = {r["doc_id"]: r for r in ctw.score_texts(docs, train, ["doc_id"], hot=0).collect()}
        assert got[1]["n_known"] == 4 and got[2]["n_known"] == 1  # the end alone
        assert abs(got[2]["base_score"] - math.log10(0.5 / 6) - math.log10(1.5 / 6)) < 1e-9
