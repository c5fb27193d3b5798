"""Fill-in-middle, compression bands and spelling variants against plain versions of the same rules."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mendweave.llm import compression, fill_middle, spelling
from tests.conftest import SMALL
from tests.llm.test_edges import IDS, ROWS, SCHEMA, ids, none
from tests.oracle import assert_same, connect


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


# fill-in-middle


def plain_middle(doc_id, text):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_middle_equals_oracle(spark):
    assert_same(fill_middle.op11_fill_in_middle(spark, SMALL).toPandas(), fill_middle.ORACLE["op11_fill_in_middle"], connect(SMALL))


def test_middle_is_whole_and_comes_back(spark):
    rng = random.Random(5)
    texts = ["", None, "<P> x", "a<M>", "<<P", "P><S", "a", ".", "é", "ab", "\U0001f642", "<", "<S", "a<b>c", "\x00\n\r"]
    texts += ["".join(rng.choice(["a", "B", "zz", "é", " ", "<", "S>", "M", "中", "\U0001f642", "\n", "1"]) for _ in range(rng.randrange(90))) for _ in range(400)]
    frame = spark.createDataFrame([(i * 7919, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    out = fill_middle.fill_in_middle(frame).withColumn("again", fill_middle.restored())
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i * 7919]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_middle(i * 7919, t), t
        assert r["again"] == (t or "")
    assert {r["form"] for r in got.values()} == {"plain", "psm", "spm"}


def test_ranked():
    rng = random.Random(3)
    for size in (1, 2, 3, 63, 64, 65, 1000):
        mask = rng.getrandbits(size) | 1
        places = [i for i in range(size) if mask >> i & 1]
        assert [fill_middle.ranked(mask, k) for k in range(len(places))] == places


def test_middle_edges(docs):
    rows = fill_middle.fill_in_middle(docs.withColumn("form", F.lit("x")), ["score", "form", "text"]).withColumn("again", fill_middle.restored()).collect()
    assert sorted((r["doc_id"] for r in rows), key=lambda x: (x is None, x)) == IDS
    for r in rows:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_middle(r["doc_id"], r["text"])
        assert r["again"] == (r["text"] or "")
    assert fill_middle.fill_in_middle(none(docs)).count() == 0


# compression bands


def plain_counts(text):
    body = (text or "").encode()
    words = body.split()
    triples = list(zip(words, words[1:], words[2:]))
    often, marked = Counter(triples), set()
    for i, t in enumerate(triples):
        if often[t] > 1:
            marked |= {i, i + 1, i + 2}
    seen, again = set(), 0
    for line in body.split(b"\n"):
        if line.split():
            again += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum(body.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")), again, len(marked)


def test_counts_and_base(spark):
    rng = random.Random(9)
    texts = ["", None, " ", "a", "a b", "a b c", "a a a a", "x y z\nx y z\n\nx y z", "\n \n \n", "é ü\x0bö\x0cä a|b <#> $%&*"]
    texts += [" ".join(rng.choices(["a", "b", "c", "dé", "f\n", "averylongwordindeed", "eightwrd"], k=rng.randrange(160))) for _ in range(120)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = compression.judged(compression.measure(frame)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        counts = plain_counts(texts[r["doc_id"]])
        assert tuple(r[c] for c in compression.COUNTS) == counts, texts[r["doc_id"]]
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r["kept"] and r["base_failed"])
    assert any(r["base_failed"] and r["n_words"] >= 50 for r in rows)


def test_bands(spark):
    """The verdict of the frame is that of the plain rule, at lengths on all sides of the limits' knots; repeats and noise go."""
    import zstandard

    rng = random.Random(2)
    text = open(spelling.__file__).read() + open(compression.__file__).read() + open(fill_middle.__file__).read()
    prose = re.sub(r"[^A-Za-z .\n]+", " ", text)
    noise = lambda n: "".join(chr(rng.randrange(33, 0x24F)) if k % 9 else " " for k in range(n))
    few = lambda n: " ".join(rng.choice(["aa", "ab"]) for _ in range(n // 3))
    texts = [prose[k : k + n] for n in (400, 511, 512, 1023, 1500, 2048, 3071, 3072, 5000, 9000) for k in (0, 500)]
    texts += [f(n) for f in (noise, few) for n in (300, 2500, 9000)] + [few(3000) + noise(3000), prose[:4000] + noise(2500)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in compression.judged(compression.measure(frame)).collect()}
    compress = zstandard.ZstdCompressor(level=compression.LEVEL).compress
    inside = lambda b: (lambda r, lim: lim[0][0] <= r <= lim[1][0])(len(compress(b)) / len(b), compression.limits([len(b)]))
    for i, t in enumerate(texts):
        b, r = t.encode(), got[i]
        edges = compression.chunk_edges(len(b))
        out = sum(y - x for x, y in zip(edges, edges[1:]) if not inside(b[x:y]))
        assert (r["n_bytes"], r["bytes_out"], r["n_chunks"]) == (len(b), out, len(edges) - 1)
        assert r["in_band"] == (inside(b) and 3 * out <= len(b))
    assert not any(got[i]["in_band"] for i in range(20, len(texts)))
    assert sum(got[i]["in_band"] for i in range(20)) >= 16


def test_compression_keeps_clean_documents(spark):
    """On labelled documents that the plain rules pass: all clean ones stay, and over a fifth of the others go."""
    folder = SMALL.replace("0.001", "0.01")
    out = compression.judged(compression.measure(spark.read.parquet(f"{folder}/documents.parquet"))).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    got = {r["quality"]: (r["n"], r["kept"]) for r in out.where("NOT base_failed").groupBy("quality").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept")).collect()}
    assert got[1][0] == got[1][1] > 100 and got[0][1] < 0.8 * got[0][0]


def test_compression_edges(docs):
    out = compression.judged(compression.measure(docs.withColumn("kept", F.lit("x")), ["score", "kept", "n_chars"]))
    rows = {r["doc_id"]: r for r in out.collect()}
    assert ids(out) == IDS and "score" in out.columns
    assert all(rows[i]["n_words"] == 0 and rows[i]["base_failed"] and not rows[i]["kept"] for i in (2, 3, 4))
    assert rows[2]["ratio"] is None and rows[6]["base_failed"]
    assert compression.judged(compression.measure(none(docs))).count() == 0


# spelling variants


def plain_vocabulary(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                found[w] += 1
    return {w: n for w, n in found.items() if n >= 2}


def one_apart(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_variants(words):
    near = {w: [] for w in words}
    ordered = sorted(words)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if abs(len(a) - len(b)) <= 1 and one_apart(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 10 * words[w]:
            form[w] = best
    rows = set()
    for w in words:
        root = w
        while root in form:
            root = form[root]
        rows.add((w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None))
    return rows


def got_variants(frame):
    return [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect()]


def made_words(rng, n, letters="abé"):
    """Words that are near each other in all places, with long runs of one letter and beginnings that many share."""
    words = set()
    while len(words) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(7, 10)))
        words.add(rng.choice(["", "aaaa", "abcabcabc", "ba"]) + w)
        if words and rng.random() < 0.5:
            w = rng.choice(sorted(words))
            i = rng.randrange(len(w))
            words.add(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]]))
    return sorted(w for w in words if len(w) >= 7)


def test_trie_pairs():
    rng = random.Random(1)
    for n in (2, 10, 60, 300):
        words = ["zz" + w for w in made_words(rng, n)]
        words += ["zzaaaaaaa" + "a" * k for k in range(6)] + ["zzquite" + "q" * 500, "zzquite" + "q" * 499 + "x", "zzquite" + "q" * 501]
        words = sorted(set(words))
        got = [tuple(sorted(p)) for p in spelling.near_in_trie(words, 2)]
        assert len(got) == len(set(got))
        assert set(got) == {(i, j) for j in range(len(words)) for i in range(j) if one_apart(words[i], words[j])}


@pytest.mark.parametrize("crowd", [4, 40, 20_000])
def test_variants(spark, crowd):
    rng = random.Random(crowd)
    words = {w: rng.choice([2, 3, 5, 25, 60, 700, 8000]) for w in made_words(rng, 500)}
    got = got_variants(spelling.group_variants(spark.createDataFrame(list(words.items()), "word string, n bigint"), crowd=crowd))
    assert len(got) == len(words) and set(got) == plain_variants(words)
    assert any(r[1] and r[2] != r[1] for r in got)


def test_variants_of_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = got_variants(spelling.op13_spelling_variants(spark, SMALL))
    want = plain_variants(plain_vocabulary(rows))
    assert len(got) == len(want) and set(got) == want


def test_variants_edges(spark, docs):
    got = got_variants(spelling.group_variants(spelling.vocabulary(docs)))
    assert set(got) == plain_variants(plain_vocabulary([(r[0], r[1]) for r in ROWS])) or got == []
    text = "ABCDEFGH abcdefgh Éabcdefg éabcdefg ×÷abcdefg " + "x" * 5000 + " " + "x" * 5000 + " " + "x" * 5001 + " " + "x" * 5001
    many = [(k, text) for k in (1, 1, None, None, 7)] + [(8, None), (9, "")]
    frame = spark.createDataFrame(many, "doc_id bigint, text string").withColumn("word", F.lit("w"))
    got = got_variants(spelling.group_variants(spelling.vocabulary(frame)))
    assert len(got) > 4 and set(got) == plain_variants(plain_vocabulary(many))
    assert spelling.group_variants(spelling.vocabulary(none(docs))).count() == 0
