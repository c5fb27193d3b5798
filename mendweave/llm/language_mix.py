"""Language identification by multilingual mixture inference.

Each language has a model of byte trigrams inside words, learned from texts with a known language. The words of a
document are draws from a mixture of those languages: expectation-maximisation finds its proportions from the words'
trigram likelihoods, and the set of languages is the one with the best likelihood less a penalty for each language.

Defined results: a null text, or one without a letter, is ``und`` with score 0. Rows are judged one by one, so repeated
rows get the same result. Of equally likely languages the first in alphabetical order wins. Without any training row
all documents are ``und``. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, field, joined, pieces, read, remainder, run_sums, share_path, strings, tidied

#: Trigrams are hashed to 2**BITS counters for each language. Those that a language has are kept, so the model's size is that of
#: the languages' trigrams.
BITS = 18
#: Added to each counter.
SMOOTH = 0.02
#: Steps of expectation-maximisation at most, and those after which languages with less than LEAST of a text are left out of it.
STEPS, FIRST_STEPS, LEAST = 25, 5, 1e-3
#: Bytes of text that are judged at a time; fewer where languages are many. Likelihoods that are looked up at a time.
CHUNK, CELLS = 1 << 20, 1 << 22
#: Part of a word's probability that any language leaves to unknown words.
FLOOR = 1e-4

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def _words(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all trigrams, each word's range in them (n + 1 bounds), each document's range in the words.

    A word is a run of ASCII letters and bytes over 127, lower-cased, with a space on either side.
    """
    raw, marks = joined(data, offsets, lo, hi, 32)
    text = _LETTER[raw]
    # upper-case Latin letters of the block U+00C0..U+00DE
    high = (text[1:] >= 0x80) & (text[1:] <= 0x9E) & (text[:-1] == 0xC3) & (text[1:] != 0x97)
    text[1:][high] += 0x20
    space = text == 32
    keep = np.ones(len(text), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    at = (np.cumsum(keep) - 1)[marks]
    text = text[keep].astype(np.uint32)
    if len(text) < 3:
        return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(hi - lo + 1, np.int64)
    grams = (text[:-2] << 16) | (text[1:-1] << 8) | text[2:]
    inner = text[1:-1] != 32  # a trigram that spans two words tells nothing of either
    slots = ((grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)
    first = np.flatnonzero((text[:-1] == 32) & (text[1:] != 32))  # the space before each word
    at_gram = np.concatenate(([0], np.cumsum(inner)))
    bounds = np.concatenate((at_gram[np.minimum(first, len(inner))], [at_gram[-1]]))
    return slots[inner], bounds, np.searchsorted(first, at)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of keys, added up over (keys, counts)."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _counter(langs: list[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        index = {x: i for i, x in enumerate(langs)}
        for batch in batches:
            data, offsets = strings(batch.column(0))
            own = np.array([index.get(x, -1) for x in batch.column(1).to_pylist()], np.int64)
            for lo, hi in pieces(offsets, CHUNK):
                slots, bounds, docs = _words(data, offsets, lo, hi)
                each = np.repeat(own[lo:hi], np.diff(bounds[docs]))
                known = each >= 0
                parts.append(np.unique(each[known] * (1 << BITS) + slots[known], return_counts=True))
                held += len(parts[-1][0])
                if held > 4 << BITS:
                    parts, held = [_added(parts)], 0
        keys, n = _added(parts)
        yield pa.RecordBatch.from_arrays([pa.array((keys >> BITS).astype(np.int32)), pa.array((keys & ((1 << BITS) - 1)).astype(np.int32)), pa.array(n.astype(np.int64))], ["lang", "slot", "n"])

    return count


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict:
    """The languages, sorted, and their trigrams: for slot i the languages ``lang`` and log probabilities ``logp`` from first[i] to
    first[i + 1]; ``rest`` is a language's log probability of a trigram that it lacks.

    The driver gets a row for each trigram of each language, and the model is as large.
    """
    share_path(train.sparkSession)
    known = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    langs = sorted(r["l"] for r in known.select("l").distinct().collect())
    if not langs:
        return {"langs": [], "first": np.zeros((1 << BITS) + 1, np.int64), "lang": np.zeros(0, np.int32), "logp": np.zeros(0, np.float32), "rest": np.zeros(0, np.float32)}
    counts = known.mapInArrow(tidied(_counter(langs)), "lang int, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    slot, lang, n = (counts[c].to_numpy() for c in ("slot", "lang", "n"))
    order = np.lexsort((lang, slot))
    slot, lang, n = slot[order], lang[order], n[order]
    total = np.log(SMOOTH * (1 << BITS) + np.bincount(lang, n, len(langs)))
    first = np.searchsorted(slot, np.arange((1 << BITS) + 1))
    return {"langs": langs, "first": first, "lang": lang.astype(np.int32), "logp": (np.log(n + SMOOTH) - total[lang]).astype(np.float32), "rest": (np.log(SMOOTH) - total).astype(np.float32)}


def word_logs(model: dict, slots: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Log probability [words, languages] of each word's trigrams, slots[bounds[i]:bounds[i + 1]]."""
    n = len(bounds) - 1
    out = np.empty((n, len(model["langs"])), np.float32)
    step = max(1, CELLS // len(model["langs"]))
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + step, side="right")) - 1)
        own, back = np.unique(slots[bounds[lo] : bounds[hi]], return_inverse=True)
        table = np.tile(model["rest"], (len(own), 1))
        size = model["first"][own + 1] - model["first"][own]
        row = np.repeat(np.arange(len(own)), size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(model["first"][own], size)
        table[row, model["lang"][at]] = model["logp"][at]
        out[lo:hi] = np.add.reduceat(table[back], bounds[lo:hi] - bounds[lo], axis=0)
        lo = hi
    return out


def _em(like: np.ndarray, docs: np.ndarray, start: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log likelihood of each document: like [words, languages], docs bounds, start [documents, languages]."""
    mix, size = start.copy(), np.diff(docs)
    todo = np.flatnonzero(size > 0)
    gained = np.zeros(len(size))
    for step in range(steps + 1):
        n = size[todo]
        if not len(todo):
            break
        rows = np.repeat(docs[todo] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        part = like[rows] * np.repeat(mix[todo], n, axis=0)
        total = part.sum(1)
        starts = np.concatenate(([0], np.cumsum(n)[:-1]))
        gained[todo] = np.add.reduceat(np.log(total), starts)
        if step == steps:
            break
        new = np.add.reduceat(part / total[:, None], starts, axis=0) / n[:, None]
        moved = np.abs(new - mix[todo]).max(1) > 1e-3
        mix[todo] = new
        todo = todo[moved]
    return mix, gained


def _part(like: np.ndarray, docs: np.ndarray, which: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the documents ``which`` the words' likelihoods under each one's own ``columns``, and their bounds."""
    n = np.diff(docs)[which]
    bounds = np.concatenate(([0], np.cumsum(n)))
    rows = np.repeat(docs[which] - bounds[:-1], n) + np.arange(bounds[-1])
    return like[rows[:, None], np.repeat(columns, n, axis=0)], bounds


def _alike(counts: np.ndarray) -> Iterator[np.ndarray]:
    """Places of equal powers of two, so that few of a group's documents have far fewer languages than another."""
    level = np.ceil(np.log2(np.maximum(counts, 1))).astype(int)
    for x in np.unique(level):
        yield np.flatnonzero(level == x)


def infer(like: np.ndarray, docs: np.ndarray, languages: int) -> np.ndarray:
    """Proportions [documents, languages]: of the sets made by the k largest proportions, the best by penalised likelihood.

    like: each word's likelihood under each language, scaled to a largest value of 1. The penalty is half the log
    of the number of words for each further language, as in the Bayesian information criterion, plus log(languages).
    A language is added as long as that pays.
    """
    n = len(docs) - 1
    logs = run_sums(np.log(like), docs)
    best = logs.argmax(1)
    out = np.zeros((n, languages))
    out[np.arange(n), best] = 1
    if languages == 1:
        return out
    size = np.diff(docs)
    penalty = 0.5 * np.log(np.maximum(size, 2)) + np.log(languages)
    score = logs.max(1)
    # no set gives a word more than its best language does, so what is left to gain is known
    open_ = np.flatnonzero((-score > penalty) & (size > 0))
    if not len(open_):
        return out
    every = np.tile(np.arange(languages), (len(open_), 1))
    full, gained = _em(*_part(like, docs, open_, every), np.full((len(open_), languages), 1 / languages), min(FIRST_STEPS, STEPS))
    left = (full > LEAST).sum(1)
    for group in _alike(left):
        columns = np.argsort(-full[group], axis=1, kind="stable")[:, : left[group].max()]
        start = np.take_along_axis(full[group], columns, axis=1)
        mix, gained[group] = _em(*_part(like, docs, open_[group], columns), start / start.sum(1, keepdims=True), STEPS - FIRST_STEPS)
        full[group] = 0
        full[group[:, None], columns] = mix
    order = np.argsort(-full, axis=1, kind="stable")
    pays = np.flatnonzero(gained - score[open_] > penalty[open_])
    for k in range(2, languages + 1):
        # the mixture of all languages bounds the likelihood of any set
        pays = pays[(full[pays, order[pays, k - 1]] > 0) & (gained[pays] - (k - 1) * penalty[open_[pays]] > score[open_[pays]])]
        if not len(pays):
            break
        own = open_[pays]
        mix, got = _em(*_part(like, docs, own, order[pays, :k]), np.full((len(pays), k), 1 / k))
        value = got - (k - 1) * penalty[own]
        better = value > score[own]
        out[own[better]] = 0
        out[own[better, None], order[pays[better], :k]] = mix[better]
        score[own[better]] = value[better]
        pays = pays[better]
    return out


def _scorer(model, columns: list[str], text_col: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = model.value["langs"]
        chunk = max(1 << 14, CHUNK * 16 // max(16, len(langs)))
        for batch in batches:
            data, offsets = strings(batch.column(text_col))
            mixes = np.zeros((batch.num_rows, max(1, len(langs))))
            evidence = np.zeros(batch.num_rows)
            for lo, hi in pieces(offsets, chunk):
                slots, bounds, docs = _words(data, offsets, lo, hi)
                if len(bounds) < 2 or not langs:
                    continue
                each = word_logs(model.value, slots, bounds).astype(np.float64)
                like = np.exp(np.maximum(each - each.max(1, keepdims=True), np.log(FLOOR)))
                mixes[lo:hi] = infer(like, docs, len(langs))
                evidence[lo:hi] = run_sums(each.max(1), docs) / np.maximum(1, np.diff(bounds[docs]))
            top = mixes.argmax(1)
            has = np.asarray(batch.column("__letter").fill_null(False)) & (mixes.sum(1) > 0)
            pred = [langs[t] if h else "und" for t, h in zip(top.tolist(), has.tolist(), strict=True)]
            share = np.where(has, np.clip(mixes.max(1), 0, 1), 0.0)
            sets = [[langs[j] for j in np.argsort(-m, kind="stable") if m[j] > 0.01] if h else [] for m, h in zip(mixes, has.tolist(), strict=True)] if langs else [[]] * batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(pred, pa.string()), pa.array(share), pa.array(sets, pa.list_(pa.string())), pa.array(np.where(has, evidence, 0.0))],
                [*columns, "lang_pred", "score", "languages", "gram_logp"],
            )

    return score


def identify(docs: DataFrame, train: DataFrame, carry: list[str], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs``' ``carry`` columns, lang_pred, score (the proportion of lang_pred), languages (the chosen set, largest
    first) and gram_logp (mean log probability of a trigram in its word's best language)."""
    spark, carry = docs.sparkSession, carried(carry, "lang_pred", "score", "languages", "gram_logp")
    model = spark.sparkContext.broadcast(fit(train, text_col, lang_col))  # 8 bytes for each trigram of each language
    source = docs.select(*dict.fromkeys([*carry, text_col]), F.col(text_col).rlike(r"\p{L}").alias("__letter"))
    schema = ", ".join([*(field(docs, c) for c in carry), "lang_pred string", "score double", "languages array<string>", "gram_logp double"])
    return source.mapInArrow(tidied(_scorer(model, carry, text_col)), schema)


def op1_language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", remainder("doc_id", 4) == 2)
    return identify(docs, docs.where(~F.col("held_out")), ["doc_id", "held_out"])


QUERIES = {"op1_language_mix": op1_language_mix}
