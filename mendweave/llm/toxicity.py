"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: lower case, accents and homoglyphs to Latin letters, digits and symbols inside words to the
letters they stand for, all else to single spaces. The lexicon holds whole words and beginnings of words; an entry's
weight is its log odds between toxic and other labelled documents. A match inside an exception phrase does not count: these are
learned, as phrases of two words that only other documents hold, and more can be given.
The sum of the matched weights, divided by a power of the number of words, goes through a fitted logistic curve.

Defined results: null, empty and letterless texts match nothing and get the score of a text without matches. Of an id
with several labels the largest counts. Without toxic labels the lexicon is empty and every score is 0. Repeated rows get
the same score; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, field, labelled_sample, read, remainder, share_path, tidied

#: Labelled documents that the lexicon and the curve are fitted on, at most.
SAMPLE = 12000
#: Length of beginnings of words, in letters.
STEMS = (3, 4, 5, 6)
#: Toxic documents that must hold an entry, in number and as a part of all, and its log odds at least.
SUPPORT, SHARE, ODDS = 4, 0.006, 2.5
#: Other labelled documents that must hold a phrase with a match, none of them toxic, for it to be an exception.
HARMLESS = 4

# fixed values: letters of other scripts and symbols that look like Latin letters
_LOOKS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n", "ս": "u",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l",
}


class _Fold(dict):
    """For str.translate: filled as characters turn up, at most one entry for each character there is."""

    def __missing__(self, code: int) -> str:
        char = chr(code).lower()
        flat = _LOOKS.get(char)
        if flat is None:
            base = unicodedata.normalize("NFKD", char)
            base = "".join(c for c in base if not unicodedata.combining(c)).lower()
            flat = "".join(_LOOKS.get(c, c) for c in base if c.isalnum())
            if unicodedata.combining(char) or unicodedata.category(char) == "Cf":
                flat = ""
            elif not flat:
                flat = " "
        self[code] = flat
        return flat


_FOLD = _Fold()


def fold(text: str | None) -> str:
    """The words of a text, folded, with one space before, between and after them.

    ``!`` and ``|`` stand for letters only between word characters; a text's end marks would else grow into words.
    """
    if not text:
        return " "
    if "!" in text or "|" in text:
        text = _ends(text)
    return f" {' '.join(text.translate(_FOLD).split())} "


def _ends(text: str) -> str:
    return re.sub(r"[!|]+(?!\w)|(?<!\w)[!|]+", " ", text)


def _terms(text: str) -> set[str]:
    """A document's candidates for the lexicon: `` word `` and, for beginnings of words, `` wor``."""
    out = set()
    for w in set(fold(text).split()):
        if len(w) > 2:
            out.add(f" {w} ")
            out.update(f" {w[:n]}" for n in STEMS if n < len(w) + 1)
    return out


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of toxic and other documents of each term that a toxic document holds; others follow in ``_clean``."""
    for batch in batches:
        toxic, clean = Counter(), Counter()
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            (toxic if label else clean).update(_terms(text))
        terms = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([clean[t] for t in terms], pa.int64())], ["term", "toxic", "clean"])


def _prune(found: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Entries with their weights. A beginning goes if a longer term has nearly its support, so that it matches no more
    words than it must; of what is left, a longer term goes if a shorter beginning of it is about as sure."""
    support = {t: a for t, a, _ in found}
    weight = {t: math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1)) for t, a, b in found}
    longest: dict[str, int] = {}
    for t, a in support.items():
        for n in range(4, len(t)):
            longest[t[:n]] = max(longest.get(t[:n], 0), a)
    out: dict[str, float] = {}
    for t in sorted(weight, key=lambda t: (len(t), t)):
        if longest.get(t, 0) >= 0.9 * support[t]:
            continue
        starts = [t[:n] for n in range(4, len(t)) if t[:n] in out]
        if not starts or weight[t] > max(out[s] for s in starts) + 1:
            out[t] = weight[t]
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0])))


def automaton(lexicon: dict[str, float], exceptions: tuple[str, ...] = ()):
    machine = ahocorasick.Automaton()
    for entry, weight in lexicon.items():
        machine.add_word(entry, (entry, weight))
    for phrase in exceptions:
        machine.add_word(key := f" {' '.join(fold(phrase).split())} ", (key, None))
    machine.make_automaton()
    return machine


def matches(machine, text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, entry, weight) in the folded text; exceptions remove what they cover; at one start the longest stays."""
    found, safe = {}, []
    for end, (entry, weight) in machine.iter(text):
        start = end - len(entry) + 1
        if weight is None:
            safe.append((start, end + 1))
        else:
            found[start] = (end + 1, entry, weight)  # matches with one start come in order of their ends
    out = [(s, e, x, w) for s, (e, x, w) in found.items()]
    return [m for m in out if not any(a <= m[0] and m[1] <= b + 1 for a, b in safe)] if safe else out


def _measure(machine, text: str | None) -> tuple[float, int, list[str]]:
    flat = fold(text)
    hits = matches(machine, flat) if len(machine) else []
    return sum(h[3] for h in hits) / math.sqrt(1 + flat.count(" ") / 20), len(hits), sorted({h[2].strip() for h in hits})


def _phrases(machine, text: str | None) -> set[str]:
    """The two-word phrases of a text that hold a match: the word with the one before and with the one after."""
    flat, out = fold(text), set()
    for start, end, _, _ in matches(machine, flat):
        stop = flat.index(" ", end - 1)  # a beginning of a word stands for the word
        word = flat[start + 1 : stop]
        before, after = flat[:start].rsplit(" ", 1)[-1], flat[stop + 1 :].split(" ", 1)[0]
        out.update(f"{a} {b}" for a, b in ((before, word), (word, after)) if a and b)
    return out


def _learned(sample: DataFrame, lexicon: dict[str, float]) -> list[str]:
    """Exception phrases: matches with the word before or after, in HARMLESS other documents at least and in no toxic one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(lexicon, ())
        for batch in batches:
            found = [(p, bool(label)) for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True) for p in _phrases(machine, text)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([t for _, t in found], pa.bool_())], ["phrase", "toxic"])

    if not lexicon:
        return []
    counts = sample.select("label", "text").mapInArrow(count, "phrase string, toxic boolean").groupBy("phrase").agg(F.count_if("toxic").alias("a"), F.count_if(~F.col("toxic")).alias("b"))
    return [r["phrase"] for r in counts.where((F.col("a") == 0) & (F.col("b") >= HARMLESS)).orderBy("phrase").collect()]  # of a bounded sample


def fit(sample: DataFrame, exceptions: tuple[str, ...] = ()) -> dict:
    """The lexicon and the curve's two numbers, from (sample_id, label, text)."""
    share_path(sample.sparkSession)
    sample = sample.dropDuplicates(["label", "text"])  # copies are no further evidence
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sum(n for k, n in sizes.items() if k != 1)
    if not n_toxic:
        return {"lexicon": {}, "exceptions": exceptions, "curve": (-30.0, 0.0)}
    counts = sample.select("label", "text").mapInArrow(_tally, "term string, toxic bigint, clean bigint").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    odds = F.log((F.col("a") + 0.5) / (n_toxic + 1)) - F.log((F.col("b") + 0.5) / (n_clean + 1))
    best = counts.where(F.col("a") >= min(max(SUPPORT, SHARE * n_toxic), n_toxic)).withColumn("odds", odds).where(F.col("odds") >= ODDS)
    found = [(r["term"], r["a"], r["b"]) for r in best.orderBy(F.desc("odds"), F.length("term"), "term").collect()]  # of a bounded sample
    lexicon = _prune(found, n_toxic, n_clean)
    exceptions = (*exceptions, *_learned(sample, lexicon))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(lexicon, exceptions)
        for batch in batches:
            x = [_measure(machine, t)[0] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column("label")], ["x", "label"])

    table = sample.select("label", "text").mapInArrow(measured, "x double, label int").toArrow()
    x, y = np.asarray(table["x"], float), (np.asarray(table["label"]) == 1).astype(float)
    order = np.lexsort((y, x))
    return {"lexicon": lexicon, "exceptions": exceptions, "curve": _logistic(x[order], y[order])}


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bias and slope on log1p(x), by Newton's method with a small ridge."""
    a = np.column_stack([np.ones(len(x)), np.log1p(np.maximum(x, 0))])
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w += np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), a.T @ (y - p) - 1e-2 * w)
    return float(w[0]), float(w[1])


def _scorer(model, columns: list[str], text_col: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, (bias, slope) = automaton(model.value["lexicon"], model.value["exceptions"]), model.value["curve"]
        for batch in batches:
            got = [_measure(machine, t.as_py()) for t in batch.column(text_col)]
            z = [min(60, max(-60, bias + slope * math.log1p(max(x, 0)))) for x, _, _ in got]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array([1 / (1 + math.exp(-v)) for v in z], pa.float64()), pa.array([n for _, n, _ in got], pa.int64()), pa.array([t for _, _, t in got], pa.list_(pa.string()))],
                [*columns, "score", "n_matches", "matched"],
            )

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, carry: list[str], label_col: str = "toxic", text_col: str = "text", id_col: str = "doc_id", exceptions: tuple[str, ...] = (), sample: int = SAMPLE) -> DataFrame:
    """``docs``' ``carry`` columns, score (probability that the label is 1), n_matches and matched (the entries found)."""
    carry = carried(carry, "score", "n_matches", "matched")
    chosen = labelled_sample(docs, labels, label_col, sample, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(fit(chosen, exceptions))  # of a bounded sample
    schema = ", ".join([*(field(docs, c) for c in carry), "score double, n_matches bigint, matched array<string>"])
    return docs.select(*dict.fromkeys([*carry, text_col])).mapInArrow(tidied(_scorer(model, carry, text_col)), schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", remainder("doc_id", 4) == 2)
    labels = read(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2)
    return score_toxicity(docs, labels, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


QUERIES = {"op7_toxicity": op7_toxicity}
