"""Quality classification by supervised subword embeddings.

Words, pairs of words and character n-grams are hashed to rows of an embedding table; a document is the mean of its rows, a linear
layer and a softmax give the classes' probabilities, and all of it is trained by stochastic gradient descent in numpy,
a document at a time.

The output is linear in the mean of the rows, so a fitted model is folded to one number for each hashed feature and
class: scoring takes one look-up a feature, over the whole text.

Defined results: null and empty texts get the score of the bias alone. Labels come from at most SAMPLE ids with SAMPLE_BYTES of
text, chosen by a hash of the id; of an id with several labels the largest counts, and one of its texts. Without labels every score is 0.5. Repeated rows get
the same score, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, field, joined, labelled_sample, pieces, read, remainder, run_sums, share_path, strings, tidied

#: Labelled documents that the classifier is fitted on, at most.
SAMPLE = 3000
#: Features are hashed to 2**BITS rows.
BITS = 17
DIM = 8
EPOCHS = 6
RATE = 0.5
#: Lengths of character n-grams, in bytes of words with their edges.
GRAMS = (3, 5)

#: Stands for a word that is the one before it.
AGAIN = 0x5BD1E995

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[9, 10, 11, 12, 13]] = 32
_MIX = np.random.default_rng(7).integers(1, 2**32, 256, dtype=np.uint32) | np.uint32(1)


def features(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of texts lo..hi and each text's range among them. Case and symbols stay: they tell of quality."""
    raw, marks = joined(data, offsets, lo, hi, 32)
    text = _FOLD[raw]
    space = text == 32
    keep = np.ones(len(text), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    at = (np.cumsum(keep) - 1)[marks]
    text = text[keep]
    mixed = _MIX[text]
    owner_bounds, slots = [], []
    shift = np.uint32(32 - BITS)
    starts = np.flatnonzero((text[:-1] == 32) & (text[1:] != 32)) + 1
    if len(starts):
        # a word: the wrapping sum of its bytes' values times powers of an odd number, by the place in the word
        place = np.arange(len(text)) - np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(text)]))))
        power = np.uint32(0x01000193) ** np.arange(64, dtype=np.uint32)
        value = np.where(text == 32, np.uint32(0), mixed * power[place & 63])
        words = np.add.reduceat(value, starts, dtype=np.uint32) * np.uint32(0x85EBCA6B)
        words = (words ^ (words >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        slots.append(words >> shift)
        owner_bounds.append((np.searchsorted(starts, at, side="right"), starts))
        # two words in a row; of one that comes again at once, whichever it is, only that counts
        of = np.searchsorted(at, starts)
        both = np.flatnonzero(of[1:] == of[:-1])
        pair = np.where(words[both] == words[both + 1], np.uint32(AGAIN), words[both] * np.uint32(0x9E3779B1) + words[both + 1])
        slots.append(pair * np.uint32(0x85EBCA6B) >> shift)
        owner_bounds.append((np.searchsorted(starts[both + 1], at, side="right"), starts[both + 1]))
    for n in GRAMS:
        if len(text) < n:
            continue
        h = np.zeros(len(text) - n + 1, np.uint32)
        inside = np.ones(len(h), bool)
        for j in range(n):
            h = h * np.uint32(0x01000193) + mixed[j : j + len(h)]
            if 0 < j < n - 1:
                inside &= text[j : j + len(h)] != 32
        where = np.flatnonzero(inside)
        slots.append((h[where] * np.uint32(0x9E3779B1 + 2 * n)) >> shift)
        owner_bounds.append((np.searchsorted(where, at), where))
    if not slots:
        return np.zeros(0, np.int64), np.zeros(hi - lo + 1, np.int64)
    bounds = sum(b for b, _ in owner_bounds)
    # features of one document side by side
    order = np.argsort(np.concatenate([w for _, w in owner_bounds]), kind="stable")
    return np.concatenate(slots)[order].astype(np.int64), bounds


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = strings(batch.column("text"))
        slots, counts = [], []
        for lo, hi in pieces(offsets):
            s, bounds = features(data, offsets, lo, hi)
            for i in range(hi - lo):
                u, c = np.unique(s[bounds[i] : bounds[i + 1]], return_counts=True)
                slots.append(u.astype(np.int32))
                counts.append(c.astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column("sample_id").cast(pa.string()), batch.column("label"), pa.array(slots, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32()))], ["sample_id", "label", "slots", "counts"])


def fit(sample: DataFrame, classes: int = 2, seed: int = 11) -> np.ndarray:
    """From (sample_id, label, text) the folded model [2**BITS + 1, classes] of which the last row is the bias.

    The sample has a bounded number of rows and bytes; the driver gets their feature counts.
    """
    share_path(sample.sparkSession)
    table = sample.mapInArrow(tidied(_sparse), "sample_id string, label int, slots array<int>, counts array<float>").toArrow()
    rows = sorted(zip(table["sample_id"].to_pylist(), table["label"].to_pylist(), range(table.num_rows), strict=True), key=lambda r: (r[0], r[1]))
    slots, counts = (table[c].combine_chunks() for c in ("slots", "counts"))
    own = []
    for _, label, i in rows:
        s, c = (x[i].values.to_numpy(zero_copy_only=False) if len(x[i]) else np.zeros(0, np.float32) for x in (slots, counts))
        if len(s):
            own.append((s.astype(np.int64), (c / c.sum())[:, None].astype(np.float32), label))
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, classes), np.float32), np.zeros(classes, np.float32)
    steps = EPOCHS * len(own)
    for step in range(steps):
        if step % len(own) == 0:
            order = rng.permutation(len(own))
        s, c, label = own[order[step % len(own)]]
        rate = np.float32(RATE * (1 - step / steps))
        rows_ = emb[s]
        mean = (rows_ * c).sum(0)
        logit = mean @ out + bias
        prob = np.exp(logit - logit.max())
        prob /= prob.sum()
        prob[label] -= 1
        back = out @ prob
        out -= rate * np.outer(mean, prob)
        bias -= rate * np.float32(0.1) * prob
        # rows are distinct within a document; the mean spreads the step thinly, so it is scaled up to the row
        emb[s] = rows_ - (rate * 20) * c * back
    return np.vstack([emb @ out, bias[None]])


def _scorer(model, columns: list[str], text_col: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded = model.value
        margin, bias = folded[:-1, 1] - folded[:-1, 0], float(folded[-1, 1] - folded[-1, 0])
        for batch in batches:
            data, offsets = strings(batch.column(text_col))
            logit = np.full(batch.num_rows, bias)
            for lo, hi in pieces(offsets):
                slots, bounds = features(data, offsets, lo, hi)
                logit[lo:hi] += run_sums(margin[slots], bounds) / np.maximum(1, np.diff(bounds))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(1 / (1 + np.exp(-np.clip(logit, -60, 60))))], [*columns, "score"])

    return score


def classify(docs: DataFrame, labels: DataFrame, carry: list[str], label_col: str = "quality", text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """``docs``' ``carry`` columns and score: the probability of label 1, learned from ``labels`` (id, label)."""
    carry = carried(carry, "score")
    chosen = labelled_sample(docs, labels, label_col, sample, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(fit(chosen))  # 8 * 2**BITS bytes
    schema = ", ".join([*(field(docs, c) for c in carry), "score double"])
    return docs.select(*dict.fromkeys([*carry, text_col])).mapInArrow(tidied(_scorer(model, carry, text_col)), schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", remainder("doc_id", 5) == 0)
    labels = read(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    return classify(docs, labels, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


QUERIES = {"op2_quality": op2_quality}
