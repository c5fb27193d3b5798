"""Benchmark decontamination by Wu-Manber search for several patterns at once.

An item's windows of consecutive words are the patterns. Texts are brought to lower-case words with one space between
them, cut into lanes, and all lanes advance together: the hash of the block before a position gives a shift; where it
is 0, the block picks the patterns that could end there, and a comparison of the bytes confirms each.

Patterns are searched by classes of length, so that a short item does not shorten the shifts of the others. They are places
in the items' text, not copies of it, so that the tables take about ten times the bytes of that text; a worker keeps those of
its last block. A benchmark of more than PASS_BYTES is searched for block by block: the documents are written down once with a
number each, every block's hits are found by that, and merged.

Defined results: null texts have no words; items without words, or with a null text, have no windows; items with a null
id hit words but are not counted. Repeated items count once by their id, repeated documents are judged alike, documents
of any length are searched whole, and an empty benchmark hits nothing. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, field, joined, kept, pieces, read, saved, share_path, strings, tidied

#: Words of a window.
WINDOW = 13
#: Bytes of benchmark text that are searched for in one pass; a larger benchmark takes several.
PASS_BYTES = 4 << 20
#: Bytes of a lane.
LANE = 2048

_WORD = np.full(256, 32, np.uint8)
_WORD[48:58] = np.arange(48, 58)
_WORD[97:123] = np.arange(97, 123)
_WORD[65:91] = np.arange(97, 123)
_WORD[128:] = np.arange(128, 256)
_WORD[0] = 0  # the mark between texts; a zero byte within a text is made a space before


def normalised(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """``\\0w1 w2 w3\\0w1 w2\\0`` of texts lo..hi, and the places of the marks."""
    if (data[offsets[lo] : offsets[hi]] == 0).any():
        data = np.where(data == 0, np.uint8(32), data)
    raw, marks = joined(data, offsets, lo, hi, 0)
    text = _WORD[raw]
    keep = np.ones(len(text), bool)
    keep[1:] = ~((text[1:] == 32) & (text[:-1] <= 32))
    return text[keep], (np.cumsum(keep) - 1)[marks]


def words(text: str | None) -> list[bytes]:
    """A text's words, as the operator sees them."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    flat, _ = normalised(data, np.array([0, len(data)]), 0, 1)
    return flat[1:-1].tobytes().split()


class Patterns:
    """The distinct windows of items (id, text): places [start, stop) in ``flat``, their words, and the ids of their items."""

    def __init__(self, items: list[tuple], size: int = WINDOW):
        data = np.frombuffer("".join(t or "" for _, t in items).encode(), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len((t or "").encode()) for _, t in items]))).astype(np.int64)
        text, marks = normalised(data, offsets, 0, len(items)) if items else (np.zeros(1, np.uint8), np.zeros(1, np.int64))
        inside = text > 32
        edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.flat = text.tobytes()
        begins, ends, counts, self.names = array("i"), array("i"), array("i"), []
        known: dict[int, int] = {}
        of = array("i")  # item, pattern of each window
        for i, (lo, hi) in enumerate(zip(*(np.searchsorted(first, m).tolist() for m in (marks[:-1], marks[1:])), strict=True)):
            self.names.append(items[i][0])
            n = min(size, hi - lo)
            for k in range(lo, max(lo, hi - size) + 1 if n else lo):
                a, b = int(first[k]), int(last[k + n - 1])
                key, p = xxhash.xxh64_intdigest(self.flat[a:b]), None
                while (p := known.get(key)) is not None and self.flat[a:b] != self.flat[begins[p] : ends[p]]:
                    key += 1  # another window has this hash
                if p is None:
                    p = known[key] = len(begins)
                    begins.append(a)
                    ends.append(b)
                    counts.append(n)
                of.extend((i, p))
        pairs = np.array(of, np.int32).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 1], kind="stable")]
        self.start, self.stop, self.words = (np.array(x, np.int32) for x in (begins, ends, counts))
        self.item, self.item_at = pairs[:, 0].astype(np.int32), np.searchsorted(pairs[:, 1], np.arange(len(begins) + 1)).astype(np.int64)

    def ids(self, p: int) -> list:
        return [x for i in self.item[self.item_at[p] : self.item_at[p + 1]].tolist() if (x := self.names[i]) is not None]


class Searcher:
    """Tables for one class of patterns, of which the shortest has ``m`` bytes."""

    def __init__(self, patterns: Patterns, own: np.ndarray):
        self.patterns = patterns
        self.m = int((patterns.stop - patterns.start)[own].min())
        self.block = min(8, self.m)
        self.bits = max(12, min(22, int(np.log2(len(own) * (self.m - self.block + 1) + 1)) + 4))
        padded = np.frombuffer(bytes(8) + patterns.flat, np.uint8)
        view = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))  # view[e] ends at the byte before e in flat
        start = patterns.start[own].astype(np.int64)
        self.shift = np.full(1 << self.bits, self.m - self.block + 1, np.uint16 if self.m > 255 else np.uint8)
        for end in range(self.block, self.m + 1):  # a later block has a smaller shift and takes the place of an earlier one
            keys = self.cut(view[start + end])
            self.shift[self.slot(keys)] = self.m - end
        order = np.argsort(keys, kind="stable")
        self.own = own[order].astype(np.int32)
        self.suffixes, starts = np.unique(keys[order], return_index=True)
        self.bucket = np.append(starts, len(own)).astype(np.int32)

    def cut(self, eight: np.ndarray) -> np.ndarray:
        return eight >> np.uint64(64 - 8 * self.block)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, text: np.ndarray, body: bytes) -> list[tuple[int, int]]:
        """(start, pattern) of all occurrences of whole words. ``text`` has 8 zero bytes before ``body``'s."""
        size = len(body)
        if size < self.m:
            return []
        view = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))  # view[e] ends at the byte before e in body
        pos = np.arange(self.m, size + 1, LANE)
        stop = np.minimum(pos + LANE, size + 1)
        flat, begins, ends_ = self.patterns.flat, self.patterns.start, self.patterns.stop
        out = []
        while len(pos):
            keys = self.cut(view[pos])
            step = self.shift[self.slot(keys)].astype(np.int64)
            ends = np.flatnonzero(step == 0)
            if len(ends):
                k = keys[ends]
                at = np.minimum(np.searchsorted(self.suffixes, k), len(self.suffixes) - 1)
                same = self.suffixes[at] == k
                for end, bucket in zip(pos[ends[same]].tolist(), at[same].tolist(), strict=True):
                    start = end - self.m
                    if body[start - 1] <= 32:
                        for p in self.own[self.bucket[bucket] : self.bucket[bucket + 1]].tolist():
                            a, b = int(begins[p]), int(ends_[p])
                            if body.startswith(flat[a:b], start) and body[start + b - a] <= 32:
                                out.append((start, p))
            pos = pos + np.maximum(step, 1)
            left = pos < stop
            pos, stop = pos[left], stop[left]
        return out


def searchers(patterns: Patterns) -> list[Searcher]:
    size = patterns.stop - patterns.start
    kind = np.minimum(np.ceil(np.log2(size + 1)), 7)
    return [Searcher(patterns, np.flatnonzero(kind == k)) for k in np.unique(kind)]


def _tables(items, key: str, size: int) -> tuple[Patterns, list[Searcher]]:
    """The tables of a block; a worker keeps those that it searched for last."""
    last = kept("patterns")
    if key not in last:
        last.clear()
        patterns = Patterns(items.value, size)
        last[key] = patterns, searchers(patterns)
    return last[key]


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _found(columns: list[str], batch: pa.RecordBatch, n_words, spans, ids, id_type) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    flat = [_merged(x) for x in spans]
    return pa.RecordBatch.from_arrays(
        [*(batch.column(c) for c in columns), n_words, pa.array([[a for a, _ in x] for x in flat], longs), pa.array([[b for _, b in x] for x in flat], longs), pa.array([sorted(x, key=str) for x in ids], pa.list_(id_type))],
        [*columns, "n_words", "hit_start", "hit_end", "items"],
    )


def _search(items, columns: list[str], text_col: str, size: int, id_type):
    key = uuid.uuid4().hex

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, machines = _tables(items, key, size)
        for batch in batches:
            data, offsets = strings(batch.column(text_col))
            n_words = np.zeros(batch.num_rows, np.int64)
            spans, ids = [[] for _ in range(batch.num_rows)], [set() for _ in range(batch.num_rows)]
            for lo, hi in pieces(offsets):
                text, marks = normalised(data, offsets, lo, hi)
                inside = text > 32
                first_byte = inside.copy()
                first_byte[1:] &= ~inside[:-1]
                number = np.concatenate(([0], np.cumsum(first_byte)))  # words that begin before each place
                n_words[lo:hi] = np.diff(number[marks])
                body = text.tobytes()
                padded = np.concatenate((np.zeros(8, np.uint8), text))
                hits = [h for m in machines for h in m.find(padded, body)]
                if not hits:
                    continue
                at, which = (np.array(x) for x in zip(*hits, strict=True))
                doc = np.searchsorted(marks, at, side="right") - 1
                begin = number[at] - number[marks[doc]]
                for d, a, b in zip((doc + lo).tolist(), begin.tolist(), (begin + patterns.words[which]).tolist(), strict=True):
                    spans[d].append((a, b))
                for d, p in set(zip((doc + lo).tolist(), which.tolist(), strict=True)):
                    ids[d].update(patterns.ids(p))
            yield _found(columns, batch, pa.array(n_words), spans, ids, id_type)

    return search


def _union(columns: list[str], id_type):
    """Rows with n_words and the lists of spans and items that several blocks found, brought together."""

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [[[] if x is None else x for x in batch.column(c).to_pylist()] for c in ("starts", "ends", "found")]
            spans = [[(a, b) for p, q in zip(x, y, strict=True) for a, b in zip(p, q, strict=True)] for x, y in zip(*parts[:2], strict=True)]
            yield _found(columns, batch, batch.column("n_words"), spans, [{i for x in own for i in x} for own in parts[2]], id_type)

    return union


def find_items(docs: DataFrame, benchmark: DataFrame, carry: list[str], text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``docs``' ``carry`` columns, n_words, hit_start and hit_end (disjoint spans of words), items (ids found).

    The benchmark is broadcast in blocks of about ``pass_bytes``. One block is searched for without a shuffle; of several,
    the hits of each, a row for each document that has any, are joined to the documents' numbers.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark, carry = docs.sparkSession, carried(carry, "n_words", "hit_start", "hit_end", "items")
    share_path(spark)
    texts = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).distinct()
    total = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // pass_bytes))
    kind = benchmark.schema[item_id].dataType
    found = f"n_words bigint, hit_start array<bigint>, hit_end array<bigint>, items array<{kind.simpleString()}>"
    head = ", ".join(field(docs, c) for c in carry)

    def block(b: int):
        part = texts if blocks == 1 else texts.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b)
        return spark.sparkContext.broadcast([(r["i"], r["t"]) for r in part.collect()])  # about pass_bytes

    if blocks == 1:
        run = tidied(_search(block(0), carry, text_col, window, to_arrow_type(kind)), "patterns")
        return docs.select(*dict.fromkeys([*carry, text_col])).mapInArrow(run, f"{head}, {found}")
    rows = saved(docs.select(*dict.fromkeys([*carry, text_col]), F.monotonically_increasing_id().alias("__row")))
    counted, hits = None, None
    for b in range(blocks):
        items = block(b)
        each = rows.select("__row", text_col).mapInArrow(tidied(_search(items, ["__row"], text_col, window, to_arrow_type(kind)), "patterns"), f"__row bigint, {found}")
        if counted is None:
            counted = each = saved(each)
        own = each.where(F.size("hit_start") > 0).select("__row", "hit_start", "hit_end", "items")
        own = saved(own)
        items.unpersist()
        hits = own if hits is None else hits.union(own)
    hits = hits.groupBy("__row").agg(*(F.collect_list(c).alias(n) for c, n in (("hit_start", "starts"), ("hit_end", "ends"), ("items", "found"))))  # ``blocks`` rows at most
    whole = rows.select("__row", *carry).join(counted.select("__row", "n_words"), "__row").join(hits, "__row", "left").drop("__row")
    return whole.mapInArrow(_union(carry, to_arrow_type(kind)), f"{head}, {found}")


def judged(found: DataFrame) -> DataFrame:
    """With n_hit, n_items, items_sha256 and contaminated: a twentieth of the words hit, and one at least."""
    hit = F.aggregate(F.zip_with("hit_start", "hit_end", lambda a, b: b - a), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return (
        found.withColumn("n_hit", hit)
        .withColumn("n_items", F.size("items").cast("bigint"))
        .withColumn("items_sha256", F.sha2(F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ","), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), ["doc_id"])
    return judged(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


QUERIES = {"op5_decontaminate": op5_decontaminate}

ORACLE = {
    "op5_decontaminate": r"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM iw WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), n AS (
  SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words FROM dw
), pos AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)
), hit AS (
  SELECT doc_id, i, pos.k AS k, item_id FROM pos JOIN win ON pos.g = win.g AND pos.k = win.k
), h AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY 1
), it AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY 1
)
SELECT n.doc_id, n.n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= n.n_words AS contaminated
FROM n LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""
}
