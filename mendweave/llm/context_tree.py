"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

A byte is eight binary choices, each with a tree of contexts of its own: the 0 to DEPTH bytes before. Every node has a
Krichevsky-Trofimov estimate, and mixes it with its longer contexts by how well either codes what was learned, so that the
probability of a choice is a mixture of the estimates at all depths. The weights are fixed by the training texts; texts
are scored without learning from them.

All contexts of all training bytes are in the model; none is cut or merged. Bytes never seen in a context share the probability
that its trees leave for them in the shape of the next shorter context, so the 256 symbols sum to 1 in any context. The
end of a text is the symbol 255, which UTF-8 does not use.

The model is not held in one place. Texts are gathered in blocks; a block asks for what it holds, once for each context with its
byte and each word. Contexts are dealt out by their last SPLIT bytes, so that all longer ones of these are in one bucket, which
learns its part of the trees; only the nodes of shorter contexts, at most 256**(SPLIT - 1) contexts whatever the corpus, are
put together from the buckets' sums and sent to all. Then each bucket answers the blocks, and a block scores its texts.

Beside it stands a base of single words: all training words are counted, as they are, in buckets by a hash.

Defined results: null texts count as empty, and an empty text is its end alone. A-Z are lower-cased for both models.
Rows are scored one by one, also with equal or null ids. Without training rows all symbols are equally likely, and the base
is 0. Texts of any length are scored whole. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, equal_words, field, pieces, read, remainder, run_sums, saved, share_path, strings, tidied, tidy, word_spans

DEPTH = 6
#: Contexts are dealt out by so many of their last bytes.
SPLIT = 3
END = 255
#: Bytes of text that are counted or scored at a time, and those of a block.
CHUNK, BLOCK = 1 << 20, 24 << 20
#: Bytes of input for each bucket, about; buckets at least and at most.
SHARE, LEAST, MOST = 4 << 20, 8, 4096
#: Distinct keys that a task gathers before it merges them.
GATHER = 2 << 20
#: How hard it is tried to compress what is shuffled.
LEVEL = 6
#: Log probabilities go back in whole steps of this, which a text's score may differ by, at most, half of for each byte.
STEP = 2.0**-32

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def grams(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For all bytes of texts lo..hi and their ends, the context's ``depth`` bytes and the byte as one number; and each text's
    range among them."""
    off = offsets[lo : hi + 1] - offsets[lo]
    n = hi - lo
    text = np.full(int(off[-1]) + depth * (n + 1), END, np.uint8)
    body = np.ones(len(text), bool)
    ends = off[1:] + depth * np.arange(1, n + 1)  # the first mark after each text
    for j in range(depth):
        body[ends + j] = False
    body[:depth] = False
    text[body] = _LOWER[data[offsets[lo] : offsets[hi]]]
    size = len(text) - depth
    keys = np.zeros(size, np.uint64)
    for j in range(depth + 1):
        keys = (keys << np.uint64(8)) | text[j : j + size]
    body[ends] = True
    lengths = np.diff(off) + 1
    return keys[body[depth:]], np.concatenate(([0], np.cumsum(lengths)))


def words_of(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct lower-cased words of texts lo..hi, the place of each word among them, and each text's range of words."""
    text = _LOWER[data[offsets[lo] : offsets[hi]]]
    starts, stops, bounds = word_spans(text, offsets[lo : hi + 1] - offsets[lo])
    if not len(starts):
        return [], np.zeros(0, np.int64), np.zeros(hi - lo + 1, np.int64)
    first, back = equal_words(text, starts, stops)
    body = text.tobytes()
    return [body[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist(), strict=True)], back, bounds


class _Counts:
    """Counts of 64-bit keys, merged whenever many have come together."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, learned: bool) -> None:
        if len(keys):
            keys, n = np.unique(keys, return_counts=True)
            self.parts.append((keys, n if learned else np.zeros(len(keys), np.int64)))
            self.size += len(self.parts[-1][0])
            if self.size > GATHER:
                self.merge()
                if self.size > GATHER // 2:
                    self.size = 0  # distinct keys alone are many: let as many again come

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            keys = np.concatenate([k for k, _ in self.parts])
            counts = np.concatenate([c for _, c in self.parts])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            self.parts = [(keys[starts], np.add.reduceat(counts, starts, dtype=np.int64))]
        self.size = len(self.parts[0][0]) if self.parts else 0
        return self.parts[0] if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(n, starts) if len(starts) else n


def packed(values: np.ndarray | bytes) -> bytes:
    """Bytes, or the numbers' first bytes, then their second bytes and so on, compressed."""
    if not isinstance(values, bytes):
        values = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T).tobytes()
    return len(values).to_bytes(8, "little") + pa.Codec("zstd", LEVEL).compress(values, asbytes=True) if values else b""


def unpacked(body: bytes) -> bytes:
    return pa.decompress(body[8:], int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True) if body else b""


def numbers(body: bytes, kind: type) -> np.ndarray:
    flat, size = np.frombuffer(unpacked(body), np.uint8), np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(kind).ravel() if len(flat) else np.zeros(0, kind)


def buckets_of(keys: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    """The bucket of each of ``grams``' numbers: by a hash of its context's last bytes."""
    last = (keys >> np.uint64(8)) & np.uint64((1 << (8 * min(SPLIT, depth))) - 1)
    return (((last + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets


def words_dealt(words, buckets: int) -> list[list[bytes]]:
    """The words of each bucket, sorted."""
    dealt: list[list[bytes]] = [[] for _ in range(buckets)]
    for w in sorted(words):
        dealt[zlib.crc32(w) % buckets].append(w)
    return dealt


OUTPUTS = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "n_symbols", "bits_per_byte")
#: What blocks ask for lies ``at`` its bucket, their texts at a number of the block.
REQUEST = "block bigint, at bigint, keys binary, n binary, words binary, times binary, body binary, texts bigint"


def _requests(columns: list[str], text_col: str, depth: int, buckets: int):
    names = [c.split()[0] for c in REQUEST.split(", ")]
    types = [pa.int64(), pa.int64(), *[pa.binary()] * 5, pa.int64()]

    def rows(*values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names)

    def asked(block: int, held: pa.Table) -> Iterator[pa.RecordBatch]:
        contexts, words, texts = _Counts(), {}, 0
        for learned in (True, False):
            data, offsets = strings(held.filter(pc.equal(held["__learn"], learned))[text_col])
            texts += learned * (len(offsets) - 1)
            for lo, hi in pieces(offsets, CHUNK):
                contexts.add(grams(data, offsets, lo, hi, depth)[0], learned)
                own, back, _ = words_of(data, offsets, lo, hi)
                for w, n in zip(own, np.bincount(back, minlength=len(own)).tolist(), strict=True):
                    words[w] = words.get(w, 0) + n * learned
        keys, n = contexts.merge()
        of = buckets_of(keys, depth, buckets)
        order = np.argsort(of, kind="stable")  # within a bucket they stay sorted
        keys, n, at = keys[order], n[order].astype(np.uint32), np.searchsorted(of[order], np.arange(buckets + 1))
        dealt = words_dealt(words, buckets)
        some = [k for k in range(buckets) if at[k] < at[k + 1] or dealt[k]]
        yield rows(
            [block] * len(some),
            some,
            [packed(keys[at[k] : at[k + 1]]) for k in some],
            [packed(n[at[k] : at[k + 1]]) for k in some],
            [packed(b" ".join(dealt[k])) for k in some],
            [packed(np.array([words[w] for w in dealt[k]], np.uint32)) for k in some],
            [None] * len(some),
            [texts if k == some[0] else 0 for k in some],
        )
        if block >= 0:
            sink = pa.BufferOutputStream()
            body = held.select(list(dict.fromkeys([*columns, text_col])))
            with pa.ipc.new_stream(sink, body.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))) as out:
                out.write_table(body)
            yield rows([block], [-1 - block], [None], [None], [None], [None], [sink.getvalue().to_pybytes()], [0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sizes = {True: [], False: []}, {True: 0, False: 0}
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for ask in (True, False):
                part = batch.filter(pc.equal(batch.column("__ask"), ask))
                _, offsets = strings(part.column(text_col))
                for lo, hi in pieces(offsets, BLOCK // 4):
                    held[ask].append(part.slice(lo, hi - lo))
                    sizes[ask] += int(offsets[hi] - offsets[lo])
                    if sizes[ask] >= BLOCK:
                        yield from asked(number if ask else -1, pa.Table.from_batches(held[ask]))
                        held[ask], sizes[ask], number = [], 0, number + 1
                        tidy()
        for ask in (True, False):
            if held[ask]:
                yield from asked(number if ask else -1, pa.Table.from_batches(held[ask]))
                number += 1

    return run


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0: Stirling's series after a shift by 8."""
    shift = np.ones_like(x)
    for k in range(8):
        shift *= x + k
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def _estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1) - math.log(math.pi)


#: Most nodes have few of both.
_FEW = 64
_TABLE = _estimate(np.repeat(np.arange(_FEW), _FEW).astype(float), np.tile(np.arange(_FEW), _FEW).astype(float))


def _kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log probability of a zeros and b ones (whole numbers) in the Krichevsky-Trofimov estimate."""
    out = _TABLE[(np.minimum(a, _FEW - 1) * _FEW + np.minimum(b, _FEW - 1)).astype(np.int64)]
    many = np.flatnonzero((a >= _FEW) | (b >= _FEW))
    out[many] = _estimate(a[many], b[many])
    return out


def _mask(d: int) -> np.uint64:
    return np.uint64((1 << (8 * d)) - 1)


def _nodes(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], level: int) -> list[dict]:
    """For each depth the nodes of one of the eight choices: key, zeros a, ones b; and each row's node and choice."""
    nodes = []
    for ctx, byte, n in rows:
        key = (ctx << np.uint64(8)) | ((np.uint64(1) << np.uint64(level)) | (byte >> np.uint64(8 - level)))
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        one = (byte >> np.uint64(7 - level)) & np.uint64(1)
        both = np.add.reduceat(n, start) if len(start) else np.zeros(0)
        ones = np.add.reduceat(n * one, start) if len(start) else np.zeros(0)
        of = np.repeat(np.arange(len(start)), np.diff(np.concatenate((start, [len(key)]))))
        nodes.append({"key": key[start], "a": both - ones, "b": ones, "of": of, "one": one})
    return nodes


def _over(key: np.ndarray, d: int) -> np.ndarray:
    """The keys at depth d of the nodes that those one deeper belong to."""
    return (((key >> np.uint64(8)) & _mask(d)) << np.uint64(8)) | (key & np.uint64(255))


def _climb(nodes: list[dict], first: int, below: tuple[np.ndarray, np.ndarray] | None = None) -> None:
    """Block probabilities, from the deepest nodes up; ``below``: of what is deeper than these, sums for the last depth's keys."""
    for i in range(len(nodes) - 1, -1, -1):
        x, y = nodes[i], nodes[i + 1] if i + 1 < len(nodes) else None
        x["pe"], size = _kt(x["a"], x["b"]), len(x["key"])
        if y is not None:
            y["up"] = np.searchsorted(x["key"], _over(y["key"], first + i))
            x["ra"] = x["a"] - np.bincount(y["up"], y["a"], size)
            x["rb"] = x["b"] - np.bincount(y["up"], y["b"], size)
            mixed = np.bincount(y["up"], y["pw"], size) + _kt(x["ra"], x["rb"])
        elif below is not None:
            x["ra"] = x["rb"] = np.zeros(size)
            mixed = np.bincount(np.searchsorted(x["key"], below[0]), below[1], size)
        else:
            x["pw"] = x["pe"]
            continue
        x["stop"] = 1 / (1 + np.exp(np.clip(mixed - x["pe"], -700, 700)))
        x["pw"] = np.logaddexp(x["pe"], mixed) - math.log(2)


def _descend(nodes: list[dict], logs: list[np.ndarray], first: int, over: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> None:
    """Adds to ``logs`` the log10 of the choice's probability; ``over``: key, done and left of the nodes above the first depth's."""
    for i, x in enumerate(nodes):
        if i:
            done, left = nodes[i - 1]["done"][x["up"]], nodes[i - 1]["left"][x["up"]]
        elif over is not None:
            at = np.searchsorted(over[0], _over(x["key"], first - 1))
            done, left = over[1][at], over[2][at]
        else:
            done, left = np.zeros(len(x["key"])), np.ones(len(x["key"]))
        one = (x["b"] + 0.5) / (x["a"] + x["b"] + 1)
        if "stop" in x:
            done, left = done + left * x["stop"] * one, left * (1 - x["stop"])
            rest = x["ra"] + x["rb"]
            one = np.where(rest > 0, (x["rb"] + 0.5) / (rest + 1), one)
        x["done"], x["left"] = done, left
        q = done + left * one
        p = q[x["of"]]
        logs[i] += np.log10(np.where(x["one"] == 1, p, 1 - p))


def build(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], first: int = 0, above: dict | None = None, over: list | None = None, below: list | None = None, last: list | None = None) -> list[dict]:
    """The model, from (context, byte, count) of the contexts of each depth from ``first`` on, sorted by context and byte.

    For each depth: ctx, the contexts; out, log10 of what a context leaves for bytes unseen in it, over what the next
    shorter context gives those; key, context and byte as one number; logp, log10 of the byte's probability.

    A part of the trees: ``above``, the model of depth first - 1; ``over``, for each choice key, done and left of the nodes there;
    ``below``, for each choice key and sums of what is deeper. To ``last`` key, done and left of the last depth's nodes are added.
    """
    logs = [np.zeros(len(c)) for c, _, _ in rows]
    for level in range(8):
        nodes = _nodes(rows, level)
        _climb(nodes, first, below[level] if below else None)
        _descend(nodes, logs, first, over[level] if over else None)
        if last is not None:
            last.append(tuple(nodes[-1][k] for k in ("key", "done", "left")))
    model = []
    for i, (ctx, byte, _) in enumerate(rows):
        start = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1]))) if len(ctx) else np.zeros(0, np.int64)
        seen = np.add.reduceat(10 ** logs[i], start) if len(start) else np.zeros(0)
        key = (ctx << np.uint64(8)) | byte
        if first + i == 0:
            n = len(ctx)
            out = np.log10(np.maximum(1 - seen, 1e-15) / max(1, 256 - n)) if n else np.array([-math.log10(256)])
            model.append({"ctx": np.zeros(1, np.uint64), "out": out, "key": key, "logp": logs[i]})
        else:
            up = np.searchsorted(above["key"], ((ctx & _mask(first + i - 1)) << np.uint64(8)) | byte)
            covered = np.add.reduceat(10 ** above["logp"][up], start) if len(start) else np.zeros(0)
            out = np.log10(np.maximum(1 - seen, 1e-15) / np.maximum(1 - covered, 1e-15))
            model.append({"ctx": ctx[start], "out": out, "key": key, "logp": logs[i]})
        above = model[-1]
    return model


def depths(keys: np.ndarray, n: np.ndarray, first: int, last: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``build``'s rows of the depths first to last, from distinct sorted numbers of depth ``last`` and their counts."""
    rows = []
    for d in range(last, first - 1, -1):
        if d < last:
            keys, n = summed(keys & _mask(d + 1), n)
        rows.append((keys >> np.uint64(8), keys & np.uint64(255), n.astype(np.float64)))
    return rows[::-1]


def _bucket(table: pa.Table) -> tuple[np.ndarray, np.ndarray, dict[bytes, int]]:
    """The distinct keys that a bucket's requests hold, the counts learned, and the words with theirs."""
    both = [(numbers(k, np.uint64), numbers(n, np.uint32)) for k, n in zip(table["keys"].to_pylist(), table["n"].to_pylist(), strict=True)]
    keys, n = summed(np.concatenate([k for k, _ in both]), np.concatenate([x for _, x in both]).astype(np.int64))
    words: dict[bytes, int] = {}
    for own, times in zip(table["words"].to_pylist(), table["times"].to_pylist(), strict=True):
        for w, t in zip(unpacked(own).split(), numbers(times, np.uint32).tolist(), strict=True):
            words[w] = words.get(w, 0) + t
    return keys, n, words


def _sums(depth: int):
    """What the trees above the buckets need: counts of the contexts there (level -1), sums of block probabilities of each choice
    (levels 0 to 7), training words and distinct ones (level -2)."""
    first = min(SPLIT, depth)

    def run(table: pa.Table) -> pa.Table:
        keys, n, words = _bucket(table)
        rows = depths(keys[n > 0], n[n > 0], first, depth)
        ctx, byte, times = rows[0]
        parts = [(-1, *summed(_over((ctx << np.uint64(8)) | byte, first - 1), times))]
        for level in range(8):
            nodes = _nodes(rows, level)
            _climb(nodes, first)
            parts.append((level, *summed(_over(nodes[0]["key"], first - 1), nodes[0]["pw"])))
        parts.append((-2, np.arange(2, dtype=np.uint64), np.array([sum(words.values()), sum(t > 0 for t in words.values())], float)))
        out = [np.concatenate([np.full(len(k), level, np.int32) for level, k, _ in parts]), np.concatenate([k for _, k, _ in parts]).view(np.int64), np.concatenate([x for _, _, x in parts])]
        tidy()
        return pa.table({"level": out[0], "key": out[1], "x": out[2]})

    return run


def top(sums: pa.Table, depth: int) -> tuple[list[dict], list]:
    """From the buckets' sums: the model of the shorter contexts, and for each choice key, done and left of its last depth."""
    first = min(SPLIT, depth)
    level, key, x = np.asarray(sums["level"]), np.asarray(sums["key"]).view(np.uint64), np.asarray(sums["x"])
    order = np.lexsort((key, level))
    level, key, x = level[order], key[order], x[order]
    own = [(key[level == k], x[level == k]) for k in range(-1, 8)]
    last: list = []
    return build(depths(*own[0], 0, first - 1), below=own[1:], last=last), last


def _answers(depth: int, shared):
    """For each block its keys of a bucket with their log10 probabilities, and its words' counts in their order."""
    first = min(SPLIT, depth)

    def run(table: pa.Table) -> pa.Table:
        keys, n, words = _bucket(table)
        upper, last = shared.value
        model = [*upper, *build(depths(keys[n > 0], n[n > 0], first, depth), first, upper[-1], last)]
        logp = log_probabilities(keys, model)
        table = table.filter(pc.greater_equal(table["block"], 0))
        steps = np.rint(logp / STEP).astype(np.int64)
        found = [packed(steps[np.searchsorted(keys, numbers(k, np.uint64))]) for k in table["keys"].to_pylist()]
        times = [packed(np.array([words[w] for w in unpacked(own).split()], np.int64)) for own in table["words"].to_pylist()]
        tidy()
        at = pc.subtract(pa.scalar(-1, pa.int64()), table["block"])
        return pa.table({"at": at, "bucket": table["at"], "keys": table["keys"], "logp": pa.array(found, pa.binary()), "times": pa.array(times, pa.binary())})

    return run


def log_probabilities(keys: np.ndarray, model: list[dict]) -> np.ndarray:
    """log10 of the byte's probability in its context for each of ``grams``' numbers."""
    out = np.zeros(len(keys))
    todo = np.arange(len(keys))
    for d in range(len(model) - 1, -1, -1):
        m = model[d]
        if not len(todo):
            break
        own = keys[todo] & np.uint64((1 << (8 * d + 8)) - 1)
        at = np.minimum(np.searchsorted(m["key"], own), max(0, len(m["key"]) - 1))
        hit = m["key"][at] == own if len(m["key"]) else np.zeros(len(own), bool)
        out[todo[hit]] += m["logp"][at[hit]]
        todo, own = todo[~hit], own[~hit] >> np.uint64(8)
        if len(m["ctx"]):
            at = np.minimum(np.searchsorted(m["ctx"], own), len(m["ctx"]) - 1)
            out[todo] += np.where(m["ctx"][at] == own, m["out"][at], 0.0)
    return out


def _scorer(ends: int, columns: list[str], text_col: str, depth: int, buckets: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        both = [(numbers(k, np.uint64), numbers(p, np.int64) * STEP) for k, p in zip(answers["keys"].to_pylist(), answers["logp"].to_pylist(), strict=True)]
        known_keys, logp = np.concatenate([k for k, _ in both]), np.concatenate([p for _, p in both])
        order = np.argsort(known_keys)
        known_keys, logp = known_keys[order], logp[order]
        body = pa.ipc.open_stream(texts["body"][0].as_py()).read_all().combine_chunks()
        data, offsets = strings(body[text_col])
        size = body.num_rows
        score, base, known, tokens, n_bytes = np.zeros(size), np.zeros(size), np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        parts = list(pieces(offsets, CHUNK))
        found = [words_of(data, offsets, lo, hi) for lo, hi in parts]
        dealt, words = words_dealt({w for own, _, _ in found for w in own}, buckets), {}
        for k, times in zip(answers["bucket"].to_pylist(), answers["times"].to_pylist(), strict=True):
            words.update(zip(dealt[k], numbers(times, np.int64).tolist(), strict=True))
        for (lo, hi), (own, back, at) in zip(parts, found, strict=True):
            keys, bounds = grams(data, offsets, lo, hi, depth)
            each, place = np.unique(keys, return_inverse=True)
            score[lo:hi] = run_sums(logp[np.searchsorted(known_keys, each)][place], bounds)
            n_bytes[lo:hi] = np.diff(bounds)
            tokens[lo:hi] = np.diff(at) + 1
            times = np.array([words[w] for w in own], np.int64)
            base[lo:hi] = run_sums(np.log10(times + 0.5)[back], at) + math.log10(ends + 0.5)
            known[lo:hi] = run_sums((times > 0)[back], at) + (ends > 0)
        out = {c: body[c] for c in columns} | {"n_tokens": tokens, "n_symbols": n_bytes, "n_known": known, "__base": base, "score": score}
        tidy()
        return pa.table(out)

    return run


def scored(rows: DataFrame, learn, ask, carry: list[str], text_col: str = "text", depth: int = DEPTH, buckets: int | None = None) -> DataFrame:
    """What ``score_texts`` gives for the rows where the condition ``ask`` holds, learned from those where ``learn`` does.
    ``depth``: 1 to 7."""
    spark = rows.sparkSession
    share_path(spark)
    carry = carried(carry, *OUTPUTS)
    if buckets is None:
        size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        buckets = min(MOST, max(LEAST, size // SHARE))
    own = rows.select(*(F.col(c) for c in dict.fromkeys([*carry, text_col])), F.coalesce(learn, F.lit(False)).alias("__learn"), F.coalesce(ask, F.lit(False)).alias("__ask"))
    held = saved(own.mapInArrow(tidied(_requests(carry, text_col, depth, buckets)), REQUEST))
    asked = held.where("body IS NULL").select("block", "at", "keys", "n", "words", "times")
    ends = held.agg(F.sum("texts")).first()[0] or 0
    sums = asked.groupBy("at").applyInArrow(_sums(depth), "level int, key bigint, x double").groupBy("level", "key").agg(F.sum("x").alias("x")).toArrow()
    counts = {r["key"]: int(r["x"]) for r in sums.filter(pc.equal(sums["level"], -2)).to_pylist()}
    n, v = counts.get(0, 0) + ends, counts.get(1, 0) + (ends > 0)
    shared = spark.sparkContext.broadcast(top(sums, depth))
    answers = asked.groupBy("at").applyInArrow(_answers(depth, shared), "at bigint, bucket bigint, keys binary, logp binary, times binary")
    schema = ", ".join([*(field(rows, c) for c in carry), "n_tokens bigint, n_symbols bigint, n_known bigint, __base double, score double"])
    texts = held.where("body IS NOT NULL").select("at", "body")
    out = texts.groupBy("at").cogroup(answers.groupBy("at")).applyInArrow(_scorer(ends, carry, text_col, depth, buckets), schema)
    none = F.lit(math.log10(n + 0.5 * (v + 1)))
    return out.select(
        *carry,
        "n_tokens",
        "n_known",
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("__base") - F.col("n_tokens") * none).alias("base_score"),
        "score",
        "n_symbols",
        (-F.col("score") / F.col("n_symbols") / math.log10(2)).alias("bits_per_byte"),
    )


def score_texts(docs: DataFrame, train: DataFrame, carry: list[str], text_col: str = "text", depth: int = DEPTH, buckets: int | None = None) -> DataFrame:
    """``docs``' ``carry`` columns, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability),
    n_symbols (bytes and the end) and bits_per_byte, the code length per symbol."""
    columns = list(dict.fromkeys([*carried(carry, *OUTPUTS), text_col]))
    learned = train.select(*(F.col(c) if c == text_col else F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in columns), F.lit(True).alias("__train"))
    both = docs.select(*columns, F.lit(False).alias("__train")).unionByName(learned)
    return scored(both, F.col("__train"), ~F.col("__train"), carry, text_col, depth, buckets)


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", remainder("doc_id", 5) == 1)
    return scored(docs, ~F.col("held_out"), F.lit(True), ["doc_id", "held_out"])


QUERIES = {"op3_context_tree": op3_context_tree}
