"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendweave.session import share_path as share_path
from mendweave.session import shared_dir as shared_dir
from mendweave.session import spread, written

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Bytes of text that a Python worker handles at a time.
CHUNK = 2 << 20
#: Bytes of labelled texts that a classifier is fitted on, at most.
SAMPLE_BYTES = 64 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
    return spread(rows) if table in ("documents", "pages") else rows


#: Written to the shared folder and read again, so that a lost executor costs no earlier step.
saved = written


def remainder(id_col: str, divisor: int):
    """crc32 of the id as text, modulo ``divisor``; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % divisor, F.lit(0))


def field(df: DataFrame, col: str) -> str:
    """``col``'s DDL, for a schema string."""
    return f"`{col}` {df.schema[col].dataType.simpleString()}"


def carried(carry: list[str], *outputs: str) -> list[str]:
    """Columns to carry along, without those whose names the operator gives to its own."""
    return [c for c in dict.fromkeys(carry) if c not in outputs]


def sheltered(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with its columns but the used ones renamed, so that no operator's names clash; and the way back."""
    inner = [c if c in used else f"__kept{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*inner), lambda df: df.select(*(F.col(i).alias(c) for i, c in zip(inner, docs.columns, strict=True)))


def tidy() -> None:
    """Give memory that a task no longer uses back to the system: workers are used again, and keep what they ever had."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: What workers keep between tasks, by the operator that made it.
_KEPT: dict[str, dict] = {}


def kept(name: str) -> dict:
    return _KEPT.setdefault(name, {})


def forget(but: str | None) -> None:
    """Drop what the other operators kept in this worker."""
    for name in [k for k in _KEPT if k != but]:
        del _KEPT[name]


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, which tidies up after each batch that it gives, and first drops what a worker keeps but ``kept(keeps)``."""

    def tidied_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keeps)
        for batch in run(batches):
            yield batch
            del batch
            tidy()
        tidy()

    return tidied_run


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and its n + 1 offsets; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges [lo, hi) of about ``size`` bytes each; a longer text has a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def joined(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, mark: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts lo..hi in one array, each preceded by the byte ``mark``, with one more mark at the end; and the marks' places."""
    off = offsets[lo : hi + 1] - offsets[lo]
    n = hi - lo
    out = np.full(int(off[-1]) + n + 1, mark, np.uint8)
    marks = off + np.arange(n + 1)
    body = np.ones(len(out), bool)
    body[marks] = False
    out[body] = data[offsets[lo] : offsets[hi]]
    return out, marks


def word_spans(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words between ASCII spaces: starts, stops, and each text's range among them."""
    inside = ~_SPACE[text]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < len(text)]
    first[edges] = inside[edges]
    edges = offsets[1:][offsets[1:] > 0] - 1
    last[edges] = inside[edges]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def equal_words(text: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one word of each kind, the kind of each word), by the words' bytes and not by a hash of them.

    Words of up to 7 bytes are told by these and their length in one number, those of up to 15 by two, longer ones as they are.
    """
    size = stops - starts
    padded = np.concatenate((text, np.zeros(16, np.uint8)))
    eight = np.ndarray((len(text) + 8,), "<u8", padded, strides=(1,))
    masks = np.array([(1 << (8 * k)) - 1 for k in range(8)], np.uint64)
    firsts, back, n = [], np.zeros(len(starts), np.int64), 0

    def tail(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        return eight[at] & masks[left] | (left.astype(np.uint64) << np.uint64(56))

    def keep(rows: np.ndarray, keys: np.ndarray) -> None:
        nonlocal n
        _, first, own = np.unique(keys, return_index=True, return_inverse=True)
        firsts.append(rows[first])
        back[rows] = own + n
        n += len(first)

    short = np.flatnonzero(size < 8)
    keep(short, tail(starts[short], size[short]))
    middle = np.flatnonzero((size >= 8) & (size < 16))
    halves = [np.unique(x, return_inverse=True)[1].astype(np.int64) for x in (eight[starts[middle]], tail(starts[middle] + 8, size[middle] - 8))]
    keep(middle, (halves[0] << 32) | halves[1])
    kinds: dict[bytes, int] = {}
    for i in np.flatnonzero(size >= 16).tolist():
        word = text[starts[i] : stops[i]].tobytes()
        if word not in kinds:
            kinds[word] = n + len(kinds)
            firsts.append(np.array([i]))
        back[i] = kinds[word]
    return np.concatenate(firsts), back


def run_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]], 0 for an empty range (which reduceat would not give)."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, limit: int, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """At most ``limit`` labelled documents with ``most_bytes`` of text together, or one document, chosen by a hash of the id:
    (sample_id, label, text), a row an id.

    Of an id with several labels the largest counts, of one with several texts that with the smallest hash. The ids are cut
    before the join with the texts, so the side that is broadcast has ``limit`` rows at most.
    """
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("sample_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("label"))
        .orderBy(F.xxhash64("sample_id"), "sample_id")
        .limit(limit)
    )
    texts = docs.select(F.col(id_col).alias("sample_id"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(chosen), "sample_id").groupBy("sample_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))
    found = saved(found.select("sample_id", "label", "x.text"))
    sizes = found.select("sample_id", F.octet_length("text").alias("n")).orderBy(F.xxhash64("sample_id"), "sample_id").collect()  # ``limit`` rows
    total = np.cumsum([r["n"] or 0 for r in sizes])
    if len(sizes) < 2 or total[-1] <= most_bytes:
        return found
    kept = sizes[: max(1, int(np.searchsorted(total, most_bytes, side="right")))]
    ids = docs.sparkSession.createDataFrame([(r["sample_id"],) for r in kept], f"sample_id {docs.schema[id_col].dataType.simpleString()}")
    return found.join(F.broadcast(ids), "sample_id", "left_semi")
