"""Quality rules by compression bands.

zstandard compresses each whole text, and each chunk of it of a fixed size. A ratio under the band of its length means that the
text repeats itself, one over it that it is noise: random letters, keys, encoded bytes. Short texts compress worse than long ones,
so limits are given at lengths that double and lie on a line between them. A document is rejected if its own ratio lies outside
its band, or if chunks that make up more than a share of its bytes do: a text whose one half repeats and whose other half
is noise may have an ordinary ratio as a whole.

The limits are stated, not fitted: the verdict on a document depends on no other, so it is the same at every size of the corpus.

Beside them stand plain rules: fewer than 50 words, or over half of the words in word triples that the text has twice or more.

Defined results: a null or empty text has no words and fails the plain rules. Repeated rows give repeated rows, null ids are
carried as they are. Whole texts are read; memory follows the longest text, some 50 bytes for a word. An empty table gives
no rows. Other columns are carried if they are named, without those that have the name of an output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _SPACE, carried, equal_words, field, pieces, read, run_sums, share_path, strings, tidied, word_spans

LEVEL = 3
CHUNK_BYTES = 2048
#: Share of a text's bytes that may lie in chunks outside their bands.
SHARE_OUT = 1 / 3
#: (bytes, least ratio, largest ratio); below the first and above the last length the limits stay the same.
BANDS = (
    (128, 0.56, 0.99), (256, 0.50, 0.90), (512, 0.47, 0.84), (1024, 0.45, 0.79), (2048, 0.435, 0.75), (4096, 0.415, 0.72),
    (8192, 0.40, 0.70), (16384, 0.38, 0.68), (32768, 0.36, 0.66), (131072, 0.33, 0.64), (1048576, 0.27, 0.62),
)
LEAST_WORDS, MOST_REPEATED_PCT = 50, 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OUTPUTS = (*COUNTS, "ratio", "n_chunks", "n_bytes", "bytes_out")
JUDGED = ("base_failed", "in_band", "kept")

_SYMBOLS, _WORD_HEADS = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
_SYMBOLS[list(b"#*$%&|<>")] = 1
_WORD_HEADS[~_SPACE] = 1
_WORD_HEADS[0x80:0xC0] = 0


def limits(size: np.ndarray, bands: tuple = BANDS) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest ratio at these lengths in bytes."""
    at = np.log2([b[0] for b in bands])
    x = np.log2(np.maximum(size, 1))
    return np.interp(x, at, [b[1] for b in bands]), np.interp(x, at, [b[2] for b in bands])


def chunk_edges(size: int, chunk: int = CHUNK_BYTES) -> list[int]:
    """Where chunks begin and end; a rest of less than half a chunk belongs to the last one."""
    edges = list(range(0, size, chunk))
    if len(edges) > 1 and size - edges[-1] < chunk // 2:
        edges.pop()
    return [*edges, size]


def bands_of(body: bytes, compress, bands: tuple, chunk: int) -> tuple[float, int, int]:
    """(ratio of the whole text, number of chunks, bytes in chunks outside their bands)."""
    edges = chunk_edges(len(body), chunk)
    whole = len(compress(body)) / len(body)
    if len(edges) == 2:
        sizes, ratios = np.array([len(body)]), np.array([whole])
    else:
        sizes = np.diff(edges)
        ratios = np.array([len(compress(body[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]) / sizes
    low, high = limits(sizes, bands)
    return whole, len(sizes), int(sizes[(ratios < low) | (ratios > high)].sum())


def repeated_words(text: np.ndarray, starts: np.ndarray, stops: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each text the words that stand in a triple of words which it has twice or more."""

    def told(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A number for each kind of pair."""
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]

    marked = np.zeros(len(starts), bool)
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    i = np.flatnonzero(of[2:] == of[:-2])
    if len(i):
        kinds = equal_words(text, starts, stops)[1]
        triples = told(told(told(kinds[i], kinds[i + 1]), kinds[i + 2]), of[i])
        twice = i[np.bincount(triples)[triples] > 1]
        marked[twice] = marked[twice + 1] = marked[twice + 2] = True
    return run_sums(marked, bounds)


def repeated_lines(body: bytes) -> int:
    """Lines with a word that equal an earlier one."""
    lines = [x for x in body.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _run(columns: list[str], bands: tuple, chunk: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=level).compress
        for batch in batches:
            data, offsets = strings(batch.column("__text"))
            for lo, hi in pieces(offsets):
                text, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, stops, bounds = word_spans(text, off)
                body, at = text.tobytes(), off.tolist()
                bodies = [body[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                counts = [np.diff(bounds), run_sums(_WORD_HEADS[text], off), run_sums(_SYMBOLS[text], off), [repeated_lines(x) for x in bodies], repeated_words(text, starts, stops, bounds)]
                found = [bands_of(x, compress, bands, chunk) if x else (None, 0, 0) for x in bodies]
                made = [pa.array(c, pa.int64()) for c in counts]
                made += [pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.int64()), pa.array(np.diff(off), pa.int64()), pa.array([x[2] for x in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[lo:hi] for c in columns), *made], [*columns, *OUTPUTS])

    return run


def measure(docs: DataFrame, carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", bands: tuple = BANDS, chunk: int = CHUNK_BYTES, level: int = LEVEL) -> DataFrame:
    """``docs``' id and ``carry`` columns, the counts of the plain rules, ratio (null for an empty text), n_chunks, n_bytes, and
    bytes_out: bytes in chunks whose ratio lies outside their band."""
    share_path(docs.sparkSession)
    carry = carried([id_col, *(carry or [])], *OUTPUTS, *JUDGED)
    schema = ", ".join([*(field(docs, c) for c in carry), *(f"{c} {'double' if c == 'ratio' else 'bigint'}" for c in OUTPUTS)])
    return docs.select(*carry, F.col(text_col).alias("__text")).mapInArrow(tidied(_run(carry, bands, chunk, level)), schema)


def _between(size: F.Column, value: F.Column, bands: tuple) -> F.Column:
    """Whether ``value`` lies in the band of ``size``: the same lines as in limits()."""
    x = F.log2(F.greatest(size, F.lit(1)))
    low, high = F.lit(bands[-1][1]), F.lit(bands[-1][2])
    for a, b in reversed(list(zip(bands[:-1], bands[1:], strict=True))):
        part = (x - F.log2(F.lit(a[0]))) / (F.log2(F.lit(b[0])) - F.log2(F.lit(a[0])))
        low = F.when(size < b[0], a[1] + part * (b[1] - a[1])).otherwise(low)
        high = F.when(size < b[0], a[2] + part * (b[2] - a[2])).otherwise(high)
    first = size < bands[0][0]
    return (value >= F.when(first, bands[0][1]).otherwise(low)) & (value <= F.when(first, bands[0][2]).otherwise(high))


def judged(measured: DataFrame, bands: tuple = BANDS, share_out: float = SHARE_OUT, least_words: int = LEAST_WORDS, most_repeated_pct: int = MOST_REPEATED_PCT) -> DataFrame:
    """What measure() gives, with base_failed (plain rules), in_band (compression) and kept (neither against it)."""
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated_pct * F.col("n_words"))
    inside = F.col("ratio").isNotNull() & _between(F.col("n_bytes"), F.col("ratio"), bands) & (F.col("bytes_out") <= share_out * F.col("n_bytes"))
    return measured.withColumns({"base_failed": base, "in_band": inside}).withColumn("kept", ~F.col("base_failed") & F.col("in_band"))


def op12_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(measure(read(spark, sf_dir, "documents")))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "ratio", "n_chunks", "bytes_out")


QUERIES = {"op12_compression_bands": op12_compression_bands}
