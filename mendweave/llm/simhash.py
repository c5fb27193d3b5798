"""Near-duplicates by SimHash fingerprints, linked through the anchors of a covering code.

The anchors are the words of three binary Golay codes side by side: the 64 bits and five zero bits make three blocks
of 23 bits, and each block lies within 3 bits of exactly one code word, so 9 is the covering radius. A fingerprint is
replicated to all anchors that lie within the covering radius plus its half of the threshold, block by block. Of two
fingerprints at most ``2 * reach`` bits apart, a word half-way is within ``reach`` bits of both; its own anchor is within
the covering radius of it, and so gets both. Fingerprints that share an anchor are compared.

Where an anchor holds more than CROWD fingerprints, pairs are not listed: each of its fingerprints goes to the words one
bit away, and those that meet there, 65 at most, are within two bits of each other. That is exact as well.

Equal fingerprints are merged before all this, so a group of copies counts as one.

Defined results: a null or empty text has no words and the fingerprint 0, which links like any other. Repeated rows
share a fingerprint and a component. Rows with a null id get the component of the others of their group, or null.
Texts of any length are hashed whole, in parts. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, field, read, saved, share_path, strings, tidied
from .components import components

SHINGLE = 3
SEED = 42
#: Bits that linked fingerprints differ in at most; the anchors are made for 2.
THRESHOLD = 2
#: Fingerprints of one anchor that are compared pair by pair.
CROWD = 64
#: Shingles hashed at a time.
PART = 1 << 16

#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, the generator of the binary Golay code.
GOLAY = 0xC75


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in over half the hashes of the text's word shingles."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    if n <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    flat, f = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate((len(w) + 1 for w in words)))
    total = np.zeros(64, np.int64)
    n -= shingle - 1
    for lo in range(0, n, PART):
        hi = min(n, lo + PART)
        starts = ends[lo - 1 : hi - 1] if lo else [0, *ends[: hi - 1]]
        hashes = np.array([f(flat[a : b - 1], SEED) for a, b in zip(starts, ends[lo + shingle - 1 : hi + shingle - 1], strict=True)], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def _fingerprints(columns: list[str], text_col: str, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(text_col))
            body, at = data.tobytes(), offsets.tolist()
            out = np.array([fingerprint(body[a:b], shingle) for a, b in zip(at[:-1], at[1:], strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(out.view(np.int64))], [*columns, "fp"])

    return run


def fingerprints(docs: DataFrame, carry: list[str], text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs``' ``carry`` columns and fp, the fingerprint as a signed bigint."""
    share_path(docs.sparkSession)
    schema = ", ".join([*(field(docs, c) for c in carry), "fp bigint"])
    return docs.select(*dict.fromkeys([*carry, text_col])).mapInArrow(tidied(_fingerprints(carry, text_col, shingle)), schema)


class Golay:
    """For each syndrome the coset's words of weight 4 at most: the first has the least weight, the others weight 4."""

    def __init__(self):
        self.low = self._syndromes(np.arange(1 << 12))
        self.high = self._syndromes(np.arange(1 << 11) << 12)
        words = np.array([0, *(sum(1 << i for i in c) for w in range(1, 5) for c in combinations(range(23), w))])
        synd = self.syndrome(words)
        order = np.argsort(synd, kind="stable")  # within a syndrome by weight
        first = np.searchsorted(synd[order], np.arange(2048))
        self.leader = words[order[first]]
        near = [part[1:] for part in np.split(words[order], first[1:])]
        self.near_n = np.array([len(x) for x in near])
        self.near = np.zeros((2048, self.near_n.max()), np.int64)
        for i, x in enumerate(near):
            self.near[i, : len(x)] = x

    @staticmethod
    def _syndromes(words: np.ndarray) -> np.ndarray:
        rest = words.copy()
        for bit in range(22, 10, -1):
            rest = np.where((rest >> bit) & 1, rest ^ (GOLAY << (bit - 11)), rest)
        return rest

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.low[words & 0xFFF] ^ self.high[words >> 12]


def anchors(fps: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, its anchor) for all anchors within the covering radius plus one bit."""
    word = fps.view(np.uint64)
    blocks = [(word >> np.uint64(s)).astype(np.int64) & 0x7FFFFF if s else (word & np.uint64(0x7FFFFF)).astype(np.int64) for s in (0, 23, 46)]
    synd = [code.syndrome(b) for b in blocks]
    # a code word is told by its 12 high bits
    home = [(b ^ code.leader[s]) >> 11 for b, s in zip(blocks, synd, strict=True)]
    base = home[0] | (home[1] << 12) | (home[2] << 24)
    rows, found = [np.arange(len(fps))], [base]
    for k in range(3):
        n = code.near_n[synd[k]]
        i = np.repeat(np.arange(len(fps)), n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        other = (blocks[k][i] ^ code.near[synd[k][i], j]) >> 11
        rows.append(i)
        found.append((base[i] & ~(0xFFF << (12 * k))) | (other << (12 * k)))
    return np.concatenate(rows), np.concatenate(found)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = Golay()
    for batch in batches:
        fps = np.asarray(batch.column("fp"), np.int64)
        i, a = anchors(fps, code)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(fps[i])], ["anchor", "fp"])


def links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (u, v) that connect all fingerprints of ``distinct`` (fp) which lie within two bits of each other."""
    share_path(distinct.sparkSession)
    held = distinct.mapInArrow(tidied(_replicate), "anchor bigint, fp bigint")
    counts = held.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    met = saved(held.join(counts, "anchor"))
    few = met.where(F.col("n") <= crowd)
    pairs = few.select("anchor", F.col("fp").alias("u")).join(few.select("anchor", F.col("fp").alias("v")), "anchor")
    pairs = pairs.where((F.col("u") > F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= THRESHOLD)).select("u", "v")
    many = met.where(F.col("n") > crowd).select("fp").distinct()
    flips = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    stars = many.select("fp", F.explode(flips).alias("z")).groupBy("z").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    stars = stars.select(F.array_min("all").alias("v"), F.explode("all").alias("u")).where("u <> v").select("u", "v")
    return pairs.union(stars)


def group(docs: DataFrame, carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs``' id and ``carry`` columns, fp, component_id: the smallest id reachable by links, and group_id, a number for each group
    whatever its ids."""
    carry = carried([id_col, *(carry or [])], "fp", "component_id", "group_id")
    prints = saved(fingerprints(docs, carry, text_col, shingle))
    own = prints.groupBy("fp").agg(F.min(id_col).alias("first"))
    roots = components(links(own.select("fp")))
    rooted = own.join(roots, own["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id", F.col("root").alias("group_id"))
    return prints.join(named, "fp").select(*carry, "fp", "component_id", "group_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = group(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash": op9_simhash}
