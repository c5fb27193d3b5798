"""Near copies: all pairs of texts whose sets of word shingles have a Jaccard similarity of at least a bound, linked exactly.

Of two sets that are alike, the first ``n - ceil(bound * n) + 1`` shingles of each, in any order that holds for all sets, have
one in common. The order is by the count in a sample of the texts and by hash, so that common passages come last; the
sample changes what is compared, not what is found. Texts that share such a shingle are compared by their whole sets.

Not all pairs of a shingle are listed. First each text is compared with one other, that which it meets most often among the
first of its shingles' largest groups; what that links is merged, and that is done ROUNDS times. Then every text outside a
shingle's largest group is compared with all that are not in its own group. So a large group of near copies costs about its
size, and no pair is left out that could still link two groups.

A pair's whole sets are read only if the sizes allow it, and the numbers of shingles in each of some ranges of the hash: the sets
differ at least as much as these, so nothing that is alike is left out by them.

Defined results: a text of fewer words than a shingle has one shingle, all its words; a null or empty text has none, and
these are alike. A-Z are lower-cased. Shingles, and equal sets, are told by 64-bit hashes. Rows with a null id get the
component of the others of their group, or null. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, field, pieces, saved, share_path, strings, tidied
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
SEED = 42
#: One in so many texts is counted for the order, and so many shingles at most come last. Neither changes a result.
SAMPLE = 16
LATE = 1 << 18
#: Times that each text is compared with one other, before all that are left are.
ROUNDS = 2
#: Ranges of the hash at least, and the count at which they stop.
BINS, MOST = 64, 127
#: Texts whose whole sets are asked for by a broadcast of their hashes; more are by a shuffle.
BROADCAST_ROWS = 500_000


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the text's word shingles."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    flat, f = b" ".join(words), xxhash.xxh64_intdigest
    if n <= size:
        return np.array([f(flat, SEED)], np.uint64).view(np.int64)
    ends = list(accumulate(len(w) + 1 for w in words))
    return np.unique(np.array([f(flat[a : b - 1], SEED) for a, b in zip([0, *ends], ends[size - 1 :])], np.uint64).view(np.int64))


def counts(own: np.ndarray) -> np.ndarray:
    """Numbers of a set's hashes in equal ranges, up to MOST: BINS ranges, or twice that and so on for larger sets."""
    bits = max(BINS.bit_length() - 1, min(13, math.ceil(math.log2(max(1, len(own) / 4)))))
    return np.minimum(np.bincount(own.view(np.uint64) >> np.uint64(64 - bits), minlength=1 << bits), MOST).astype(np.int8)


def _lists(parts: list[np.ndarray], kind: type = np.int64) -> pa.ListArray:
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.zeros(0, kind), *parts])))


def _sets(columns: list[str], text_col: str, size: int, similarity: float, order):
    """Key, size, counts in ranges and whole set of each text; given an order, the shingles that the set is found by instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, times = order.value if order else (None, None)
        for batch in batches:
            data, offsets = strings(batch.column(text_col))
            for lo, hi in pieces(offsets):
                body, at = data[offsets[lo] : offsets[hi]].tobytes(), (offsets[lo : hi + 1] - offsets[lo]).tolist()
                sets = [shingles(body[a:b], size) for a, b in zip(at[:-1], at[1:], strict=True)]
                keys = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
                n = pa.array(np.array([len(x) for x in sets], np.int32))
                bins = [counts(x) for x in sets]
                for i, own in enumerate(sets if order else []):
                    rank = np.zeros(len(own), np.int64)
                    if len(late):
                        place = np.minimum(np.searchsorted(late, own), len(late) - 1)
                        rank = np.where(late[place] == own, times[place], 0)
                    # a set of n needs ceil(similarity * n) in common with any that is alike
                    first = len(own) - math.ceil(similarity * len(own) - 1e-9) + 1 if len(own) else 0
                    sets[i] = own[np.lexsort((own, rank))[:first]]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in columns), pa.array(keys), n, _lists(bins, np.int8), _lists(sets)], [*columns, "key", "n", "bins", "hashes"])

    return run


def shingle_sets(docs: DataFrame, carry: list[str], text_col: str, shingle: int, similarity: float, order=None) -> DataFrame:
    """``docs``' ``carry`` columns, key, size n and bins of the text's set, and hashes: the set, or its first by ``order``."""
    share_path(docs.sparkSession)
    schema = ", ".join([*(field(docs, c) for c in carry), "key bigint, n int, bins array<tinyint>, hashes array<bigint>"])
    return docs.select(*dict.fromkeys([*carry, text_col])).mapInArrow(tidied(_sets(carry, text_col, shingle, similarity, order)), schema)


def sampled_order(docs: DataFrame, text_col: str, shingle: int):
    """Broadcast: the shingles that a sample of the texts has often, sorted, and their counts there."""
    some = docs.where(F.pmod(F.xxhash64(text_col), F.lit(SAMPLE)) == 0)
    each = shingle_sets(some, [], text_col, shingle, SIMILARITY).select(F.explode("hashes").alias("s"))
    often = each.groupBy("s").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "s").limit(LATE).toArrow()
    late, times = (np.asarray(often[c]).astype(np.int64) for c in ("s", "n"))
    return docs.sparkSession.sparkContext.broadcast((late[np.argsort(late)], times[np.argsort(late)]))


def _alike(pairs: DataFrame, info: DataFrame, whole, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets are alike, by their sizes and counts in ranges (of ``info``) and then by themselves, which
    ``whole`` makes for the texts that are left."""
    a, b = (info.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("bins").alias(f"b{x}")) for x in "uv")
    half = "transform(sequence(0, size({0}) DIV 2 - 1), i -> least(int({0}[2 * i]) + {0}[2 * i + 1], {1}))"  # sets that are alike have as many ranges, or twice
    bins = {x: F.expr(f"CASE WHEN size(b{x}) > size(b{y}) THEN {half.format(f'b{x}', MOST)} ELSE CAST(b{x} AS array<int>) END") for x, y in ("uv", "vu")}
    apart = F.aggregate(F.zip_with(bins["u"], bins["v"], lambda p, q: F.abs(p - q)), F.lit(0), lambda t, x: t + x)
    both = pairs.join(a, "u").join(b, "v").where(F.least(F.size("bu"), F.size("bv")) * 2 >= F.greatest(F.size("bu"), F.size("bv"))).where((F.least("nu", "nv") >= similarity * F.greatest("nu", "nv") - 1e-9) & ((1 + similarity) * apart <= (1 - similarity) * (F.col("nu") + F.col("nv")) + 1e-6))
    near = saved(both.select("u", "v"))
    sets = whole(near.select(F.explode(F.array("u", "v")).alias("key")).distinct().join(info.select("key", "__own"), "key").select("__own"))
    a, b = sets.select(F.col("key").alias("u"), F.col("set").alias("a")), sets.select(F.col("key").alias("v"), F.col("set").alias("b"))
    met = near.join(a, "u").join(b, "v").withColumn("common", F.size(F.array_intersect("a", "b")))
    return saved(met.where(F.col("common") >= similarity * (F.size("a") + F.size("b") - F.col("common")) - 1e-9).select("u", "v"))


def meetings(rows: DataFrame) -> DataFrame:
    """From ``rows`` (key, n, hashes), a row a key: (s, key, n, room) for each key of a shingle that several have; room is the
    number of the set's shingles that do not come before it."""
    heads = rows.select(F.posexplode("hashes").alias("at", "s"), "key", "n").select("s", "key", "n", (F.col("n") - F.col("at")).alias("room"))
    shared = saved(heads.groupBy("s").agg(F.count("*").alias("n")).where("n > 1").select("s"))
    return saved(heads.join(shared, "s"))


def _largest(rooted: DataFrame) -> DataFrame:
    """Of ``rooted`` (s, key, root): the rows of shingles that hold several roots, with main, the root with most keys, and y, a
    key of it."""
    sizes = rooted.groupBy("s", "root").agg(F.count("*").alias("size"), F.min("key").alias("y"))
    main = sizes.groupBy("s").agg(F.max(F.struct("size", "root", "y")).alias("main"), F.count("*").alias("groups")).where("groups > 1")
    return rooted.join(saved(main.select("s", F.col("main.root").alias("main"), F.col("main.y").alias("y"))), "s")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()


def links(met: DataFrame, info: DataFrame, whole, similarity: float) -> DataFrame:
    """Edges (u, v) that connect the keys of ``met`` (s, key, n, room) whose sets are alike; ``info``: (key, n, bins, __own)."""
    found, rooted = None, met.withColumn("root", F.col("key"))
    for _ in range(ROUNDS):
        outside = _largest(rooted).where("root <> main").groupBy(F.col("key").alias("x"), "y").agg(F.count("*").alias("times"))
        pairs = _ordered(outside.groupBy("x").agg(F.max(F.struct("times", "y")).alias("best")).select("x", F.col("best.y").alias("y")))
        more = _alike(pairs, info, whole, similarity)
        found = more if found is None else found.union(more)
        roots = saved(components(found))
        rooted = saved(met.join(roots, met["key"] == roots["node"], "left").select("s", "key", "n", "room", F.coalesce("root", "key").alias("root")))
    split = saved(_largest(rooted).select("s", "key", "n", "room", "root", "main"))
    stray = split.where("root <> main").select("s", F.col("key").alias("x"), F.col("root").alias("rx"), F.col("n").alias("nx"), F.col("room").alias("left"))
    # the first shingle that both have has all they have in common behind it
    near = (F.least("n", "nx") >= similarity * F.greatest("n", "nx") - 1e-9) & (F.least("room", "left") >= similarity / (1 + similarity) * (F.col("n") + F.col("nx")) - 1e-6)
    left = stray.join(split, "s").where((F.col("rx") != F.col("root")) & near).select("x", F.col("key").alias("y"))
    return found.union(_alike(_ordered(left), info, whole, similarity))


def group(docs: DataFrame, carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs``' id and ``carry`` columns, group_id, a number for each group whatever its ids, and component_id: the smallest id
    reachable by links."""
    carry = carried([id_col, *(carry or [])], "__own", "key", "n", "bins", "hashes", "component_id", "group_id")
    marked = docs.withColumn("__own", F.xxhash64(text_col))
    rows = saved(shingle_sets(marked, [*carry, "__own"], text_col, shingle, similarity, sampled_order(docs, text_col, shingle)))
    each = rows.groupBy("key").agg(F.min(id_col).alias("first"), F.min("__own").alias("__own"), F.first("n").alias("n"), F.first("bins").alias("bins"), F.first("hashes").alias("hashes"))
    each = saved(each)
    met = meetings(each)
    own = saved(each.join(met.select("key").distinct(), "key", "left_semi").select("key", "__own", "n", "bins"))

    def whole(wanted: DataFrame) -> DataFrame:
        """(key, set) of the texts with these hashes: whole sets are large, so they are made once more where they are needed."""
        wanted = saved(wanted)
        wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
        sets = shingle_sets(marked.join(wanted, "__own", "left_semi"), [], text_col, shingle, similarity)
        return saved(sets.groupBy("key").agg(F.first("hashes").alias("set")))

    roots = components(links(met, own, whole, similarity))
    rooted = each.select("key", "first").join(roots, F.col("key") == F.col("node"), "left").select("key", "first", F.coalesce("root", "key").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("key", "component_id", F.col("root").alias("group_id"))
    return rows.select(*carry, "key").join(named, "key").select(*carry, "component_id", "group_id")
