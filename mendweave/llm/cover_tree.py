"""Near-duplicate embeddings by dual traversal of cover trees: all pairs at or above a cosine, none below.

Unit vectors link if their distance is ``sqrt(2 - 2 * cosine)`` at most. Equal vectors are merged first. The upper levels
of the tree are tables: each vector goes to its nearest pivot, and a cell of more vectors than a block holds is split by pivots of
its own, chosen until half its radius covers a sample of it, level after level, as long as radii shrink. Pairs of cells go down the same levels, from pairs
of parents. The last cells' vectors form blocks of bounded size, each with a tree of nested levels whose radii halve. Pairs of cells,
of blocks and then of nodes are dropped when the distance of their centres exceeds both covering radii and the threshold, and taken
whole when even the radii added to it stay within the threshold, so dense groups are counted without listing their pairs. A task
compares two blocks and gives the number of links of each vector and a spanning forest of them, not the links.

The pivots come from samples of a bounded size, one a cell; they decide how well pairs are pruned, never which links are found.
Random vectors of many dimensions are all about as far from each other, and no bound on distances prunes those: a cell whose sample
shows that radii would hardly shrink is not split, its blocks are random parts of it, and they are compared by matrix products.

Defined results: null, empty and zero vectors, vectors with null or non-finite components and rows with a null id link
with nothing. Vectors link only with those of their own length. Repeated rows count as vectors of their own. Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, saved, share_path
from .components import components

COSINE = 0.9
#: Vectors of a block, about.
BLOCK = 4096
#: Pivots of the first level at most, and vectors that they are chosen from.
PIVOTS, SAMPLE = 256, 4096
#: Parts of a cell that is split, vectors that their pivots are chosen from, about, and vectors of a task that deals a cell's vectors out.
FAN, CELL_SAMPLE, DEALT = 16, 1024, 1 << 14
#: A cell is split if its parts' radii are at most this part of its own, and its own of its parent's; levels below the first at most.
SHRUNK, LEVELS = 0.9, 12
#: Rows of a table that is broadcast.
BROADCAST_ROWS = 200_000
#: Allowance for rounding in bounds: a distance found as the root of 2 - 2 * product is off by up to 3e-8 for near-equal points.
#: Links themselves, and all that lies within the allowance, are decided by the product in double precision.
SLACK = 1e-6
#: Rows of a matrix product at a time.
TILE = 1024


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    return rows / np.sqrt((rows * rows).sum(1))[:, None]


def net(points: np.ndarray, most: int, radius: float = 0.0) -> np.ndarray:
    """Indices of at most ``most`` points, each the farthest from those before it, until all lie within ``radius`` of one."""
    chosen, far = [0], np.full(len(points), np.inf)
    while len(chosen) < most:
        far = np.minimum(far, 2 - 2 * points @ points[chosen[-1]])
        if far.max() <= max(1e-12, radius * radius):
            break
        chosen.append(int(far.argmax()))
    return np.array(chosen)


class Tree:
    """Nested levels over unit vectors: points in depth-first order; node k has the point ``at``, covers points
    [start, stop) within ``radius`` of it, and has the children [child, child + n_child)."""

    def __init__(self, points: np.ndarray, least: float):
        order, nodes, queue = np.arange(len(points)), [], []
        # breadth first, so that a node's children lie side by side
        far = np.sqrt(np.maximum(0, 2 - 2 * points @ points[0])).max() if len(points) else 0.0
        nodes.append([0, 0, len(points), float(far), 0, 0])
        queue.append((0, float(far)))
        head = 0
        while head < len(queue):
            k, scale = queue[head]
            head += 1
            _, start, stop, radius, _, _ = nodes[k]
            if stop - start < 2:
                continue
            scale = min(scale, radius) / 2
            rest, parts = order[start:stop], []
            while len(rest):
                if scale <= least and len(parts) == 0 and radius <= least:
                    parts += [(rest[i : i + 1], 0.0) for i in range(len(rest))]
                    break
                d = np.sqrt(np.maximum(0, 2 - 2 * points[rest] @ points[rest[0]]))
                d[0] = 0
                near = d <= scale
                parts.append((rest[near], float(d[near].max())))
                rest = rest[~near]
            nodes[k][4], nodes[k][5] = len(nodes), len(parts)
            place = start
            for members, r in parts:
                order[place : place + len(members)] = members
                nodes.append([place, place, place + len(members), r, 0, 0])
                if len(members) > 1:
                    queue.append((len(nodes) - 1, scale))
                place += len(members)
        self.order = order
        table = np.array(nodes, float).reshape(-1, 6)
        self.at, self.start, self.stop, self.child, self.n_child = (table[:, i].astype(np.int64) for i in (0, 1, 2, 4, 5))
        self.radius = table[:, 3]

    @classmethod
    def load(cls, table: np.ndarray) -> Tree:
        out = cls.__new__(cls)
        out.at, out.start, out.stop, out.child, out.n_child = (table[:, i].astype(np.int64) for i in (0, 1, 2, 4, 5))
        out.radius = table[:, 3]
        return out

    def table(self) -> np.ndarray:
        return np.column_stack([self.at, self.start, self.stop, self.radius, self.child, self.n_child]).astype(np.float64)


def _expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _settle(a, b, i, j, dot, limit, cosine, single, whole, next_i, next_j) -> None:
    d = np.sqrt(np.maximum(0, 2 - 2 * dot))
    both = a.radius[i] + b.radius[j]
    ends = (a.n_child[i] == 0) & (b.n_child[j] == 0)
    link = np.flatnonzero(ends & (dot >= cosine))
    if len(link):
        single.append((a.at[i[link]], b.at[j[link]]))
    all_ = ~ends & (d + both <= limit - SLACK)
    if all_.any():
        whole.append((i[all_], j[all_]))
    open_ = ~ends & ~all_ & (d <= both + limit + SLACK)
    next_i.append(i[open_])
    next_j.append(j[open_])


def traverse(x: np.ndarray, a: Tree, y: np.ndarray, b: Tree, cosine: float = COSINE) -> tuple[list, list]:
    """Links between the points of two trees: (i, j) arrays of single links, and (node, node) pairs that link as a whole.

    The children of both roots are compared by matrix products, as most of the work may lie there.
    """
    limit = math.sqrt(max(0.0, 2 - 2 * cosine))
    single, whole, next_i, next_j = [], [], [], []
    ca, cb = (t.child[0] + np.arange(t.n_child[0]) if t.n_child[0] else np.zeros(1, np.int64) for t in (a, b))
    yb = np.ascontiguousarray(y[b.at[cb]].T)
    for lo in range(0, len(ca), TILE):
        rows = ca[lo : lo + TILE]
        dot = x[a.at[rows]] @ yb
        reach = np.minimum(2.0, a.radius[rows][:, None] + b.radius[cb][None] + limit + 2 * SLACK)
        i, j = np.nonzero(dot >= 1 - reach * reach / 2 - SLACK)
        exact = np.einsum("ij,ij->i", x[a.at[rows[i]]], y[b.at[cb[j]]])
        _settle(a, b, rows[i], cb[j], exact, limit, cosine, single, whole, next_i, next_j)
    more = _from(x, a, y, b, np.concatenate(next_i), np.concatenate(next_j), cosine)
    return single + more[0], whole + more[1]


def _from(x, a, y, b, i, j, cosine) -> tuple[list, list]:
    """``traverse`` from given pairs of nodes."""
    limit = math.sqrt(max(0.0, 2 - 2 * cosine))
    single, whole = [], []
    while len(i):
        next_i, next_j = [], []
        left = (b.n_child[j] == 0) | (a.n_child[i] > 0) & (a.radius[i] >= b.radius[j])
        for side in (True, False):
            rows = np.flatnonzero(left == side)
            tree, own, rest = (a, i, j) if side else (b, j, i)
            for lo in range(0, len(rows), 1 << 12):
                part = rows[lo : lo + (1 << 12)]
                n = tree.n_child[own[part]]
                new, other = _expand(tree.child[own[part]], n), np.repeat(rest[part], n)
                for k in range(0, len(new), 1 << 16):
                    ci, cj = (new[k : k + (1 << 16)], other[k : k + (1 << 16)])[:: 1 if side else -1]
                    dot = np.einsum("ij,ij->i", x[a.at[ci]], y[b.at[cj]])
                    _settle(a, b, ci, cj, dot, limit, cosine, single, whole, next_i, next_j)
        i, j = (np.concatenate(next_i), np.concatenate(next_j)) if next_i else (np.zeros(0, np.int64),) * 2
    return single, whole


def linked(x: np.ndarray, a: Tree, n_a: np.ndarray, y: np.ndarray, b: Tree, n_b: np.ndarray, same: bool, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked vectors of each point of a, and of b; and labels of the components of a's then b's points, by their links.

    ``n_a``, ``n_b``: vectors that a point stands for. Of a tree with itself, only a's numbers are given, and a point does
    not link with itself.
    """
    single, whole = traverse(x, a, y, b, cosine)
    base = 0 if same else len(x)
    count_a, count_b = np.zeros(len(x) + 1), np.zeros(len(y) + 1)
    us, vs = [], []
    before_a, before_b = np.concatenate(([0], np.cumsum(n_a))), np.concatenate(([0], np.cumsum(n_b)))
    for i, j in single:
        if same:
            i, j = i[i != j], j[i != j]
        count_a[:-1] += np.bincount(i, n_b[j], len(x))
        count_b[:-1] += np.bincount(j, n_a[i], len(y))
        us.append(i)
        vs.append(j + base)
    wide_a, wide_b = np.zeros(len(x) + 1), np.zeros(len(y) + 1)
    for i, j in whole:
        wb, wa = before_b[b.stop[j]] - before_b[b.start[j]], before_a[a.stop[i]] - before_a[a.start[i]]
        np.add.at(wide_a, a.start[i], wb)
        np.add.at(wide_a, a.stop[i], -wb)
        np.add.at(wide_b, b.start[j], wa)
        np.add.at(wide_b, b.stop[j], -wa)
        if same:  # a point within both nodes
            lo, hi = np.maximum(a.start[i], b.start[j]), np.minimum(a.stop[i], b.stop[j])
            for s, e in zip(lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
                count_a[s:e] -= n_a[s:e]
        # all points of either node link with the other node's first point
        ua = _expand(a.start[i], a.stop[i] - a.start[i])
        us.append(ua)
        vs.append(np.repeat(b.start[j], a.stop[i] - a.start[i]) + base)
        ub = _expand(b.start[j], b.stop[j] - b.start[j])
        us.append(np.repeat(a.start[i], b.stop[j] - b.start[j]))
        vs.append(ub + base)
    count_a[:-1] += np.cumsum(wide_a)[:-1]
    count_b[:-1] += np.cumsum(wide_b)[:-1]
    label = np.arange(len(x) + (0 if same else len(y)))
    if us:
        u, v = np.concatenate(us), np.concatenate(vs)
        while True:
            low = np.minimum(label[u], label[v])
            new = label.copy()
            np.minimum.at(new, label[u], low)
            np.minimum.at(new, label[v], low)
            while (new[new] != new).any():
                new = new[new]
            new = new[label]
            if (new == label).all():
                break
            label = new
    return np.rint(count_a[:-1]).astype(np.int64), np.rint(count_b[:-1]).astype(np.int64), label


def _vectors(column: pa.Array) -> np.ndarray:
    values = np.asarray(column.flatten())
    return values.reshape(len(column), -1)


def _assign(pivots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = pivots.value
        for batch in batches:
            dims = np.diff(np.asarray(batch.column("v").offsets))
            cell, far = np.zeros(len(dims), np.int64), np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                x = unit(_vectors(batch.column("v").take(pa.array(rows))))
                first, points = centres[dim]
                for lo in range(0, len(rows), TILE):
                    dot = x[lo : lo + TILE] @ points.T
                    best = dot.argmax(1)
                    cell[rows[lo : lo + TILE]] = first + best
                    far[rows[lo : lo + TILE]] = np.sqrt(np.maximum(0, 2 - 2 * dot[np.arange(len(dot)), best]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "n", "v")), pa.array(cell), pa.array(far)], ["rep", "n", "v", "cell", "far"])

    return run


def _chosen(block: int):
    def run(rows: pa.Table) -> pa.Table:
        """The pivots of one cell, from its sample; none if the radii would hardly shrink, as bounds would not prune more."""
        rows = rows.sort_by("rep")
        x, radius = unit(_vectors(rows["v"].combine_chunks())), rows["radius"][0].as_py()
        points = x[net(x, max(2, min(FAN, 2 * rows["size"][0].as_py() // block)), radius / 2)]
        dot = x @ points.T
        best, far = dot.argmax(1), np.zeros(len(points))
        np.maximum.at(far, best, np.sqrt(np.maximum(0, 2 - 2 * dot.max(1))))
        if len(points) < 2 or far[best].mean() > SHRUNK * radius:
            points = points[:0]
        return pa.table([pa.array([rows["cell"][0].as_py()] * len(points), pa.int64()), pa.array(range(len(points)), pa.int64()), pa.array(list(points), pa.list_(pa.float64()))], ["cell", "sub", "centre"])

    return run


def _dealt(rows: pa.Table, pivots: pa.Table) -> pa.Table:
    """Part of a cell's vectors in the cells of the next level."""
    if not len(rows):
        return pa.table([rows[c] for c in ("rep", "n", "v", "cell", "far")], ["rep", "n", "v", "cell", "far"])
    cell, far = np.asarray(rows["cell"]) * FAN, np.asarray(rows["far"]).copy()
    if len(pivots):
        pivots = pivots.sort_by("sub")
        x, points = unit(_vectors(rows["v"].combine_chunks())), _vectors(pivots["centre"].combine_chunks())
        for lo in range(0, len(x), TILE):
            dot = x[lo : lo + TILE] @ points.T
            best = dot.argmax(1)
            cell[lo : lo + TILE] += best
            far[lo : lo + TILE] = np.sqrt(np.maximum(0, 2 - 2 * dot[np.arange(len(dot)), best]))
    return pa.table([rows["rep"], rows["n"], rows["v"], pa.array(cell), pa.array(far)], ["rep", "n", "v", "cell", "far"])


def _block(rows: pa.Table) -> pa.Table:
    """One block: its vectors in the order of its tree, and the tree."""
    rows = rows.sort_by("rep")
    x = _vectors(rows["v"].combine_chunks())
    u = unit(x)
    tree = Tree(u, 0.05)
    mean = u.mean(0)
    longs = pa.list_(pa.int64())
    ids, ns = (pa.array([np.asarray(rows[c])[tree.order]], longs) for c in ("rep", "n"))
    radius = float(np.sqrt(((u - mean) ** 2).sum(1).max()))
    payload = [ids, ns, pa.array([x[tree.order].tobytes()], pa.binary()), pa.array([tree.table().tobytes()], pa.binary()), pa.array([mean], pa.list_(pa.float64())), pa.array([radius])]
    return pa.table([rows["block"].slice(0, 1), rows["cell"].slice(0, 1), *payload], ["block", "cell", "ids", "ns", "points", "nodes", "centre", "radius"])


def _compare(cosine: float, kind: type):
    def side(pair: pa.Table, s: str):
        ids, ns = (np.asarray(pair[f"{s}{c}"].combine_chunks().flatten()) for c in ("ids", "ns"))
        x = unit(np.frombuffer(pair[f"{s}points"][0].as_py(), kind).reshape(len(ids), -1))
        return ids, ns, x, Tree.load(np.frombuffer(pair[f"{s}nodes"][0].as_py(), np.float64).reshape(-1, 6))

    def run(pair: pa.Table) -> pa.Table:
        ids_a, n_a, x, a = side(pair, "a_")
        ids_b, n_b, y, b = side(pair, "b_")
        same = pair["a"][0].as_py() == pair["b"][0].as_py()
        count_a, count_b, label = linked(x, a, n_a, y, b, n_b, same, cosine)
        ids, counts = (ids_a, count_a) if same else (np.concatenate((ids_a, ids_b)), np.concatenate((count_a, count_b)))
        keep = np.flatnonzero(counts > 0)
        return pa.table([pa.array(ids[keep]), pa.array(counts[keep]), pa.array(ids[label[keep]])], ["rep", "links", "with"])

    return run


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _apart(a: str, b: str):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, x: s + x))


def _finer(placed: DataFrame, cells: DataFrame, pairs: DataFrame, block: int, limit: float, kind: str) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """The next level: vectors, cells and near pairs of cells; None if no cell is to be split.

    ``placed``: (rep, n, v, cell, far); ``cells``: (cell, centre, radius, n, before), before the parent's radius; ``pairs``: (cell, other).
    """
    wanted = cells.where((F.col("n") > block) & (F.col("radius") > limit / 4) & (F.col("radius") <= SHRUNK * F.col("before")))
    wanted = saved(wanted.select("cell", F.col("n").alias("size"), "radius", F.ceil(F.col("n") / DEALT).alias("parts")))
    if wanted.isEmpty():
        return None
    picked = F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(1 << 30)) < F.lit(CELL_SAMPLE * float(1 << 30)) / F.col("size")  # a bounded part of each cell
    sample = placed.join(_small(wanted), "cell").where(picked).select("cell", "rep", "v", "radius", "size")
    pivots = saved(sample.groupBy("cell").applyInArrow(_chosen(block), "cell bigint, sub bigint, centre array<double>"))
    if pivots.isEmpty():
        return None
    wanted = saved(wanted.join(pivots.select("cell").distinct(), "cell", "left_semi").select("cell", "parts"))
    split = _small(wanted)
    dealt = placed.join(split, "cell").withColumn("part", F.pmod(F.xxhash64("rep", F.lit(2)), "parts")).select("rep", "n", "v", "cell", "far", "part")
    copies = pivots.join(wanted, "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).select("cell", "sub", "centre", "part")
    moved = dealt.groupBy("cell", "part").cogroup(copies.groupBy("cell", "part")).applyInArrow(_dealt, f"rep bigint, n bigint, v {kind}, cell bigint, far double")
    rest = placed.join(split, "cell", "left_anti").select("rep", "n", "v", (F.col("cell") * FAN).alias("cell"), "far")
    down = saved(moved.unionByName(rest))
    centres = pivots.select((F.col("cell") * FAN + F.col("sub")).alias("cell"), F.col("cell").alias("parent"), "centre")
    stats = down.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    new = centres.join(cells.select(F.col("cell").alias("parent"), F.col("radius").alias("before")), "parent").join(stats, "cell")
    kept = cells.join(pivots.select("cell").distinct(), "cell", "left_anti")
    # a cell that is not split now is not split later: nothing is at most a part of a radius of 0
    kept = kept.select((F.col("cell") * FAN).alias("cell"), F.col("cell").alias("parent"), "centre", F.lit(0.0).alias("before"), "n", "radius")
    below = saved(new.select("cell", "parent", "centre", "before", "n", "radius").unionByName(kept))
    a = below.select(F.col("parent").alias("cell"), F.col("cell").alias("a"), F.col("centre").alias("ca"), F.col("radius").alias("ra"))
    b = below.select(F.col("parent").alias("other"), F.col("cell").alias("b"), F.col("centre").alias("cb"), F.col("radius").alias("rb"))
    met = pairs.join(a, "cell").join(b, "other").where((F.col("cell") != F.col("other")) | (F.col("a") <= F.col("b")))
    near = met.where(_apart("ca", "cb") <= F.col("ra") + F.col("rb") + limit + SLACK)
    return down, below.drop("parent"), saved(near.select(F.col("a").alias("cell"), F.col("b").alias("other")))


def link(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, block: int = BLOCK, most: int = PIVOTS) -> DataFrame:
    """id, n_links and component_id of each row of ``vectors``."""
    spark = vectors.sparkSession
    share_path(spark)
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col), F.col(vector_col).cast(kind).alias("__v"))
    sound = F.col(id_col).isNotNull() & F.forall("__v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("__v", lambda x: x != 0)
    rows = rows.withColumn("__v", F.when(sound, F.col("__v")))
    classes = saved(rows.where("__v IS NOT NULL").groupBy("__v").agg(F.min(id_col).alias("rep"), F.count("*").alias("n")).select("rep", "n", F.col("__v").alias("v")))
    plain = rows.select(id_col, F.lit(0).cast("bigint").alias("n_links"), F.col(id_col).alias("component_id"))
    dims = {r["d"]: r["n"] for r in classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}  # a row a length of vector
    if not dims:
        return plain
    centres, first = {}, 0
    for dim, n in sorted(dims.items()):
        sample = classes.where(F.size("v") == dim).orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").toArrow()
        points = unit(_vectors(sample["v"].combine_chunks()))
        points = points[net(points, max(1, min(most, n // (2 * block))))]
        centres[dim] = (first, points)
        first += len(points)
    pivots = spark.sparkContext.broadcast(centres)
    placed = saved(classes.mapInArrow(_assign(pivots), f"rep bigint, n bigint, v {kind}, cell bigint, far double"))
    known = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # a row a pivot
    limit, whole, near = math.sqrt(2 - 2 * cosine), [], []
    for first, points in centres.values():
        gap = np.sqrt(np.maximum(0, 2 - 2 * points @ points.T))
        here = [i for i in range(len(points)) if first + i in known]
        whole += [(first + i, points[i].tolist(), known[first + i]["far"], known[first + i]["n"], 1e9) for i in here]
        near += [(first + i, first + j) for i in here for j in here if i <= j and gap[i, j] <= known[first + i]["far"] + known[first + j]["far"] + limit + SLACK]
    cells = spark.createDataFrame(whole, "cell bigint, centre array<double>, radius double, n bigint, before double")
    pairs = spark.createDataFrame(near, "cell bigint, other bigint")  # of pivots
    for _ in range(LEVELS):
        level = _finer(placed, cells, pairs, block, limit, kind)
        if level is None:
            break
        placed, cells, pairs = level
    parts = _small(cells.select("cell", F.ceil(F.col("n") / block).alias("parts")))
    keyed = placed.join(parts, "cell").withColumn("block", F.concat_ws("-", "cell", F.pmod(F.xxhash64("rep"), F.col("parts"))))
    cut = keyed.select("block", "cell", "rep", "n", "v").groupBy("block").applyInArrow(_block, "block string, cell bigint, ids array<bigint>, ns array<bigint>, points binary, nodes binary, centre array<double>, radius double")  # of bounded size
    blocks = saved(cut)
    left = blocks.select("cell", F.col("block").alias("a"), F.col("centre").alias("ca"), F.col("radius").alias("ra"))
    right = blocks.select(F.col("cell").alias("other"), F.col("block").alias("b"), F.col("centre").alias("cb"), F.col("radius").alias("rb"))
    met = left.join(_small(pairs), "cell").join(right, "other").where((F.col("cell") != F.col("other")) | (F.col("a") <= F.col("b")))
    met = met.where(_apart("ca", "cb") <= F.col("ra") + F.col("rb") + limit + SLACK).select("a", "b")
    payload = ("ids", "ns", "points", "nodes")
    full = met.join(blocks.select(F.col("block").alias("a"), *(F.col(c).alias(f"a_{c}") for c in payload)), "a")
    full = full.join(blocks.select(F.col("block").alias("b"), *(F.col(c).alias(f"b_{c}") for c in payload)), "b")
    found = saved(full.groupBy("a", "b").applyInArrow(_compare(cosine, np.float32 if kind == "array<float>" else np.float64), "rep bigint, links bigint, with bigint"))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rep").alias("u"), F.col("with").alias("v")))
    named = classes.join(counts, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
    named = named.select("v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    own = rows.join(named, F.col("__v") == F.col("v"), "left")
    return own.select(id_col, F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", id_col).alias("component_id"))


def op8_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = link(read(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


QUERIES = {"op8_cover_tree": op8_cover_tree}

ORACLE = {
    "op8_cover_tree": """
WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
), l AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
  SELECT vec_id AS u, vec_id AS w FROM e UNION SELECT reach.u, l.w FROM reach JOIN l ON reach.w = l.u
)
SELECT u AS vec_id, (SELECT count(*) FROM l WHERE l.u = reach.u)::BIGINT AS n_links, min(w) AS component_id, u = min(w) AS kept FROM reach GROUP BY u
"""
}
