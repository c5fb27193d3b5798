"""Link graphs: who is linked, how far, and the best-first search for a way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mendweave.functions import urls as U
from mendweave.session import written

#: Steps of a search, and nodes of its frontier that stay after each.
DEPTH, TRIM = 4, 10


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("dst").agg(F.countDistinct("src").alias("n"))


def reach(edges: DataFrame, starts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(start, node, depth): all nodes within ``depth`` steps, each with its least number of steps.

    One join a step against the nodes found first in the step before; nodes met again are dropped at once.
    """
    found = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"))
    frontier = found
    for step in range(1, depth + 1):
        new = frontier.join(edges, frontier["node"] == edges["src"]).select("start", F.col("dst").alias("node")).distinct()
        frontier = new.join(found.select("start", "node"), ["start", "node"], "left_anti").select("start", "node", F.lit(step).alias("depth"))
        found = found.union(frontier)
    return found


def best_first(edges: DataFrame, starts: DataFrame, score: Column, depth: int = 2, trim: int = TRIM) -> DataFrame:
    """(start, node, depth, path): a search that keeps the ``trim`` best new nodes of each start at every step.

    ``score`` is a column over the edge (src, dst) and the start; the smallest is best.
    """
    found = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"), F.array("node").alias("path"))
    frontier = found
    for step in range(1, depth + 1):
        met = frontier.join(edges, frontier["node"] == edges["src"]).where(~F.array_contains("path", F.col("dst")))
        scored = met.withColumn("score", score).groupBy("start", "dst").agg(F.min(F.struct("score", "path")).alias("b"))
        rank = F.row_number().over(Window.partitionBy("start").orderBy("b.score", "dst"))
        kept = scored.withColumn("k", rank).where(F.col("k") <= trim)
        frontier = kept.select("start", F.col("dst").alias("node"), F.lit(step).alias("depth"), F.concat("b.path", F.array("dst")).alias("path"))
        found = found.union(frontier)
    return found


def guesses(targets: DataFrame, pages: DataFrame, id_col: str, url: str = "url") -> DataFrame:
    """Pages that may link to a target: its parent, its host's home page, and pages of its directory; with the way they were
    found."""
    t = targets.select(F.col(id_col).alias("target"), U.host(url).alias("host"), U.nondigit_dir(F.lower(U.path(url))).alias("dir"), U.parent(url).alias("up"))
    p = pages.select(F.col(id_col).alias("page"), U.host(url).alias("host"), U.nondigit_dir(F.lower(U.path(url))).alias("dir"), F.concat(U.host(url), F.regexp_replace(U.path(url), "/$", "")).alias("at"), U.is_home(url).alias("home"))
    parents = t.join(p, t["up"] == p["at"]).select("target", "page", F.lit("parent").alias("way"))
    homes = t.join(p.where("home"), "host").select("target", "page", F.lit("home").alias("way"))
    near = t.join(p, ["host", "dir"]).select("target", "page", F.lit("sibling").alias("way"))
    every = parents.union(homes).union(near).where("target <> page")
    return every.groupBy("target", "page").agg(F.min("way").alias("way"))


def state(linked: Column, dropped: Column, matched: Column, works: Column) -> Column:
    """What a backlink tells: the first step that fails, or the alias that was found."""
    return F.when(~linked, "NotLinked").when(~dropped, "NoDrop").when(~matched, "NoMatch").when(~works, "Broken").otherwise("Found")


def find_paths(edges: DataFrame, targets: DataFrame, starts: DataFrame, likeness: DataFrame | None = None, depth: int = DEPTH, trim: int = 2 * TRIM) -> DataFrame:
    """(target, path, length, priority): for each target the way along links from its start that a search finds first.

    ``edges``: (src, dst, text), URLs and the text of the link; ``targets``: (target, start), ``starts`` may be shared. A node's
    priority is its distance from the target in the site's tree, plus the steps so far, less how much the last link's text is like
    the target (``likeness``: target, text, score). After each step the ``trim`` best nodes of a target that it has not met go on,
    until one is the target; then only the others go on. Steps are a loop over written frontiers, and what was met is kept apart,
    so a plan never holds more than one step.
    """
    own = edges.select("src", "dst", "text")
    front = written(targets.join(starts, "target").select("target", F.col("start").alias("node"), F.array("start").alias("path"), F.lit(0.0).alias("priority")))
    same = U.match_key("node") == U.match_key("target")
    found, met = front.where(same), front.select("target", "node")
    front = front.where(~same)
    for step in range(1, depth + 1):
        reached = front.join(own, front["node"] == own["src"]).select("target", "path", F.col("dst").alias("node"), "text")
        reached = reached.join(met, ["target", "node"], "left_anti")
        if likeness is not None:
            reached = reached.join(likeness, ["target", "text"], "left")
        alike = F.coalesce("score", F.lit(0.0)) if likeness is not None else F.lit(0.0)
        scored = reached.withColumn("priority", F.round(U.tree_diff("target", "node") + step - alike, 9))
        best = scored.groupBy("target", "node").agg(F.min(F.struct("priority", "path")).alias("b"))
        rank = F.row_number().over(Window.partitionBy("target").orderBy(same.cast("int").desc(), "b.priority", "node"))
        kept = best.withColumn("k", rank).where(F.col("k") <= trim).select("target", "node", F.concat("b.path", F.array("node")).alias("path"), "b.priority")
        kept = written(kept)
        hit = kept.where(same)
        found, met = found.unionByName(hit), written(met.unionByName(kept.select("target", "node")))
        front = kept.join(hit.select("target"), "target", "left_anti")
        if front.isEmpty():
            break
    return found.groupBy("target").agg(F.min(F.struct(F.size("path").alias("n"), "priority", "path")).alias("b")).select("target", "b.path", (F.col("b.n") - 1).cast("bigint").alias("length"), "b.priority")
