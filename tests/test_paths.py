"""The search for a way along links, against a plain one that keeps the same nodes at each step."""

import random

import pytest
from pyspark.sql import functions as F

from mendweave.functions import urls as U
from mendweave.operators import graph as G


def plain(edges, target, start, scores, diff, depth, trim):
    front, met = [(0.0, [start])], {start}
    if start == target:
        return [start], 0.0
    for step in range(1, depth + 1):
        best = {}
        for _, path in front:
            for src, dst, text in edges:
                if src == path[-1] and dst not in met:
                    p = round(diff[target, dst] + step - scores.get((target, text), 0.0), 9)
                    best[dst] = min(best.get(dst, (p, path)), (p, path))
        kept = sorted((dst != target, p, dst, path) for dst, (p, path) in best.items())[:trim]
        met |= {dst for _, _, dst, _ in kept}
        for other, p, dst, path in kept:
            if not other:
                return [*path, dst], p
        front = [(p, [*path, dst]) for _, p, dst, path in kept]
    return None


@pytest.mark.parametrize("trim", [2, 4, 50])
def test_paths(spark, trim):
    rng = random.Random(trim)
    urls = [f"http://h.com/{'/'.join(rng.choice('abc') for _ in range(rng.randint(1, 3)))}/{k}" for k in range(18)]
    edges = sorted({(rng.choice(urls), rng.choice(urls), rng.choice("xyz")) for _ in range(60)})
    targets = [(t, urls[0]) for t in urls[:10]]
    scores = {(t, x): round(rng.random(), 3) for t, _ in targets for x in "xy"}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    pairs = frame([(a, b) for a in urls for b in urls], "a string, b string").select("a", "b", U.tree_diff("a", "b").alias("d"))
    diff = {(r["a"], r["b"]): r["d"] for r in pairs.collect()}
    starts = frame(targets, "target string, start string")
    out = G.find_paths(frame(edges, "src string, dst string, text string"), starts.select("target"), starts, frame([(*k, v) for k, v in scores.items()], "target string, text string, score double"), 3, trim)
    got = {r["target"]: (list(r["path"]), r["priority"]) for r in out.where(F.col("length") >= 0).collect()}
    want = {t: w for t, s in targets if (w := plain(edges, t, s, scores, diff, 3, trim))}
    assert got == want and len(want) > 2
