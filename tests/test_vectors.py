"""Nearest vectors in blocks of queries against all, with ties, copies and vectors without a direction."""

import random

import numpy as np
import pytest

from mendweave.operators import vectors as N


@pytest.mark.parametrize("block", [2, 7, 4096])
def test_nearest(spark, block, monkeypatch):
    rng, nan = random.Random(block), float("nan")
    monkeypatch.setattr(N, "CELLS", 40)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(60)] + [(60, None), (61, [0.0, 0.0, 0.0]), (62, [nan, 1.0, 1.0]), (63, [None, 1.0, 1.0]), (64, [1.0, 2.0]), (None, [1.0, 0.0, 0.0]), (66, []), (67, [float("inf"), 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "id bigint, v array<double>")
    asked = frame.where("id % 5 = 0 OR id > 59")
    got = {}
    for r in N.nearest(asked, frame, "id", "v", 4, block).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["doc"], round(r["cosine"], 9)))
    good = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i is not None and v and len(v) == 3 and None not in v and np.isfinite(v).all() and any(v)}
    want = {}
    for q in [i for i in good if i % 5 == 0]:
        best = sorted((-round(float(good[q] @ good[d]), 9), d) for d in good if d != q)[:4]
        want[q] = [(k + 1, d, -c + 0.0) for k, (c, d) in enumerate(best)]
    assert {q: sorted(x) for q, x in got.items()} == want
    assert N.nearest(frame.where("1 = 0"), frame, "id", "v", 4).count() == 0
