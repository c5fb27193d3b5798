"""Rows beside rows, in blocks with shared borders, against plain lists; a group of most rows is no special case."""

import random

import pytest
from pyspark.sql import functions as F

from mendweave.operators import ordered as O


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    return [(rng.choice(["hot"] * 8 + ["a", "b", "c"]), i, rng.randrange(50)) for i in rng.sample(range(10_000), 400)] + [(None, 20_000, 1), (None, 20_001, 2)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, id bigint, v int")


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))


def test_ranks(frame, rows):
    got = {r["id"]: r["rank"] for r in O.ranked(frame, "g", "id").collect()}
    assert got == {r[1]: i for i, r in enumerate(in_order(rows))}
    assert O.ranked(frame.where("1 = 0"), "g", "id").count() == 0


@pytest.mark.parametrize(("steps", "block"), [(1, 3), (2, 2), (1, 1 << 14), (-1, 5)])
def test_followed(frame, rows, steps, block):
    got = {r["id"]: (r["next"], r["w"]) for r in O.followed(frame, ["g"], ["id"], {"next": "id", "w": "v"}, steps, block).collect()}
    whole = in_order(rows)
    want = {}
    for i, r in enumerate(whole):
        j = i + steps
        there = 0 <= j < len(whole) and whole[j][0] == r[0]
        want[r[1]] = (whole[j][1], whole[j][2]) if there else (None, None)
    assert got == want


def test_numbered(frame, rows):
    got = {r["id"]: r["k"] for r in O.numbered(frame.where("g IS NOT NULL"), ["g"], ["id"], "k").collect()}
    seen, want = {}, {}
    for r in in_order(rows):
        if r[0] is not None:
            seen[r[0]] = want[r[1]] = seen.get(r[0], 0) + 1
    assert got == want


@pytest.mark.parametrize("block", [4, 7, 1 << 14])
def test_nearest(frame, rows, block):
    placed = O.ranked(frame, "g", "id")
    met = O.nearest(placed, F.struct("id", "g", "v"), lambda x: x["g"].eqNullSafe(F.col("g")) & (x["v"] != F.col("v")), lambda x: x["v"] % 3, 3, 4, block=block)
    got = {r["id"]: [n["id"] for n in r["near"]] for r in met.collect()}
    whole = in_order(rows)
    want = {}
    for i, r in enumerate(whole):
        around = [(whole[j][2] % 3, abs(i - j), j) for j in range(max(0, i - 4), min(len(whole), i + 5)) if j != i and whole[j][0] == r[0] and whole[j][2] != r[2]]
        want[r[1]] = [whole[j][1] for _, _, j in sorted(around)[:3]]
    assert got == want
