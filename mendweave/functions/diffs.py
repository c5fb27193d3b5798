"""Sequence differences of URL tokens, in Arrow batches: what must change to make an alias of a URL."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: index: the place in the URL's tokens; op: C(hanged), A(dded) or D(eleted), for the host with the new name; text.
EDIT = "array<struct<index int, op string, text string>>"


def edits(old: list[str], new: list[str]) -> list[tuple[int, str, str]]:
    out = []
    for tag, a, b, c, d in SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
        if tag == "equal":
            continue
        both = min(b - a, d - c)
        out += [(a + k, "C", new[c + k]) for k in range(both)]
        out += [(a + k, "D", old[a + k]) for k in range(both, b - a)]
        out += [(b, "A", new[c + k]) for k in range(both, d - c)]
    return [(i, f"C {text}" if i == 0 and op == "C" else op, text) for i, op, text in out]


def _edits(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([[{"index": i, "op": o, "text": t} for i, o, t in edits(list(x), list(y))] for x, y in zip(a, b, strict=True)])


def token_diffs(old, new) -> Column:
    """The edits that make one array of tokens of the other."""
    return F.pandas_udf(_edits, EDIT)(old, new)


def signature(diffs: Column) -> Column:
    """Index and operation of all edits, sorted, as one string: URLs that change alike share it."""
    return F.array_join(F.array_sort(F.transform(diffs, lambda e: F.concat_ws(" ", F.lpad(e["index"].cast("string"), 3, "0"), e["op"]))), "; ")


def _overlap(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    def share(name: str, title: str) -> float:
        a, b = ([w for w in re.split("[^a-z1-9]", (x or "").lower()) if w] for x in (name, title))
        return sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) / len(a) if a else 0.0

    for a, b in pairs:
        yield pd.Series([share(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def title_overlap(filename, title) -> Column:
    """The part of a file name's words that stand in the title in the same order."""
    return F.pandas_udf(_overlap, "double")(F.regexp_replace(filename, r"\.[A-Za-z0-9]+$", ""), title)
