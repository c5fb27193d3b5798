"""Spelling variants: words of a corpus at edit distance one, found by a self-join of the vocabulary's trie.

The vocabulary is partitioned by prefix, and each part is a trie over its sorted words. A node's active set holds the nodes at
distance at most one from it: itself, and those that differ by one edit. Going down to a child, an active node at distance one
moves to its own child of the same letter or drops out; from distance zero, the node's other children become active by
replacement, and its own children one level further down by deletion. Where a word ends, the words that end at its active nodes
are its near words. The set of a node holds the nodes of equal or lesser depth, and an edit is made at the first letter that
differs, so that each pair is met once.

Two words of seven letters or more at distance one share their first three letters, or else their last four. So the vocabulary
stands in two tries, of the words and of the words reversed, both parted by three letters; the second keeps the pairs whose first
three letters differ. A word goes to two parts, however many words are near it.

A part with more than CROWD words is not given to one task. Its pairs that differ at its root are those with an equal rest after
the edit, since active nodes at distance one move in step: they meet by that rest, at most one word for each letter. Its words
then go on in the parts of the root's children. What all words of a part begin with is passed over at once.

Defined results: a null text has no words; a null id hashes as the empty string; repeated rows count again; words of any length
are compared whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .common import read, saved, share_path, tidied

RUN = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: Letters by which both tries are parted: words of LEAST_LENGTH letters at distance one share as many at one end or the other.
PREFIX = (LEAST_LENGTH - 1) // 2
#: One in so many (document, word) pairs loses a letter.
DAMAGED = 31
#: How many times as frequent as a word its form is, at least.
TIMES = 10
#: Words of a part that one task walks through.
CROWD = 20_000


def damaged_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = DAMAGED) -> DataFrame:
    """(word): a row for each run of at least LEAST_LENGTH letters, A-Z lower-cased, of which some have lost a letter."""
    found = F.regexp_extract_all(text_col, F.lit(f"{RUN}{{{LEAST_LENGTH},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    lower = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    hashed = runs.select("id", lower.alias("w")).select("w", F.crc32(F.concat("id", F.lit(":"), "w")).alias("h"), F.length("w").alias("size"))
    shorter = F.expr("concat(substring(w, 1, cast(h % size as int)), substring(w, cast(h % size as int) + 2))")
    word = F.when(F.col("h") % every != 0, F.col("w")).when(F.col("size") > LEAST_LENGTH, shorter)
    return hashed.select(word.alias("word")).where("word IS NOT NULL")


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_count: int = LEAST_COUNT, every: int = DAMAGED) -> DataFrame:
    """(word, n): the distinct words, those with at least ``least_count`` occurrences."""
    return damaged_words(docs, id_col, text_col, every).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


class Node:
    """The words from ``lo`` to ``hi``, which share their first ``k`` letters; children are made when they are first asked for."""

    __slots__ = ("lo", "hi", "k", "ends", "_kids")

    def __init__(self, words: list[str], lo: int, hi: int, k: int):
        self.lo, self.hi, self.k, self._kids = lo, hi, k, None
        self.ends = len(words[lo]) == k

    def kids(self, words: list[str]) -> dict[str, Node]:
        if self._kids is None:
            self._kids, k, hi = {}, self.k, self.hi
            start = self.lo + self.ends
            while start < hi:
                letter, end = words[start][k], start + 1
                while end < hi and words[end][k] == letter:
                    end += 1
                self._kids[letter] = Node(words, start, end, k + 1)
                start = end
        return self._kids


def near_in_trie(words: list[str], depth: int) -> Iterator[tuple[int, int]]:
    """(i, j) once for each pair of the sorted, distinct ``words`` at distance one; all share their first ``depth`` letters."""
    place = {w: i for i, w in enumerate(words)}
    # with a node stand the nodes at distance one, its parent, and the letter that leads from there
    todo: list[tuple[Node, list[Node], Node | None, str]] = [(Node(words, 0, len(words), depth), [], None, "")]
    while todo:
        node, active, parent, own = todo.pop()
        first = words[node.lo]
        if node.hi - node.lo == 1:  # one word below: its rest leads from an active node to one word at most
            rest = first[node.k :]
            for m in active:
                if m.hi - m.lo > 1:
                    j = place.get(words[m.lo][: m.k] + rest)
                    if j is not None:
                        yield node.lo, j
                elif words[m.lo][m.k :] == rest:
                    yield node.lo, m.lo
            if parent is not None and rest[:1] != own:
                j = place.get(first[: parent.k] + rest)
                if j is not None:
                    yield node.lo, j
            continue
        open_sets = []
        for m in active:
            if m.hi - m.lo == 1:  # the same from the other side
                i = place.get(first[: node.k] + words[m.lo][m.k :])
                if i is not None:
                    yield i, m.lo
            else:
                open_sets.append(m)
                if node.ends and m.ends:
                    yield node.lo, m.lo
        if node.ends and parent is not None and parent.ends:
            yield node.lo, parent.lo
        before: list[Node] = []
        beside = parent.kids(words) if parent is not None else {}
        for letter, kid in node.kids(words).items():
            now = [x for m in open_sets if (x := m.kids(words).get(letter)) is not None]  # the same letter on both sides
            now += before  # replaced
            if letter != own and letter in beside:  # ``own`` deleted
                now.append(beside[letter])
            todo.append((kid, now, node, letter))
            before.append(kid)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of each part; rows come sorted by side, part and word."""

    def pairs(side: int, depth: int, words: list[str], counts: list[int]) -> Iterator[pa.RecordBatch]:
        us, vs = [], []
        for i, j in near_in_trie(words, depth):
            if side and words[i][-PREFIX:] == words[j][-PREFIX:]:
                continue
            us.append(i)
            vs.append(j)
            if len(us) == 1 << 16:
                yield made(side, us, vs, words, counts)
                us, vs = [], []
        if us:
            yield made(side, us, vs, words, counts)

    def made(side, us, vs, words, counts) -> pa.RecordBatch:
        turn = (lambda i: words[i][::-1]) if side else words.__getitem__
        return pa.RecordBatch.from_pydict({"u": list(map(turn, us)), "nu": [counts[i] for i in us], "v": list(map(turn, vs)), "nv": [counts[i] for i in vs]})

    key, words, counts = None, [], []
    for batch in batches:
        for side, part, w, n in zip(*(batch.column(c).to_pylist() for c in ("side", "part", "w", "n")), strict=True):
            if (side, part) != key:
                if len(words) > 1:
                    yield from pairs(key[0], len(key[1]), words, counts)
                key, words, counts = (side, part), [], []
            words.append(w)
            counts.append(n)
    if len(words) > 1:
        yield from pairs(key[0], len(key[1]), words, counts)


@F.pandas_udf(IntegerType())
def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    """How many letters two words begin alike with."""
    return pd.Series([len(commonprefix([x, y])) for x, y in zip(a, b, strict=True)])


PAIR = "u string, nu bigint, v string, nv bigint"


def at_root(words: DataFrame) -> DataFrame:
    """Near pairs that differ at letter ``k`` of their part: words (side, part, k, w, n) with an equal rest after the edit.

    A rest has at most one word for each letter and one without, so what is gathered is bounded by the alphabet.
    """
    whole, rest = F.expr("substring(w, k + 1)"), F.expr("substring(w, k + 2)")
    longer = F.struct(rest.alias("rest"), F.lit(True).alias("longer"))
    shorter = F.struct(whole.alias("rest"), F.lit(False).alias("longer"))
    sides = F.when(F.length("w") > F.col("k"), F.array(longer, shorter)).otherwise(F.array(shorter))
    rows = words.select("side", "part", "w", "n", F.expr("substring(w, k + 1, 1)").alias("letter"), F.explode(sides).alias("x"))
    met = rows.groupBy("side", "part", "x.rest").agg(F.collect_list(F.struct("x.longer", "letter", "w", "n")).alias("all")).where("size(all) > 1")
    both = met.select("side", F.explode("all").alias("a"), "all").where("a.longer").select("side", "a", F.explode("all").alias("b"))
    both = both.where("IF(b.longer, a.letter > b.letter, a.letter <> b.letter)").where(f"side = 0 OR right(a.w, {PREFIX}) <> right(b.w, {PREFIX})")
    turned = [F.when(F.col("side") == 1, F.reverse(f"{x}.w")).otherwise(F.col(f"{x}.w")) for x in "ab"]
    return both.select(turned[0].alias("u"), F.col("a.n").alias("nu"), turned[1].alias("v"), F.col("b.n").alias("nv"))


def near_pairs(vocab: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(u, nu, v, nv), a row for each pair of words (word, n) at distance one; words are distinct and of LEAST_LENGTH letters or more."""
    spark = vocab.sparkSession
    share_path(spark)
    tries = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("w")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("w"))))
    todo = vocab.select(tries.alias("x"), "n").select("x.side", F.substring("x.w", 1, PREFIX).alias("part"), "x.w", "n")
    calm, found = [], []
    while True:
        counts = todo.groupBy("side", "part").agg(F.count("*").alias("size"), F.min("w").alias("least"), F.max("w").alias("last"))
        hot = saved(counts.where(F.col("size") > crowd).select("side", "part", _shared("least", "last").alias("k")))  # a row for CROWD words at least
        if hot.isEmpty():
            calm.append(todo)
            break
        calm.append(todo.join(hot, ["side", "part"], "left_anti"))
        split = saved(todo.join(hot, ["side", "part"]))
        found.append(at_root(split))
        todo = split.where(F.length("w") > F.col("k")).select("side", F.expr("substring(w, 1, k + 1)").alias("part"), "w", "n")
    parts = calm[0]
    for other in calm[1:]:
        parts = parts.unionByName(other)
    out = parts.repartition("side", "part").sortWithinPartitions("side", "part", "w").mapInArrow(tidied(_walk), PAIR)
    for pairs in found:
        out = out.unionByName(pairs)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): each word's form (word, form), the form of that, and so on to the last. Steps double with each round, and
    a form is TIMES as frequent as its word, so rounds are few and there is no way round in a circle."""
    now = saved(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = saved(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")


def group_variants(vocab: DataFrame, times: int = TIMES, crowd: int = CROWD) -> DataFrame:
    """``vocab`` (word, n) with n_near, form, form_n and root."""
    pairs = near_pairs(vocab, crowd)
    both = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("word"), F.col("v").alias("near"), F.col("nv").alias("near_n")), F.struct(F.col("v").alias("word"), F.col("u").alias("near"), F.col("nu").alias("near_n")))).alias("x"))
    best = both.select("x.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    named = vocab.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= times * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("f"))
    named = saved(named.select("word", "n", "n_near", "f.form", "f.form_n"))
    last = roots(named.where("form IS NOT NULL").select("word", "form"))
    return named.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = group_variants(saved(vocabulary(read(spark, sf_dir, "documents"))))
    return out.select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {"op13_spelling_variants": op13_spelling_variants}
