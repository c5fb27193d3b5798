"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

A rolling hash over the hashes of the last lines ends a chunk where it falls on one of EVERY values, so boundaries move
with the text. That is done once for each of WINDOWS, a number of lines, with a seed of its own, as a passage's edges seldom
fall on the boundaries of one. Chunks of two lines or more with at least WORDS words that occur again anywhere lose all
occurrences but the first, by id and place.

Every repeated run of lines with more than ``passage`` words goes whole: for each line that is not blank, the shortest runs of
more words that begin and that end with it are chunks too. They depend on nothing but their own lines, and those within a
run cover it to both its ends. One long line is such a run, also in a text without a newline.

A document is cut once; what is kept of it are the hashes of its lines and chunks. Chunks whose hash occurs once are left
aside; the others are equal if their lists of line hashes are, and the lines of those are compared by their bytes: a hash
that two different lines share makes its chunks stay. What is removed has an equal line in an earlier place, and the first of
equal lines is never removed, so no line is lost from the corpus.

Defined results: a null text stays null and an empty one empty; a text whose lines are all repeated becomes empty.
Rows with equal id and equal text are one document here: they lose the same lines. A null id comes first. All columns
are returned, with the text changed in place; other columns pass through, but one named n_removed is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, saved, sheltered

WINDOWS = (2, 2, 2)
EVERY = 2
WORDS = 8
#: Repeated runs of whole lines with more words than this all go.
PASSAGE = 50
#: Lines that the search for a run's end looks at first; it goes on to ``passage`` + 1, as each has a word.
AHEAD = 12


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for ``value``, which is found once and not for each element that a lambda in ``body`` sees."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _cut(start: str, stop: str) -> str:
    """A chunk of lines [start, stop) as one number."""
    return f"shiftleft(bigint({start}), 32) + {stop}"


START, STOP = "int(shiftright(c, 32))", "int(c & 4294967295L)"


def _chunks(windows: tuple[int, ...], every: int) -> list[str]:
    """For each window the chunks of two lines or more between the boundaries in ``__hash`` (hashes of the lines)."""
    each = []
    for seed, window in enumerate(windows):
        at = ", ".join(f"__hash[i - {k}]" for k in range(window, 0, -1))
        cuts = f"filter(sequence(1, size(__hash)), i -> i = size(__hash) OR (i >= {window} AND pmod(xxhash64({at}, {seed}), {every}) = 0))"
        before = "concat(array(0), slice(b, 1, greatest(size(b) - 1, 0)))"
        each.append(_let(cuts, "b", f"filter(zip_with(b, {before}, (stop, start) -> if(stop - start >= 2, {_cut('start', 'stop')}, -1L)), x -> x >= 0)"))
    return each


def _runs(passage: int) -> list[str]:
    """The shortest runs of more than ``passage`` words from each line on, and up to each line, by ``__words`` of the lines."""

    def lines(part: str, ahead: int) -> str:
        return f"aggregate({part.format(n=ahead)}, struct(0 AS s, 0 AS n), (a, x) -> if(a.s > {passage}, a, struct(a.s + x AS s, a.n + 1 AS n)), a -> if(a.s > {passage}, a.n, CAST(NULL AS INT)))"

    def runs(part: str, start: str, stop: str) -> str:
        found = f"coalesce({lines(part, min(AHEAD, passage + 1))}, {lines(part, passage + 1)})"
        spans = f"transform(w, (x, k) -> {_let(found, 'n', f'if(n IS NULL, -1L, {_cut(start, stop)})')})"
        return _let("filter(__words, x -> x > 0)", "w", _let("filter(sequence(0, size(__words) - 1), i -> __words[i] > 0)", "at", f"filter({spans}, x -> x >= 0)"))

    return [runs("slice(w, k + 1, {n})", "at[k]", "at[k + n - 1] + 1"), runs("reverse(slice(w, greatest(k + 2 - {n}, 1), least(k + 1, {n})))", "at[k + 1 - n]", "at[k] + 1")]


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", windows: tuple[int, ...] = WINDOWS, every: int = EVERY, words: int = WORDS, passage: int | None = PASSAGE) -> DataFrame:
    """(__id, __own, __cuts): for each document that has any, the chunks to be removed."""
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__own"), _lines(text_col).alias("__lines"))
    base = texts.withColumn("__hash", F.transform("__lines", lambda x: F.xxhash64(x))).withColumn("__words", F.transform("__lines", lambda x: F.size(F.filter(F.split(x, " "), lambda w: w != ""))))
    named = f"array_distinct(concat({', '.join(_chunks(windows, every) + (_runs(passage) if passage is not None else []))}))"
    enough = f"filter({named}, c -> aggregate(slice(__words, {START} + 1, {STOP} - {START}), 0, (s, x) -> s + x) >= {words})"
    cut = base.withColumn("__cuts", F.expr(enough)).withColumn("__sums", F.expr(f"transform(__cuts, c -> xxhash64(slice(__hash, {START} + 1, {STOP} - {START})))"))
    cut = saved(cut.select("__id", "__own", "__hash", "__cuts", "__sums"))
    each = cut.select("__id", "__own", F.explode(F.arrays_zip(F.col("__cuts").alias("cut"), F.col("__sums").alias("sum"))).alias("c")).select("__id", "__own", "c.cut", "c.sum")
    # the small sides are written down, so that either join has two plain shuffles and Spark can split a hot key's rows
    more = saved(each.groupBy("sum").agg(F.count("*").alias("n")).where("n > 1").select("sum"))
    own = saved(each.join(more, "sum", "left_semi").groupBy("__id", "__own").agg(F.collect_set("cut").alias("__some")))

    def with_own(left: DataFrame) -> DataFrame:
        right = own.select(F.col("__id").alias("__i"), F.col("__own").alias("__o"), "__some")
        return left.join(right, left["__id"].eqNullSafe(right["__i"]) & (left["__own"] == right["__o"])).drop("__i", "__o")

    places = with_own(cut.select("__id", "__own", "__hash")).select("__id", "__own", F.explode(F.expr(f"transform(__some, c -> struct(c AS cut, slice(__hash, {START} + 1, {STOP} - {START}) AS key))")).alias("c"))
    places = saved(places.select(F.struct("__id", "__own", "c.cut").alias("place"), "c.key"))
    first = places.groupBy("key").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("NOT (first <=> last)").drop("last")
    # hashes that stand for two lines, by the bytes of all lines in those chunks
    among = F.expr(f"array_distinct(flatten(transform(__some, c -> sequence({START}, {STOP} - 1))))")
    lines = with_own(texts).select(F.explode(F.transform(among, lambda i: F.get("__lines", i))).alias("l")).select(F.xxhash64("l").alias("h"), "l")
    unsure = lines.groupBy("h").agg(F.min("l").alias("a"), F.max("l").alias("b")).where("a <> b").select("h")
    wrong = first.select("key", F.explode("key").alias("h")).join(unsure, "h", "left_semi").select("key").distinct()
    sure = saved(first.join(wrong, "key", "left_anti"))
    again = places.join(sure, "key").where(~F.col("place").eqNullSafe(F.col("first")))
    return again.groupBy("place.__id", "place.__own").agg(F.collect_set("place.cut").alias("__cuts"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with repeated chunks of lines cut from the text, and n_removed, the number of lines cut."""
    names = [c for c in docs.columns if c != "n_removed"]
    docs, _ = sheltered(docs.select(*names), id_col, text_col)
    spans = repeated(docs, id_col, text_col, **options)
    marked = docs.withColumn("__mark", F.xxhash64(text_col))
    joined = marked.join(spans, marked[id_col].eqNullSafe(spans["__id"]) & (marked["__mark"] == spans["__own"]), "left")
    gone = F.expr(f"array_distinct(flatten(transform(__cuts, c -> sequence({START}, {STOP} - 1))))")

    def left(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    cut = F.get(F.transform(F.array(_lines(text_col)), left), 0)  # so that a text is split once, not for each line
    out = joined.withColumn("__gone", gone)
    columns = [F.when(F.col("__gone").isNull(), F.col(c)).otherwise(cut).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    out = out.select(*columns, F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("bigint").alias("n_removed"))
    return out.select(*(F.col(i).alias(c) for i, c in zip(docs.columns, names, strict=True)), "n_removed")


def op4_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op4_line_chunks": op4_line_chunks}
