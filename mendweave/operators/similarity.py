"""Similarity operators: TF-IDF cosine, shingle Jaccard, titles' uniqueness, ranking and separability of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mendweave.functions import text as X
from mendweave.operators import copies as C
from mendweave.operators import pairs as P

#: Similarity from which a candidate counts.
THRESHOLD = 0.8


def term_counts(docs: DataFrame, id_col: str, tokens: Column, stop: tuple[str, ...] = ()) -> DataFrame:
    """(id, term, tf). Stop words go once the tokens are rows, where a set test in generated code does it."""
    terms = docs.select(id_col, F.explode(tokens).alias("term"))
    terms = terms.where(~F.col("term").isin(*stop)) if stop else terms
    return terms.groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def idf(terms: DataFrame, n_docs: int) -> DataFrame:
    """(term, df, idf) with idf = ln((1 + n) / (1 + df)) + 1."""
    return terms.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log((1.0 + n_docs) / (1 + F.col("df"))) + 1)


def weights(terms: DataFrame, idfs: DataFrame, id_col: str) -> DataFrame:
    """(id, term, w): weights scaled to a length of 1 for each document."""
    raw = terms.join(idfs.select("term", "idf"), "term").withColumn("w", F.col("tf") * F.col("idf"))
    length = raw.groupBy(F.col(id_col).alias("__of")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("__length"))
    return raw.join(length, F.col(id_col) == F.col("__of")).select(id_col, "term", "idf", (F.col("w") / F.col("__length")).alias("w"))


def working_idf(own: DataFrame, corpus_idf: DataFrame, n_corpus: int) -> DataFrame:
    """idf of a working set's terms: the corpus', or for words unknown there by their count in the working set."""
    df = own.groupBy("term").agg(F.count("*").alias("df_own"))
    unseen = F.log((1.0 + n_corpus) / (1 + F.col("df_own"))) + 1
    return df.join(corpus_idf.select("term", F.col("idf").alias("known")), "term", "left").select("term", F.coalesce("known", unseen).alias("idf"))


def cosine(queries: DataFrame, docs: DataFrame, id_col: str) -> DataFrame:
    """(query, doc, cosine) for pairs that share a term; both sides hold weights (id, term, w).

    A join on terms; the queries are a stated, bounded part of the documents, so no group is paired with itself.
    """
    q = queries.select(F.col(id_col).alias("query"), "term", F.col("w").alias("qw"))
    d = docs.select(F.col(id_col).alias("doc"), "term", F.col("w").alias("dw"))
    return q.join(d, "term").where("query <> doc").groupBy("query", "doc").agg(F.sum(F.col("qw") * F.col("dw")).alias("cosine"))


def best_cosine(weighted: DataFrame, queries: str, id_col: str, n: int, group: str | None = None) -> DataFrame:
    """(query, doc, cosine): the rows of ``cosine`` that are among the ``n`` best of their query, and few others; the queries are those
    rows of ``weighted`` that the condition names. Pairs of different ``group`` are none. No pair but the best is written."""
    return P.best(P.gathered(weighted.where(queries), id_col, group), P.gathered(weighted, id_col, group), n)


def like_cosine(weighted: DataFrame, queries: str, id_col: str, threshold: float) -> DataFrame:
    """(query, doc, cosine): the rows of ``cosine`` that reach the threshold; the queries are as for ``best_cosine``."""
    return P.kept(P.gathered(weighted.where(queries), id_col), P.gathered(weighted, id_col), lambda x, _, __: x >= threshold)


def pair_cosine(pairs: DataFrame, weighted: DataFrame, id_col: str) -> DataFrame:
    """(query, doc, cosine) of stated pairs (query, doc); those that share no term have no row."""
    q = weighted.select(F.col(id_col).alias("query"), "term", F.col("w").alias("qw"))
    d = weighted.select(F.col(id_col).alias("doc"), "term", F.col("w").alias("dw"))
    met = pairs.select("query", "doc").distinct().join(q, "query").join(d, ["doc", "term"])
    return met.groupBy("query", "doc").agg(F.sum(F.col("qw") * F.col("dw")).alias("cosine"))


def top_terms(weighted: DataFrame, id_col: str, n: int = 7) -> DataFrame:
    """The n heaviest terms of each document, as one string."""
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc(F.round("w", 9)), "term"))
    best = weighted.withColumn("rank", rank).where(F.col("rank") <= n)
    return best.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), " ").alias("terms"))


def top_matches(pairs: DataFrame, n: int, query: str = "query", doc: str = "doc", score: str = "cosine") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(F.round(score, 9)), doc))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= n)


def separable(pairs: DataFrame, query: str = "query", doc: str = "doc", score: str = "cosine", threshold: float = THRESHOLD, strict: bool = True) -> DataFrame:
    """For each query its best document, if that reaches the threshold and, when strict, the second does not."""
    two = top_matches(pairs, 2, query, doc, score)
    best = two.groupBy(query).agg(F.max_by(doc, F.struct(-F.col("rank"))).alias(doc), F.max(score).alias("top1"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col(score))), F.lit(0.0)).alias("top2"))
    return best.where((F.col("top1") >= threshold) & (F.col("top2") < threshold) if strict else F.col("top1") >= threshold)


def contains_either(a: Column, b: Column) -> Column:
    """One token set holds the other: short texts are compared only then."""
    return (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)


def containing(sets: DataFrame, queries: str, id_col: str, elements: str) -> DataFrame:
    """(query, doc, k): pairs of which one's set holds the other's, k elements in common. ``sets``: (id, elements), an array whose
    repeats do not count; the queries are those rows that the condition names."""
    own = sets.select(F.col(id_col).cast("bigint").alias("id"), F.expr(queries).alias("asked"), F.array_distinct(F.transform(elements, lambda x: F.xxhash64(x))).alias("h"))
    return P.nested(own.where("asked").select("id", "h"), own.select("id", "h"))


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, k: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """(id, class_id, n_links): documents link if the Jaccard similarity of their word shingles reaches the threshold.

    Texts with the same words are one class, named by its smallest id; n_links counts the other classes linked. How they are found
    is told in ``copies``.
    """
    words = F.get(F.transform(F.array(X.words(text_col)), lambda w: F.struct(F.array_join(w, " ").alias("t"), F.transform(X.shingles(w, k), lambda s: F.xxhash64(s)).alias("h"))), 0)
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), words.alias("w"))
    texts = own.select("id", F.xxhash64("w.t").alias("key"), F.xxhash64(F.lit(1), "w.t").alias("key2"), F.array_distinct(F.coalesce("w.h", F.array().cast("array<bigint>"))).alias("h"))
    named, linked = C.links(texts, threshold)
    counts = linked.select(F.explode(F.array("u", "v")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n"))
    return named.join(counts, "class_id", "left").select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "class_id", F.coalesce("n", F.lit(0)).alias("n_links"))


def title_counts(pages: DataFrame, site: str, title: str) -> DataFrame:
    """With n_same: the pages of the site with the same title."""
    return pages.withColumn("n_same", F.count("*").over(Window.partitionBy(site, title)))


def strip_common_parts(pages: DataFrame, id_col: str, site: str, title: str, least: int = 2) -> DataFrame:
    """(id, unique_title): titles without the parts that ``least`` pages of the site share; one of nothing else stays."""
    parts = pages.select(id_col, site, F.posexplode(X.title_parts(title)).alias("pos", "part"))
    common = parts.groupBy(site, "part").agg(F.countDistinct(id_col).alias("n"))
    kept = parts.join(common, [site, "part"]).where(F.col("n") < least)
    own = kept.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]).alias("parts"))
    return pages.select(id_col, title).join(own, id_col, "left").select(id_col, F.coalesce(F.array_join("parts", " "), F.col(title)).alias("unique_title"))


def unique_titles(pages: DataFrame, id_col: str, site: str, title: str, key: str, text: str) -> DataFrame:
    """(id, unique): no other URL of the site has the title with another text. A page without a title is not unique.

    Counted, not compared: of the pages with a site's title those of another URL and another text are all, less those of the
    same URL, less those of the same text, and those of both once more.
    """
    own = pages.select(F.col(id_col), F.col(site).alias("__s"), F.col(title).alias("__t"), F.col(key).alias("__k"), F.md5(F.col(text).cast("binary")).alias("__x"))
    by = lambda name, *more: own.groupBy("__s", "__t", *more).agg(F.count("*").alias(name))
    met = own.join(by("n"), ["__s", "__t"]).join(by("nk", "__k"), ["__s", "__t", "__k"]).join(by("nx", "__x"), ["__s", "__t", "__x"]).join(by("nb", "__k", "__x"), ["__s", "__t", "__k", "__x"])
    return met.select(id_col, ((F.col("__t") != "") & (F.col("n") - F.col("nk") - F.col("nx") + F.col("nb") == 0)).alias("unique"))


def title_weights(pages: DataFrame, id_col: str, title: str) -> DataFrame:
    """(id, term, w) of the titles that are unique on their site; ``pages`` also holds ``unique``."""
    fair = pages.where(F.col("unique")).select(id_col, F.explode(X.words(title)).alias("term"))
    terms = fair.groupBy(id_col, "term").agg(F.count("*").alias("tf"))
    return weights(terms, idf(terms, pages.count()), id_col).select(id_col, "term", "w")


def title_similar(targets: DataFrame, pages: DataFrame, id_col: str, site: str, title: str) -> DataFrame:
    """(query, doc, cosine) of titles within a site where the words of one hold all of the other's.

    ``pages``: (id, site, title, unique), titles without the parts that the site shares; ``targets`` are some of its ids. Titles
    that are not unique are compared with none.
    """
    fair = pages.where(F.col("unique")).select(F.col(id_col).alias("__id"), F.col(site).alias("__site"), X.words(title).alias("__w"))
    w = title_weights(pages, id_col, title).withColumnRenamed(id_col, "__id")
    each = w.join(fair.select("__id", "__site", F.size(F.array_distinct("__w")).alias("__n")), "__id")
    q = each.join(targets.select(F.col(id_col).alias("__id")), "__id", "left_semi").select(F.col("__id").alias("query"), "__site", "term", F.col("w").alias("a"), F.col("__n").alias("na"))
    d = each.select(F.col("__id").alias("doc"), "__site", "term", F.col("w").alias("b"), F.col("__n").alias("nb"))
    met = q.join(d, ["__site", "term"]).where("query <> doc").groupBy("query", "doc", "na", "nb").agg(F.count("*").alias("k"), F.sum(F.col("a") * F.col("b")).alias("cosine"))
    return met.where("k = na OR k = nb").select("query", "doc", "cosine")


def similar(title: DataFrame, content: DataFrame, threshold: float = THRESHOLD, order: tuple[str, ...] = ("title", "content"), strict: bool = True) -> DataFrame:
    """(query, doc, type, score, rank): the document that titles tell apart and the one that contents do, in the given order.

    Both hold (query, doc, cosine). One way tells a document apart if it alone reaches the threshold; unless ``strict``, if it is
    the best that does.
    """
    found = {"title": title, "content": content}
    both = None
    for k, kind in enumerate(order):
        best = separable(found[kind], threshold=threshold, strict=strict).select("query", "doc", F.lit(kind).alias("type"), F.round("top1", 9).alias("score"), F.lit(k).alias("__o"))
        both = best if both is None else both.union(best)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("__o"))
    return both.withColumn("rank", rank.cast("bigint")).drop("__o")
