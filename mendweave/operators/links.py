"""Links of two versions of a page matched by their anchors, and by the texts beside them where anchors do not decide.

Similarity is the cosine of TF-IDF weights of two texts, each distinct text weighted once. Texts of a pair of pages meet by the
terms that they share, so texts without one never meet, and a text that many links carry counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendweave.functions import text as X
from mendweave.functions import trees as T
from mendweave.functions import urls as U
from mendweave.operators import similarity as S

#: Share of the anchor in a link's score; the rest is that of the texts beside it.
ANCHOR = 0.75


def signatures(pages: DataFrame, id_col: str, url: str = "url", html: str = "html") -> DataFrame:
    """(id, link, anchor, sig): each page's links as absolute live URLs, their texts, and the texts beside them."""
    own = pages.select(id_col, url, F.explode(T.link_signatures(html)).alias("l"))
    return own.select(id_col, U.strip_archive(U.resolve(url, "l.href")).alias("link"), F.col("l.anchor").alias("anchor"), F.array_compact(F.array("l.before", "l.after")).alias("sig"))


def _texts(links: DataFrame, *keys: str) -> DataFrame:
    """(keys, kind, text), distinct: anchors, and texts beside links."""
    beside = F.transform("sig", lambda s: F.struct(F.lit("sig").alias("kind"), s.alias("text")))
    both = F.concat(F.array(F.struct(F.lit("anchor").alias("kind"), F.col("anchor").alias("text"))), beside)
    return links.select(*keys, F.explode(both).alias("x")).select(*keys, "x.kind", "x.text").distinct()


def text_weights(texts: DataFrame) -> DataFrame:
    """(text, term, w) of distinct texts (text); each text is a document of the corpus."""
    terms = S.term_counts(texts, "text", X.words("text"))
    return S.weights(terms, S.idf(terms, texts.count()), "text").select("text", "term", "w")


def similar_texts(pairs: DataFrame, links: DataFrame, old: str, new: str, id_col: str) -> DataFrame:
    """(old, new, kind, told, tnew, cosine): texts of both pages of each pair that share a term; anchors meet anchors only."""
    texts = _texts(links, id_col)
    weighted = texts.join(text_weights(texts.select("text").distinct()), "text")
    a = pairs.select(old, new).join(weighted.select(F.col(id_col).alias(old), "kind", F.col("text").alias("told"), "term", F.col("w").alias("a")), old)
    b = pairs.select(old, new).join(weighted.select(F.col(id_col).alias(new), "kind", F.col("text").alias("tnew"), "term", F.col("w").alias("b")), new)
    return a.join(b, [old, new, "kind", "term"]).groupBy(old, new, "kind", "told", "tnew").agg(F.sum(F.col("a") * F.col("b")).alias("cosine"))


def matched(pairs: DataFrame, links: DataFrame, old: str, new: str, id_col: str) -> DataFrame:
    """(old, new, link, anchor, sig, found, by_anchor, by_sig): for each link of the old page and each target of the new page's
    links the best similarity of anchors, and of texts beside them; 0 where nothing is shared, and no row where both are 0."""
    alike = similar_texts(pairs, links, old, new, id_col)
    ours = links.select(F.col(id_col).alias(old), "link", "anchor", "sig")
    theirs = links.select(F.col(id_col).alias(new), F.col("link").alias("found"), F.col("anchor").alias("anchor2"), F.col("sig").alias("sig2"))
    key = [old, new, "link", "anchor", "sig", "found"]
    anchors = alike.where("kind = 'anchor'").join(ours, (F.col("told") == F.col("anchor")) & (alike[old] == ours[old])).drop(ours[old])
    anchors = anchors.join(theirs, (F.col("tnew") == F.col("anchor2")) & (anchors[new] == theirs[new])).drop(theirs[new])
    beside = alike.where("kind = 'sig'").join(ours.withColumn("s", F.explode(F.array_distinct("sig"))), (F.col("told") == F.col("s")) & (alike[old] == ours[old])).drop(ours[old])
    beside = beside.join(theirs.withColumn("s2", F.explode(F.array_distinct("sig2"))), (F.col("tnew") == F.col("s2")) & (beside[new] == theirs[new])).drop(theirs[new])
    both = anchors.select(*key, F.col("cosine").alias("by_anchor"), F.lit(0.0).alias("by_sig")).union(beside.select(*key, F.lit(0.0), F.col("cosine")))
    return both.groupBy(*key).agg(F.max("by_anchor").alias("by_anchor"), F.max("by_sig").alias("by_sig"))


def _best_two(rows: DataFrame, key: list[str], score: str) -> DataFrame:
    """The best target of each key, its score and the next one's, by a bounded aggregate."""
    each = rows.groupBy(*key).agg(F.expr(f"slice(array_sort(collect_list(struct(-round({score}, 9) AS s, found))), 1, 2)").alias("two"))
    return each.select(*key, F.col("two")[0]["found"].alias("found"), (-F.col("two")[0]["s"]).alias("top1"), F.coalesce(-F.get("two", 1)["s"], F.lit(0.0)).alias("top2"))


def same_link(rows: DataFrame, old: str, new: str, threshold: float = S.THRESHOLD) -> DataFrame:
    """(old, new, link, found, way, score): where the new page has each link of the old one, from ``matched``.

    One anchor alone reaches the threshold: that. Several do: of them the one whose neighbouring texts alone reach it. Of
    several places where the old page has the link, the best match counts.
    """
    key = [old, new, "link", "anchor", "sig"]
    good = rows.where(F.round("by_anchor", 9) >= threshold)
    n = good.groupBy(*key).agg(F.count("*").alias("n"))
    only = good.join(n.where("n = 1"), key).select(*key, "found", F.lit("anchor").alias("way"), F.round("by_anchor", 9).alias("score"))
    # an old link may have no text beside it: arrays as keys are equal then too
    several = _best_two(good.join(n.where("n > 1"), key), key, "by_sig").where((F.col("top1") >= threshold) & (F.col("top2") < threshold))
    found = only.union(several.select(*key, "found", F.lit("sig"), "top1"))
    best = found.groupBy(old, new, "link").agg(F.min(F.struct((-F.col("score")).alias("s"), "way", "found")).alias("b"))
    return best.select(old, new, "link", "b.found", "b.way", (-F.col("b.s")).alias("score"))


def weighted(by_anchor: Column, by_sig: Column) -> Column:
    return ANCHOR * by_anchor + (1 - ANCHOR) * by_sig


def likely_links(rows: DataFrame, old: str, new: str, first: int = 10) -> DataFrame:
    """(old, new, link, found, score, rank): the ``first`` targets on the new page most like each old link, by both texts."""
    score = F.round(weighted(F.col("by_anchor"), F.col("by_sig")), 9)
    best = rows.select(old, new, "link", "found", score.alias("score")).groupBy(old, new, "link", "found").agg(F.max("score").alias("score"))
    top = best.groupBy(old, new, "link").agg(F.expr(f"slice(array_sort(collect_list(struct(-score AS s, found))), 1, {first})").alias("top"))
    each = top.select(old, new, "link", F.posexplode("top").alias("k", "x"))
    return each.select(old, new, "link", "x.found", (-F.col("x.s")).alias("score"), (F.col("k") + 1).cast("bigint").alias("rank"))
