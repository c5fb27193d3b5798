"""Text, TF-IDF, shingles, titles and candidate ranking."""

from __future__ import annotations

from mendweave.functions import html as H
from mendweave.functions import text as X
from mendweave.functions import urls as U
from mendweave.operators import cosines, ordered
from mendweave.operators import similarity as S

from .common import URLS, F, Window, query, table, written
from .html import TITLE

#: Phrases of known passages that are sent to all executors at most, some 100 bytes each.
BROADCAST_PHRASES = 500_000

_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_WORDS = r"regexp_extract_all(lower(replace(text, '_', ' ')), '[\p{L}\p{N}_]+')"
TERMS = f"""tok AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term NOT IN ({_STOP}) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df, ln((1.0 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
w AS (SELECT doc_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS w FROM tf JOIN df USING (term))"""


def documents(spark, d):
    return table(spark, d, "documents")


def weighted(spark, d):
    docs = documents(spark, d)
    terms = S.term_counts(docs, "doc_id", X.words("text"), X.STOP_WORDS)
    return S.weights(terms, S.idf(terms, docs.count()), "doc_id")


#: The stated queries.
QUERIES = "doc_id % 50 = 0"


def packs(spark, d, queries=QUERIES):
    return cosines.packs(documents(spark, d), "doc_id", X.words("text"), X.STOP_WORDS, queries)


@query("text_tokens", f"WITH {TERMS} SELECT doc_id, sum(tf)::BIGINT AS n, count(*) AS n_distinct FROM tf GROUP BY 1")
def text_tokens(spark, d):
    return S.term_counts(documents(spark, d), "doc_id", X.words("text"), X.STOP_WORDS).groupBy("doc_id").agg(F.sum("tf").alias("n"), F.count("*").alias("n_distinct"))


@query("text_df", f"WITH {TERMS} SELECT term, df, round(idf, 6) AS idf FROM df")
def text_df(spark, d):
    docs = documents(spark, d)
    return S.idf(S.term_counts(docs, "doc_id", X.words("text"), X.STOP_WORDS), docs.count()).select("term", "df", F.round("idf", 6).alias("idf"))


@query("text_tfidf_topn", f"WITH {TERMS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 9) DESC, term) AS k FROM w) SELECT doc_id, string_agg(term, ' ' ORDER BY k) AS terms FROM r WHERE k <= 7 GROUP BY 1")
def text_tfidf_topn(spark, d):
    return S.top_terms(weighted(spark, d), "doc_id")


_COSINE = f"{TERMS}, c AS (SELECT a.doc_id AS query, b.doc_id AS doc, sum(a.w * b.w) AS cosine FROM w a JOIN w b USING (term) WHERE a.doc_id <> b.doc_id AND a.doc_id % 50 = 0 GROUP BY 1, 2)"


@query("text_cosine_pairs", f"WITH {_COSINE} SELECT query, doc, round(cosine, 6) AS cosine FROM c WHERE cosine >= 0.8")
def text_cosine_pairs(spark, d):
    """The queries are the documents whose id is divisible by 50; they are compared with all others."""
    return cosines.kept(packs(spark, d), lambda x, _, __: x >= 0.8).select("query", "doc", F.round("cosine", 6).alias("cosine"))


#: The same of all documents.
_ALL = _COSINE.replace(" AND a.doc_id % 50 = 0", "")


@query("text_similar_topn", f"WITH {_ALL}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(cosine, 9) DESC, doc) AS rank FROM c) SELECT query, doc, rank FROM r WHERE rank <= 3")
def text_similar_topn(spark, d):
    return S.top_matches(cosines.best(packs(spark, d, "true"), 3), 3).select("query", "doc", F.col("rank").cast("bigint").alias("rank"))


@query(
    "text_workingset_cosine",
    rf"""WITH {TERMS}, b AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark) WHERE term NOT IN ({_STOP}) GROUP BY 1, 2),
i AS (SELECT term, coalesce(any_value(df.idf), ln((1.0 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1) AS idf FROM b LEFT JOIN df USING (term) GROUP BY term),
bw AS (SELECT item_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY item_id)) AS w FROM b JOIN i USING (term))
SELECT item_id, count(*) AS n, round(max(w), 6) AS heaviest, round(sum(w), 6) AS total FROM bw GROUP BY 1""",
)
def text_workingset_cosine(spark, d):
    """Weights of benchmark texts with the documents' idf; unknown words get theirs from the working set."""
    docs, items = documents(spark, d), table(spark, d, "benchmark")
    n = docs.count()
    corpus = S.idf(S.term_counts(docs, "doc_id", X.words("text"), X.STOP_WORDS), n)
    own = S.term_counts(items, "item_id", X.words("text"), X.STOP_WORDS)
    w = S.weights(own, S.working_idf(own, corpus, n), "item_id")
    return w.groupBy("item_id").agg(F.count("*").alias("n"), F.round(F.max("w"), 6).alias("heaviest"), F.round(F.sum("w"), 6).alias("total"))


def _grams(source: str, key: str, k: int, words: str) -> str:
    """CTEs in DuckDB: t_<key> (key, w) and g_<key>, the distinct k-word shingles; fewer words make one."""
    lead = " || ' ' || ".join(["w", *(f"lead(w, {i}) OVER x" for i in range(1, k))])
    return f"""t_{key} AS (SELECT {key}, {words} AS w FROM {source}),
g_{key} AS (SELECT DISTINCT {key}, g FROM (
    SELECT {key}, {lead} AS g FROM (SELECT {key}, unnest(w) AS w, unnest(range(len(w))) AS p FROM t_{key} WHERE len(w) > {k}) WINDOW x AS (PARTITION BY {key} ORDER BY p)
    UNION ALL SELECT {key}, array_to_string(w, ' ') FROM t_{key} WHERE len(w) BETWEEN 1 AND {k}) WHERE g IS NOT NULL)"""


_WORDSETS = f"tok AS (SELECT DISTINCT doc_id, unnest({_WORDS}) AS w FROM documents), wn AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY 1)"
_SHINGLES = _grams("documents", "doc_id", 5, _WORDS) + ", sn AS (SELECT doc_id, count(g) AS n FROM documents LEFT JOIN g_doc_id USING (doc_id) GROUP BY 1)"


@query("text_shingles", f"WITH {_SHINGLES} SELECT doc_id, n FROM sn")
def text_shingles(spark, d):
    return documents(spark, d).select("doc_id", F.size(X.shingles(X.words("text"))).cast("bigint").alias("n"))


@query(
    "text_near_dups",
    f"""WITH {_SHINGLES}, own AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY array_to_string(w, ' ')) AS class_id FROM t_doc_id),
e AS (SELECT doc_id AS class_id, g, n FROM g_doc_id JOIN sn USING (doc_id) WHERE doc_id IN (SELECT class_id FROM own)),
pr AS (SELECT a.class_id AS u, b.class_id AS v, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.g = b.g AND a.class_id <> b.class_id GROUP BY 1, 2),
l AS (SELECT u, count(*) AS n FROM pr WHERE k >= 0.8 * (na + nb - k) - 1e-9 GROUP BY 1)
SELECT doc_id, class_id, coalesce(l.n, 0) AS n_links FROM own LEFT JOIN l ON own.class_id = l.u""",
)
def text_near_dups(spark, d):
    return S.near_duplicates(documents(spark, d), "doc_id", "text")


@query("text_jaccard_next", f"""WITH {_SHINGLES}, c AS (SELECT a.doc_id, count(*) AS k FROM g_doc_id a JOIN g_doc_id b ON b.doc_id = a.doc_id + 1 AND a.g = b.g GROUP BY 1)
SELECT x.doc_id, y.doc_id AS other, round(CASE WHEN x.n + y.n = 0 THEN 1 ELSE coalesce(k, 0) / (x.n + y.n - coalesce(k, 0))::DOUBLE END, 6) AS j FROM sn x JOIN sn y ON y.doc_id = x.doc_id + 1 LEFT JOIN c ON c.doc_id = x.doc_id""")
def text_jaccard_next(spark, d):
    own = documents(spark, d).select("doc_id", X.shingles(X.words("text")).alias("x"))
    other = own.select(F.col("doc_id").alias("other"), F.col("x").alias("y"))
    return own.join(other, F.col("other") == F.col("doc_id") + 1).select("doc_id", "other", F.round(U.jaccard("x", "y"), 6).alias("j"))


@query(
    "text_containment",
    rf"""WITH {_WORDSETS}, c AS (SELECT a.doc_id AS query, b.doc_id AS doc, count(*) AS k FROM tok a JOIN tok b ON a.w = b.w AND a.doc_id <> b.doc_id WHERE a.doc_id % 50 = 0 GROUP BY 1, 2)
SELECT query, doc, k FROM c JOIN wn x ON x.doc_id = query JOIN wn y ON y.doc_id = doc WHERE k = x.n OR k = y.n""",
)
def text_containment(spark, d):
    """Of the words of whole texts: which texts does a query (ids divisible by 50) hold, or lie in?"""
    return S.containing(documents(spark, d).select("doc_id", X.words("text").alias("w")), QUERIES, "doc_id", "w")


_PLAIN = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query("benchmark_hits", f"WITH {_grams('documents', 'doc_id', 8, _PLAIN)}, {_grams('benchmark', 'item_id', 8, _PLAIN)} SELECT doc_id, item_id, count(*) AS n FROM g_doc_id JOIN g_item_id USING (g) WHERE len(string_split(g, ' ')) = 8 GROUP BY 1, 2")
def benchmark_hits(spark, d):
    """Shared eight-word phrases of documents and known passages.

    Phrases meet by a hash, and count if they are equal. The passages' phrases are broadcast if they are few.
    """

    def grams(df, key):
        w = df.select(key, F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), 1).alias("w")).where("size(w) >= 8")
        return w.select(key, F.explode(X.shingles(F.col("w"), 8)).alias("g")).withColumn("h", F.xxhash64("g"))

    known = written(grams(table(spark, d, "benchmark"), "item_id").withColumnRenamed("g", "k"))
    known = F.broadcast(known) if known.count() <= BROADCAST_PHRASES else known
    met = grams(documents(spark, d), "doc_id").join(known, "h").where("g = k")
    return met.groupBy("doc_id", "item_id").agg(F.count("*").alias("n"))


_TI = rf"""{URLS}, t AS (SELECT page_id, host, CASE WHEN {TITLE} LIKE '%Wayback Machine%' THEN '' ELSE {TITLE} END AS title FROM s)"""
_PARTS = r"""list_filter(list_transform(string_split_regex(title, '\s*(?:_|\||｜|::)\s*|\s+\p{Pd}+\s+'), lambda x: trim(x)), lambda x: x <> '')"""


def titles(spark, d):
    return table(spark, d, "pages").select("page_id", U.host("url").alias("host"), H.title("html").alias("title"))


@query("title_unique", f"WITH {_TI} SELECT page_id, count(*) OVER (PARTITION BY host, title) AS n_same FROM t")
def title_unique(spark, d):
    return S.title_counts(titles(spark, d), "host", "title").select("page_id", "n_same")


@query("title_common_parts", f"WITH {_TI}, p AS (SELECT page_id, host, unnest({_PARTS}) AS part FROM t) SELECT host, part, count(DISTINCT page_id) AS n FROM p GROUP BY 1, 2")
def title_common_parts(spark, d):
    own = titles(spark, d).select("page_id", "host", F.explode(X.title_parts("title")).alias("part"))
    return own.groupBy("host", "part").agg(F.countDistinct("page_id").alias("n"))


@query(
    "title_strip_common",
    f"""WITH {_TI}, q AS (SELECT page_id, host, title, {_PARTS} AS parts FROM t), p AS (SELECT page_id, host, unnest(parts) AS part, unnest(range(0, len(parts))) AS pos FROM q),
c AS (SELECT host, part, count(DISTINCT page_id) AS n FROM p GROUP BY 1, 2), o AS (SELECT page_id, string_agg(part, ' ' ORDER BY pos, part) AS u FROM p JOIN c USING (host, part) WHERE n < 2 GROUP BY 1)
SELECT page_id, coalesce(u, title) AS unique_title FROM t LEFT JOIN o USING (page_id)""",
)
def title_strip_common(spark, d):
    return S.strip_common_parts(titles(spark, d), "page_id", "host", "title")


@query("title_plain", rf"WITH {_TI} SELECT page_id, trim(regexp_replace(regexp_replace(replace(coalesce(({_PARTS})[1], ''), '''', ''), '[^0-9A-Za-z _-]', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM t")
def title_plain(spark, d):
    return titles(spark, d).select("page_id", X.plain_title("title").alias("plain"))


_TW = rf"""{_TI}, k AS (SELECT page_id, host, unnest(regexp_extract_all(lower(replace(title, '_', ' ')), '[\p{{L}}\p{{N}}_]+')) AS term FROM t)"""


@query(
    "title_candidates",
    f"""WITH {_TW}, d AS (SELECT DISTINCT page_id, host, term FROM k), n AS (SELECT page_id, count(*) AS n FROM d GROUP BY 1),
p AS (SELECT a.page_id AS query, b.page_id AS doc, count(*) AS same FROM d a JOIN d b ON a.host = b.host AND a.term = b.term AND a.page_id <> b.page_id WHERE a.page_id % 50 = 0 GROUP BY 1, 2)
SELECT query, doc, round(same / (x.n + y.n - same)::DOUBLE, 6) AS j FROM p JOIN n x ON x.page_id = query JOIN n y ON y.page_id = doc""",
)
def title_candidates(spark, d):
    """Jaccard of titles' words between the queries, whose id is divisible by 50, and the pages of their hosts."""
    own = titles(spark, d).select("page_id", "host", F.array_distinct(X.words("title")).alias("w"))
    sizes = own.select(F.col("page_id").alias("id"), F.size("w").alias("n"))
    each = own.select("page_id", "host", F.explode("w").alias("term"))
    q = each.where("page_id % 50 = 0").select(F.col("page_id").alias("query"), "host", "term")
    same = q.join(each.withColumnRenamed("page_id", "doc"), ["host", "term"]).where("query <> doc").groupBy("query", "doc").agg(F.count("*").alias("same"))
    both = same.join(sizes.select(F.col("id").alias("query"), F.col("n").alias("x")), "query").join(sizes.select(F.col("id").alias("doc"), F.col("n").alias("y")), "doc")
    return both.select("query", "doc", F.round(F.col("same") / (F.col("x") + F.col("y") - F.col("same")), 6).alias("j"))


@query("cand_best_content", f"WITH {_ALL} SELECT query, arg_min(doc, (-round(cosine, 9), doc)) AS doc, round(max(cosine), 6) AS cosine FROM c GROUP BY 1")
def cand_best_content(spark, d):
    pairs = cosines.best(packs(spark, d, "true"), 1)
    return pairs.groupBy("query").agg(F.min_by("doc", F.struct(-F.round("cosine", 9), "doc")).alias("doc"), F.round(F.max("cosine"), 6).alias("cosine"))


_TWO = f"{_COSINE}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(cosine, 9) DESC, doc) AS k FROM c), two AS (SELECT query, max(CASE WHEN k = 1 THEN doc END) AS doc, max(CASE WHEN k = 1 THEN cosine END) AS t1, coalesce(max(CASE WHEN k = 2 THEN cosine END), 0) AS t2 FROM r WHERE k <= 2 GROUP BY 1)"


@query("cand_separable", f"WITH {_TWO} SELECT query, doc, round(t1, 6) AS top1, round(t2, 6) AS top2 FROM two WHERE t1 >= 0.5 AND t2 < 0.5")
def cand_separable(spark, d):
    best = S.separable(cosines.best(packs(spark, d), 2), threshold=0.5)
    return best.select("query", "doc", F.round("top1", 6).alias("top1"), F.round("top2", 6).alias("top2"))


@query("cand_match_order", f"WITH {_TWO}, m AS (SELECT query, doc, CASE WHEN t2 < 0.5 THEN 'content' ELSE 'fuzzy' END AS type, t1 FROM two) SELECT query, doc, type, row_number() OVER (ORDER BY type, round(t1, 9) DESC, query) AS pos FROM m")
def cand_match_order(spark, d):
    """Queries' best matches in order: sure ones first, then by similarity."""
    best = S.separable(cosines.best(packs(spark, d), 2), threshold=0.0, strict=False)
    kind = F.when(F.col("top2") < 0.5, "content").otherwise("fuzzy")
    own = best.select("query", "doc", kind.alias("type"), (-F.round("top1", 9)).alias("less"))
    return ordered.ranked(own, "type", "less", "query").select("query", "doc", "type", (F.col("rank") + 1).alias("pos"))


_LANGS = ("de", "en", "es", "fr")


@query(
    "text_language_profile",
    rf"""WITH t AS (SELECT doc_id, lang, unnest({_WORDS}) AS term FROM documents), c AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2), r AS (SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS k FROM c),
p AS (SELECT lang, term FROM r WHERE k <= 30), h AS (SELECT t.doc_id, p.lang AS guess, count(*) AS n FROM t JOIN p ON t.term = p.term GROUP BY 1, 2), g AS (SELECT doc_id, arg_min(guess, (-n, guess)) AS guess FROM h GROUP BY 1)
SELECT documents.lang, guess, count(*) AS n FROM documents JOIN g USING (doc_id) GROUP BY 1, 2""",
)
def text_language_profile(spark, d):
    """Languages guessed from their 30 most frequent words, against the declared ones."""
    docs = documents(spark, d)
    terms = docs.select("doc_id", "lang", F.explode(X.words("text")).alias("term"))
    counts = terms.groupBy("lang", "term").agg(F.count("*").alias("n"))
    best = counts.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "term"))).where("k <= 30").select(F.col("lang").alias("guess"), "term")
    hits = terms.join(F.broadcast(best), "term").groupBy("doc_id", "guess").agg(F.count("*").alias("n"))  # 30 rows a language
    guess = hits.groupBy("doc_id").agg(F.min_by("guess", F.struct(-F.col("n"), F.col("guess"))).alias("guess"))
    return docs.select("doc_id", "lang").join(guess, "doc_id").groupBy("lang", "guess").agg(F.count("*").alias("n"))


_RAW = "CASE event_id % 4 WHEN 0 THEN {0} WHEN 1 THEN left({0}, 8) WHEN 2 THEN left({0}, 4) ELSE event_type END"


@query("text_lenient_ts", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d 00:00:00') WHEN 2 THEN strftime(ts, '%Y-01-01 00:00:00') END AS ts FROM events")
def text_lenient_ts(spark, d):
    """Times from 14, 8 or 4 digits, or from a word that is none."""
    own = table(spark, d, "events").select("event_id", F.expr(_RAW.format("date_format(ts, 'yyyyMMddHHmmss')")).alias("raw"))
    return own.select("event_id", F.date_format(X.lenient_ts("raw"), "yyyy-MM-dd HH:mm:ss").alias("ts"))


_CHR = "chr((65 + {0})::INT)"


@query("text_sheet_columns", f"""WITH x AS (SELECT page_id, page_id % 18278 AS n FROM pages)
SELECT page_id, CASE WHEN n < 26 THEN {_CHR.format('n')} WHEN n < 702 THEN {_CHR.format('n // 26 - 1')} || {_CHR.format('n % 26')} ELSE {_CHR.format('(n - 702) // 676')} || {_CHR.format('(n - 702) // 26 % 26')} || {_CHR.format('n % 26')} END AS letters FROM x""")
def text_sheet_columns(spark, d):
    return table(spark, d, "pages").select("page_id", X.sheet_column(F.col("page_id") % 18278).alias("letters"))


@query("text_complement", f"WITH w AS (SELECT page_id, string_split({TITLE}, ' ') AS w FROM pages) SELECT page_id, array_to_string(w[len(w) // 2 + 1:], ' ') AS rest FROM w")
def text_complement(spark, d):
    """What is left of a title without its first half."""
    own = table(spark, d, "pages").select("page_id", F.split(H.title("html"), " ").alias("w"))
    half = F.array_join(F.slice("w", F.lit(1), F.floor(F.size("w") / 2).cast("int")), " ")
    own = own.select("page_id", F.array_join("w", " ").alias("whole"), half.alias("part"))
    return own.select("page_id", X.complement("whole", "part").alias("rest"))


@query("text_stems")
def text_stems(spark, d):
    """The stems of the words of English documents, and how many words share each."""
    terms = documents(spark, d).where("lang = 'en'").select(F.explode(X.words("text")).alias("word")).distinct()
    return terms.select("word", X.stems(F.array("word"))[0].alias("stem")).groupBy("stem").agg(F.count("*").alias("n"), F.min("word").alias("first"))
