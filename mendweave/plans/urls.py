"""URL functions over pages."""

from __future__ import annotations

from mendweave.functions import html as H
from mendweave.functions import urls as U
from mendweave.operators import ordered

from .common import KEY, PAIRS, URLS, DataFrame, F, SparkSession, literal, query, table
from .html import LINKS
from .snapshots import SNAPS, snaps


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "url")


def next_on_host(spark: SparkSession, d: str) -> DataFrame:
    """Each page with the next of its host: as many pairs as pages, and no window over a host."""
    own = pages(spark, d).withColumn("host", U.host("url"))
    return ordered.followed(own, ["host"], ["page_id"], {"id2": "page_id", "url2": "url"}).where("id2 IS NOT NULL")


@query("url_parts", f"WITH {URLS} SELECT page_id, scheme, host, path, query, fragment, bare FROM s")
def url_parts(spark, d):
    return pages(spark, d).select("page_id", U.scheme("url").alias("scheme"), U.host("url").alias("host"), U.path("url").alias("path"), U.query("url").alias("query"), U.fragment("url").alias("fragment"), U.bare_host("url").alias("bare"))


@query("url_match_key", f"WITH {URLS} SELECT page_id, {KEY} AS match_key FROM s")
def url_match_key(spark, d):
    return pages(spark, d).select("page_id", U.match_key("url").alias("match_key"))


@query(
    "url_norm",
    f"""WITH {URLS} SELECT page_id, bare || CASE WHEN lower(path) IN ('', '/') THEN '/' ELSE regexp_replace(lower(path), '/$', '') END
  || CASE WHEN query = '' THEN '' WHEN len(pairs) > 0 THEN '?' || array_to_string(list_sort(list_transform(pairs, lambda x: lower(x))), '&') ELSE '?' || lower(query) END AS norm FROM s""",
)
def url_norm(spark, d):
    return pages(spark, d).select("page_id", U.norm("url", ignore_scheme=True, trim_www=True, trim_slash=True).alias("norm"))


@query("url_netloc_dir", rf"WITH {URLS} SELECT regexp_replace(host, '^[^.]*www[^.]*\.', '') || '|' || lower(dir) AS netloc_dir, count(*) AS n, min(page_id) AS first_page FROM s GROUP BY 1")
def url_netloc_dir(spark, d):
    return pages(spark, d).groupBy(U.netloc_dir("url").alias("netloc_dir")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query(
    "url_parent",
    rf"""WITH {URLS} SELECT page_id, CASE WHEN regexp_replace(path, '/$', '') = '' THEN host ELSE host || regexp_replace(regexp_replace(path, '/$', ''), '/[^/]*$', '') END AS parent FROM s""",
)
def url_parent(spark, d):
    return pages(spark, d).select("page_id", U.parent("url").alias("parent"))


@query("url_nondigit_dir", f"WITH {URLS} SELECT dir, count(*) AS n FROM s GROUP BY 1")
def url_nondigit_dir(spark, d):
    return pages(spark, d).groupBy(U.nondigit_dir(U.path("url")).alias("dir")).agg(F.count("*").alias("n"))


@query(
    "url_tokens",
    f"""WITH {URLS} SELECT token, count(*) AS n, count(DISTINCT host) AS hosts FROM (
  SELECT host, unnest(list_concat([bare], list_transform(segs, lambda x: lower(x)), list_transform(pairs, lambda x: lower(regexp_extract(x, '^[^=]+=(.*)$', 1))))) AS token FROM s) GROUP BY 1""",
)
def url_tokens(spark, d):
    own = pages(spark, d).select(U.host("url").alias("host"), F.explode(U.tokens("url")).alias("token"))
    return own.groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("host").alias("hosts"))


@query(
    "url_query_map",
    f"SELECT key, count(*) AS n, count(DISTINCT value) AS n_values FROM (WITH {URLS} SELECT regexp_extract(x, '^([^=]+)=', 1) AS key, regexp_extract(x, '^[^=]+=(.*)$', 1) AS value FROM (SELECT unnest(pairs) AS x FROM s)) GROUP BY 1",
)
def url_query_map(spark, d):
    own = pages(spark, d).select(F.explode(U.query_map(U.query("url"))).alias("key", "all")).select("key", F.explode("all").alias("value"))
    return own.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))


@query(
    "url_ext_class",
    f"""WITH {URLS} SELECT ext, CASE WHEN regexp_matches(leaf, '[A-Za-z]') THEN 'A' ELSE '' END || CASE WHEN regexp_matches(leaf, '[0-9]') THEN 'N' ELSE '' END AS class, count(*) AS n FROM s GROUP BY 1, 2""",
)
def url_ext_class(spark, d):
    p = U.path("url")
    return pages(spark, d).groupBy(U.extension(p).alias("ext"), U.alnum_class(U.filename(p)).alias("class")).agg(F.count("*").alias("n"))


@query(
    "url_digits",
    rf"""WITH {URLS}, r AS (
  SELECT page_id, unnest(list_distinct(flatten(list_transform(list_concat(list_transform(pairs, lambda x: regexp_extract(x, '^[^=]+=(.*)$', 1)), segs[greatest(len(segs) - 1, 1):]), lambda t: regexp_extract_all(t, '[0-9]+'))))) AS run FROM s)
SELECT page_id, run FROM r WHERE NOT (length(run) <= 2 OR regexp_matches(run, '^(19[0-9]{{2}}|200[0-9]|201[0-9]|202[0-2])'))""",
)
def url_digits(spark, d):
    return pages(spark, d).select("page_id", F.explode(U.digit_runs("url")).alias("run"))


@query("url_site", rf"WITH {URLS} SELECT regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS site, count(*) AS n, count(DISTINCT host) AS hosts FROM s GROUP BY 1")
def url_site(spark, d):
    own = pages(spark, d).withColumn("host", U.host("url"))
    return own.groupBy(U.suffix_site("host").alias("site")).agg(F.count("*").alias("n"), F.countDistinct("host").alias("hosts"))


@query("url_norm_path", f"WITH {URLS} SELECT page_id, path || CASE WHEN query = '' THEN '' ELSE '?' || query END AS norm_path FROM s")
def url_norm_path(spark, d):
    return pages(spark, d).select("page_id", U.norm_path("url").alias("norm_path"))


@query("url_edit_distance", f"WITH {PAIRS} SELECT page_id, id2, (len(list_filter(range(1, n + 1), lambda i: segs[i] <> segs2[i])) + abs(len(segs) - len(segs2)) + (host <> host2)::INT + (array_to_string(pairs, '&') <> array_to_string(pairs2, '&'))::INT)::BIGINT AS d FROM k")
def url_edit_distance(spark, d):
    return next_on_host(spark, d).select("page_id", "id2", U.edit_distance("url", "url2").cast("bigint").alias("d"))


@query(
    "url_tree_diff",
    f"""WITH {PAIRS} SELECT page_id, id2, (greatest(len(segs2) - common, len(segs) - common) + (bare <> bare2)::INT
  + len(list_filter(list_distinct(pairs), lambda x: NOT list_contains(pairs2, x))) + len(list_filter(list_distinct(pairs2), lambda x: NOT list_contains(pairs, x))))::BIGINT AS d FROM k""",
)
def url_tree_diff(spark, d):
    return next_on_host(spark, d).select("page_id", "id2", U.tree_diff("url", "url2").cast("bigint").alias("d"))


@query("url_prefix_diff", f"WITH {PAIRS} SELECT page_id, id2, (CASE WHEN bare <> bare2 THEN len(segs) - 1 WHEN common = len(segs) AND len(segs2) > common THEN common - len(segs2) ELSE len(segs) - common END)::BIGINT AS d FROM k")
def url_prefix_diff(spark, d):
    return next_on_host(spark, d).select("page_id", "id2", U.prefix_diff("url", "url2").cast("bigint").alias("d"))


_SETS = """round(CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 1 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))::DOUBLE END, 6)"""
_WORDS = "list_filter(string_split_regex(lower({0}), '[^a-zA-Z1-9]'), lambda x: x <> '')"


@query("url_filename_jaccard", f"WITH {PAIRS}, w AS (SELECT page_id, id2, {_WORDS.format('leaf')} AS a, {_WORDS.format('leaf2')} AS b FROM k) SELECT page_id, id2, {_SETS.format(a='a', b='b')} AS j FROM w")
def url_filename_jaccard(spark, d):
    return next_on_host(spark, d).select("page_id", "id2", F.round(U.filename_jaccard("url", "url2"), 6).alias("j"))


_DIR = "list_filter(string_split(lower({0}), '/'), lambda x: x <> '')"


@query("dir_jaccard", f"WITH {PAIRS}, w AS (SELECT page_id, id2, {_DIR.format('dir')} AS a, {_DIR.format('dir2')} AS b FROM k) SELECT page_id, id2, {_SETS.format(a='a', b='b')} AS j FROM w")
def dir_jaccard(spark, d):
    return next_on_host(spark, d).select("page_id", "id2", F.round(U.dir_jaccard("url", "url2"), 6).alias("j"))


_ABOVE = "(bare = bare2 OR ends_with(bare2, '.' || bare)) AND {depth} AND (len(segs) = 0 OR list_transform(segs2, lambda x: lower(x))[1:len(segs)] = list_transform(segs, lambda x: lower(x))) AND len(list_filter(pairs, lambda x: NOT list_contains(pairs2, x))) = 0"


@query("url_prefix_pairs", f"WITH {PAIRS} SELECT page_id, id2, {_ABOVE.format(depth='len(segs2) >= len(segs)')} AS prefix, {_ABOVE.format(depth='len(segs2) = len(segs) + 1')} AS parent FROM k")
def url_prefix_pairs(spark, d):
    return next_on_host(spark, d).select("page_id", "id2", U.is_prefix("url", "url2").alias("prefix"), U.is_parent("url", "url2").alias("parent"))


@query("path_common_prefix", f"""WITH {URLS}, c AS (SELECT host, min(path) AS lo, max(path) AS hi FROM s GROUP BY host)
SELECT host, left(lo, (SELECT count(*) FROM range(1, least(length(lo), length(hi)) + 1) t(i) WHERE left(lo, i::INT) = left(hi, i::INT))::INT) AS prefix FROM c""")
def path_common_prefix(spark, d):
    """The paths of a host share what its first and last in order share."""
    ends = pages(spark, d).groupBy(U.host("url").alias("host")).agg(F.min(U.path("url")).alias("lo"), F.max(U.path("url")).alias("hi"))
    n = F.expr("size(filter(sequence(0, least(length(lo), length(hi))), i -> i > 0 AND left(lo, i) = left(hi, i)))")
    return ends.withColumn("n", n).select("host", F.expr("left(lo, n)").alias("prefix"))


_KEYWORDS = "['login', 'subscription', 'error', 'notfound', '404', 'badpage', 'errorpath']"


@query("filter_na", f"WITH {URLS} SELECT page_id, list_has_any(string_split_regex(lower(leaf), '[^a-z0-9]+'), {_KEYWORDS}) AS na FROM s")
def filter_na(spark, d):
    return pages(spark, d).select("page_id", U.is_na("url").alias("na"))


@query(
    "filter_suspicious",
    f"""WITH {PAIRS} SELECT page_id, id2, list_has_any(string_split_regex(lower(leaf2), '[^a-z0-9]+'), {_KEYWORDS})
  OR (NOT (path IN ('', '/') AND query = '') AND path2 IN ('', '/') AND query2 = '') OR ext2 IN ('.pdf', '.jpeg', '.jpg', '.doc') AS suspicious FROM k""",
)
def filter_suspicious(spark, d):
    return next_on_host(spark, d).select("page_id", "id2", U.is_suspicious("url", "url2").alias("suspicious"))


@query(
    "filter_hygiene",
    f"""WITH {URLS} SELECT DISTINCT scheme || '://' || host || path || CASE WHEN len(list_filter(pairs, lambda x: NOT starts_with(lower(x), 'utm'))) > 0
  THEN '?' || array_to_string(list_filter(pairs, lambda x: NOT starts_with(lower(x), 'utm')), '&') ELSE '' END AS url FROM s
  WHERE ext NOT IN ({", ".join(f"'{x}'" for x in U.NON_HTML)}) AND NOT regexp_matches(lower(url), 'signin|login')""",
)
def filter_hygiene(spark, d):
    from mendweave.operators.prep import clean_urls

    return clean_urls(pages(spark, d)).select("url").distinct()


@query("filter_blocklist", rf"WITH {URLS} SELECT page_id FROM s WHERE regexp_extract(host, '([^.]+\.[^.]+)$', 1) <> 'example.net'")
def filter_blocklist(spark, d):
    from mendweave.operators.prep import block_sites

    return block_sites(pages(spark, d), literal(spark, [("example.net",)], "site string")).select("page_id")


@query("archive_urls", "SELECT page_id, url AS live, CASE WHEN page_id % 2 = 0 THEN '20200101000000' END AS ts FROM pages")
def archive_urls(spark, d):
    """Live form and time of URLs, every second of which is an archive's."""
    own = pages(spark, d).withColumn("url", F.when(F.col("page_id") % 2 == 0, U.archive_url("url", F.lit("20200101000000"))).otherwise(F.col("url")))
    return own.select("page_id", U.strip_archive("url").alias("live"), U.archive_ts("url").alias("ts"))


@query("url_resolve", f"WITH {LINKS} SELECT DISTINCT page_id, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^[^:/?#]+://[^/?#]*', 0) || href ELSE href END AS resolved FROM l JOIN pages USING (page_id)")
def url_resolve(spark, d):
    """A page's links as absolute URLs."""
    own = table(spark, d, "pages").select("page_id", "url", F.explode(H.links("html")).alias("l"))
    return own.select("page_id", U.resolve("url", "l.href").alias("resolved")).distinct()


@query("status_classes", f"WITH {SNAPS}, x AS (SELECT CASE event_id % 5 WHEN 0 THEN 'DNSError' WHEN 1 THEN 'Similar to a sibling' ELSE status END AS s FROM sn) SELECT CASE WHEN s = 'DNSError' THEN 'DNSOther' WHEN starts_with(s, 'Similar') THEN 'Soft-404' WHEN s[1] IN ('4', '5') THEN '4/5xx' ELSE s END AS class, count(*) AS n FROM x GROUP BY 1")
def status_classes(spark, d):
    """Statuses by class; of five, one failed to connect and one is like a sibling."""
    status = F.when(F.col("event_id") % 5 == 0, "DNSError").when(F.col("event_id") % 5 == 1, "Similar to a sibling").otherwise(F.col("status"))
    return snaps(spark, d).groupBy(U.status_class(status).alias("class")).agg(F.count("*").alias("n"))
