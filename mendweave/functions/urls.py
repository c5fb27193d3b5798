"""URL functions as Column builders: all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARCHIVE = r"^https?://web\.archive\.org/web/([0-9]+)[a-z_]*/"
#: Words in a file name that tell of an error or a login page.
ERROR_WORDS = ("login", "subscription", "error", "notfound", "404", "badpage", "errorpath")
#: Extensions of files that are not pages.
NON_PAGES = (".pdf", ".jpeg", ".jpg", ".doc")
#: Extensions that a list of URLs is cleaned of.
NON_HTML = (
    ".pdf", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".doc", ".docx", ".xls", ".xlsx",
    ".ppt", ".pptx", ".zip", ".gz", ".mp3", ".mp4", ".avi", ".xml", ".txt",
)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- archive URLs -----------------------------------------------------------


def strip_archive(url) -> Column:
    """The live form of an archive URL; ``http:/x`` within it is repaired to ``http://x``."""
    live = F.regexp_replace(_c(url), ARCHIVE, "")
    return F.regexp_replace(live, r"^(https?):/([^/])", r"$1://$2")


def archive_ts(url) -> Column:
    return F.nullif(F.regexp_extract(_c(url), ARCHIVE, 1), F.lit(""))


def archive_url(url, ts) -> Column:
    return F.when(_c(url).rlike(ARCHIVE), _c(url)).otherwise(F.concat(F.lit("http://web.archive.org/web/"), _c(ts), F.lit("/"), _c(url)))


# --- parts --------------------------------------------------------------------


def scheme(url) -> Column:
    return F.lower(F.regexp_extract(_c(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def netloc(url) -> Column:
    return F.regexp_extract(_c(url), r"^[^:/?#]+://([^/?#]*)", 1)


def host(url) -> Column:
    """Lower case, without the port."""
    return F.regexp_replace(F.lower(netloc(url)), r":[0-9]+$", "")


def path(url) -> Column:
    return F.regexp_extract(_c(url), r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)


def query(url) -> Column:
    return F.regexp_extract(_c(url), r"^[^?#]*\?([^#]*)", 1)


def fragment(url) -> Column:
    return F.regexp_extract(_c(url), r"#(.*)$", 1)


def bare_host(url) -> Column:
    """Without a leading ``www`` label."""
    return F.regexp_replace(host(url), r"^www\.", "")


def group_host(url) -> Column:
    """Without a first label that holds ``www``, such as ``www2``."""
    return F.regexp_replace(host(url), r"^[^.]*www[^.]*\.", "")


def suffix_site(host_: Column, suffixes: tuple[str, ...] = ("co.uk", "com.au", "org.uk", "ac.uk", "gov.uk", "co.jp", "com.br", "co.nz", "edu.au")) -> Column:
    """The registrable domain: a label more than the longest public suffix; one label where no listed suffix fits."""
    labels = F.split(_c(host_), r"\.")
    two = F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2))
    three = F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3))
    return F.when(two.isin(*suffixes), three).otherwise(two)


def query_pairs(query_) -> Column:
    """``k=v`` with a value, sorted; others are dropped."""
    return F.array_sort(F.filter(F.split(_c(query_), "&"), lambda p: p.rlike(r"^[^=]+=.+")))


def query_keys(query_) -> Column:
    return F.transform(query_pairs(query_), lambda p: F.regexp_extract(p, r"^([^=]+)=", 1))


def query_values(query_) -> Column:
    return F.transform(query_pairs(query_), lambda p: F.regexp_extract(p, r"^[^=]+=(.*)$", 1))


def query_map(query_) -> Column:
    """Each key with its values; a query without pairs stands under ``NoKey``."""
    pairs = query_pairs(query_)
    keys = F.array_distinct(query_keys(query_))
    values = F.transform(keys, lambda k: F.transform(F.filter(pairs, lambda p: p.startswith(F.concat(k, F.lit("=")))), lambda p: F.regexp_extract(p, r"^[^=]+=(.*)$", 1)))
    return F.when(_c(query_) == "", F.create_map().cast("map<string,array<string>>")).when(F.size(pairs) == 0, F.create_map(F.lit("NoKey"), F.array(_c(query_)))).otherwise(F.map_from_arrays(keys, values))


def segments(path_) -> Column:
    return F.filter(F.split(_c(path_), "/"), lambda s: s != "")


def filename(path_) -> Column:
    return F.regexp_extract(_c(path_), r"([^/]*)/?$", 1)


def extension(path_) -> Column:
    return F.lower(F.regexp_extract(_c(path_), r"(\.[A-Za-z0-9]+)$", 1))


# --- keys ---------------------------------------------------------------------


def _key_path(path_: Column) -> Column:
    flat = F.regexp_replace(F.lower(path_), r"/index[^/]*$", "/")
    return F.when(flat.isin("", "/"), "/").otherwise(F.regexp_replace(flat, r"/$", ""))


def match_key(url) -> Column:
    """host|path|query: two URLs match if and only if their keys are equal.

    Archive prefix, scheme, port, one ``www`` label, fragment, letter case, a last slash and an index file do not count;
    query pairs count in any order, and a query without pairs counts as it is.
    """
    live = strip_archive(url)
    q = F.lower(query(live))
    pairs = query_pairs(q)
    return F.concat_ws("|", bare_host(live), _key_path(path(live)), F.when(F.size(pairs) > 0, F.concat_ws("&", pairs)).otherwise(q))


def norm(url, ignore_scheme: bool = False, trim_www: bool = False, trim_slash: bool = False, sort_query: bool = True, case: bool = False) -> Column:
    """The URL without port and fragment; an empty path is ``/``. Without ``case`` path and query are lower-cased."""
    live = strip_archive(url)
    h = bare_host(live) if trim_www else host(live)
    p, q = (path(live), query(live)) if case else (F.lower(path(live)), F.lower(query(live)))
    p = F.when(p.isin("", "/"), "/").otherwise(F.regexp_replace(p, r"/$", "") if trim_slash else p)
    if sort_query:
        pairs = query_pairs(q)
        q = F.when(F.size(pairs) > 0, F.concat_ws("&", pairs)).otherwise(q)
    head = F.lit("") if ignore_scheme else F.concat(scheme(live), F.lit("://"))
    return F.concat(head, h, p, F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))


def nondigit_dir(path_) -> Column:
    """The directory without trailing segments of digits."""
    return F.regexp_replace(F.regexp_replace(_c(path_), r"/?[^/]*/?$", ""), r"(/[0-9]+)+$", "")


def nondate_path(path_) -> Column:
    """Dates in path segments become ``${date}``."""
    return F.regexp_replace(_c(path_), r"(19|20)[0-9]{2}[-/_.]?(0[1-9]|1[0-2])[-/_.]?([0-2][0-9]|3[01])|(19|20)[0-9]{2}/(0[1-9]|1[0-2])", r"\${date}")


def netloc_dir(url, exclude_index: bool = False) -> Column:
    """host|directory, the key that groups the pages of a site's section."""
    p = F.lower(path(url))
    if exclude_index:
        p = F.regexp_replace(p, r"/(index|default)[^/]*$", "/")
    return F.concat_ws("|", group_host(url), nondigit_dir(p))


def parent(url) -> Column:
    """host and directory; for a home page the host without its first label, if two labels stay."""
    live = strip_archive(url)
    p = F.regexp_replace(path(live), r"/$", "")
    return F.when(p == "", F.regexp_replace(host(live), r"^[^.]+\.(?=[^.]+\.)", "")).otherwise(F.concat(host(live), F.regexp_replace(p, r"/[^/]*$", "")))


def norm_path(url) -> Column:
    return F.concat(path(url), F.when(query(url) == "", "").otherwise(F.concat(F.lit("?"), query(url))))


def is_home(url) -> Column:
    live = strip_archive(url)
    return _key_path(path(live)).isin("/") & (query(live) == "")


# --- tokens -------------------------------------------------------------------


def tokens(url) -> Column:
    """Host, path segments and query values (in the order of their keys), lower-cased."""
    live = F.lower(strip_archive(url))
    return F.concat(F.array(bare_host(live)), segments(path(live)), query_values(query(live)))


def alnum_class(token) -> Column:
    """``A`` with letters, ``N`` with digits, ``AN`` with both."""
    return F.concat(F.when(_c(token).rlike("[A-Za-z]"), "A").otherwise(""), F.when(_c(token).rlike("[0-9]"), "N").otherwise(""))


def digit_runs(url) -> Column:
    """Runs of digits in query values and the last two path segments that may be ids: neither below 100 nor a year."""
    live = strip_archive(url)
    segs = segments(path(live))
    last = F.slice(segs, F.greatest(F.size(segs) - 1, F.lit(1)), 2)
    runs = F.flatten(F.transform(F.concat(query_values(query(live)), last), lambda t: F.regexp_extract_all(t, F.lit("([0-9]+)"), 1)))
    return F.array_distinct(F.filter(runs, lambda r: ~looks_noid(r)))


def looks_noid(text) -> Column:
    """No number, one below 100, or one that begins like a year from 1900 to 2022."""
    t = _c(text)
    return ~t.rlike("^[0-9]+$") | (F.length(t) <= 2) | t.rlike("^(19[0-9]{2}|200[0-9]|201[0-9]|202[0-2])")


def good_token(text) -> Column:
    """A number over 2050, several words, or more than five characters."""
    t = _c(text)
    return F.when(t.rlike("^[0-9]{1,18}$"), F.try_to_number(t, F.lit("999999999999999999")) > 2050).otherwise(F.size(F.split(t, r"[^\p{L}\p{N}]+")) > 1) | (F.length(t) > 5)


def clean_query(query_) -> Column:
    return F.when(F.lower(_c(query_)).contains("print"), "").otherwise(_c(query_))


# --- predicates on one or two URLs ----------------------------------------------


def is_na(url) -> Column:
    """The file name holds a word that tells of an error or a login."""
    words = F.split(F.lower(filename(path(strip_archive(url)))), r"[^a-z0-9]+")
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in ERROR_WORDS]))


def is_suspicious(url, alias) -> Column:
    """An alias that is an error page, a home page of a page, or a file."""
    return is_na(alias) | (~is_home(url) & is_home(alias)) | extension(path(alias)).isin(*NON_PAGES)


def _is_above(upper, url, exact: bool) -> Column:
    a, b = strip_archive(upper), strip_archive(url)
    pa_, pb = segments(F.regexp_replace(F.lower(path(a)), r"/index[^/]*$", "/")), segments(F.lower(path(b)))
    hosts = (bare_host(a) == bare_host(b)) | bare_host(b).endswith(F.concat(F.lit("."), bare_host(a)))
    deeper = F.size(pb) == F.size(pa_) + 1 if exact else F.size(pb) >= F.size(pa_)
    inside = F.slice(pb, 1, F.size(pa_)) == pa_
    return hosts & deeper & F.when(F.size(pa_) == 0, True).otherwise(inside) & (F.size(F.array_except(query_pairs(query(a)), query_pairs(query(b)))) == 0)


def is_parent(upper, url) -> Column:
    return _is_above(upper, url, True)


def is_prefix(upper, url) -> Column:
    return _is_above(upper, url, False)


def same_ext(a, b) -> Column:
    return extension(path(a)) == extension(path(b))


def same_depth(a, b) -> Column:
    return F.size(segments(path(a))) == F.size(segments(path(b)))


def shrinks(old, new) -> Column:
    """No query on either side, and the new path is a part of the old one: a redirect that only cuts the path."""
    return (query(old) == "") & (query(new) == "") & path(old).contains(path(new))


def loops(url, out) -> Column:
    """An outlink that may lead back: on the same site and not below the page's own path."""
    return (suffix_site(host(url)) == suffix_site(host(out))) & ~(F.startswith(path(out), F.concat(F.regexp_replace(path(url), r"/$", ""), F.lit("/"))))


# --- distances ------------------------------------------------------------------


def jaccard(a, b) -> Column:
    """Of two arrays as sets; two empty ones are alike."""
    union = F.size(F.array_union(_c(a), _c(b)))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(_c(a), _c(b))) / union)


def filename_jaccard(a, b) -> Column:
    """Of the file names' words; 0 separates words, as all but letters and 1 to 9 do."""

    def words(u):
        return F.filter(F.split(F.lower(filename(path(strip_archive(u)))), "[^a-zA-Z1-9]"), lambda w: w != "")

    return jaccard(words(a), words(b))


def dir_jaccard(a, b) -> Column:
    return jaccard(segments(nondigit_dir(F.lower(path(a)))), segments(nondigit_dir(F.lower(path(b)))))


def edit_distance(a, b) -> Column:
    """Path segments that differ place by place, the difference in depth, and one each for host and query."""
    x, y = segments(path(a)), segments(path(b))
    n = F.least(F.size(x), F.size(y))
    differ = F.size(F.filter(F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda p, q: p != q), lambda d: d))
    return differ + F.abs(F.size(x) - F.size(y)) + (host(a) != host(b)).cast("int") + (F.array_join(query_pairs(query(a)), "&") != F.array_join(query_pairs(query(b)), "&")).cast("int")


def common_prefix(a, b) -> Column:
    """Number of leading path segments that two URLs share."""
    x, y = segments(path(a)), segments(path(b))
    n = F.least(F.size(x), F.size(y))
    first = F.array_position(F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda p, q: p != q), True)
    return F.when(n == 0, 0).when(first == 0, n).otherwise(first - 1).cast("int")


def tree_diff(dest, src) -> Column:
    """Steps up and down between two leaves of the site's tree, and the query pairs that only one has."""
    k = common_prefix(dest, src)
    up, down = F.size(segments(path(src))) - k, F.size(segments(path(dest))) - k
    hosts = (bare_host(dest) != bare_host(src)).cast("int")
    qa, qb = query_pairs(query(dest)), query_pairs(query(src))
    only = F.size(F.array_except(qa, qb)) + F.size(F.array_except(qb, qa))
    return F.greatest(up, down) + hosts + only


def prefix_diff(dest, src) -> Column:
    """0 for equal paths, below 0 if src is deeper within dest, else the steps from dest back to the common path."""
    x, y = segments(path(dest)), segments(path(src))
    k = common_prefix(dest, src)
    return F.when(bare_host(dest) != bare_host(src), F.size(x) - 1).when((k == F.size(x)) & (F.size(y) > k), k - F.size(y)).otherwise(F.size(x) - k)


def status_class(status) -> Column:
    """4xx and 5xx, failures to connect, soft errors, or the status itself."""
    s = _c(status)
    return F.when(s.rlike("^[45][0-9]*$"), "4/5xx").when(s.rlike("(?i)(dns|other)error"), "DNSOther").when(s.rlike("(?i)^(similar|soft|no feature)"), "Soft-404").otherwise(s)


def resolve(base, link) -> Column:
    """A link against the page that holds it: absolute, ``//``, ``/``, ``?``, ``#`` and relative forms with dots."""
    b, l = _c(base), F.trim(_c(link))
    root = F.concat(scheme(b), F.lit("://"), netloc(b))
    folder = F.regexp_replace(path(b), r"[^/]*$", "")
    joined = F.split(F.concat(F.when(folder == "", "/").otherwise(folder), F.regexp_extract(l, r"^([^?#]*)", 1)), "/")
    walked = F.aggregate(
        joined,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(s))),
    )
    rest = F.regexp_extract(l, r"^[^?#]*(.*)$", 1)
    relative = F.concat(root, F.array_join(walked, "/"), rest)
    return (
        F.when(l.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), l)
        .when(l.startswith("//"), F.concat(scheme(b), F.lit(":"), l))
        .when(l.startswith("/"), F.concat(root, l))
        .when(l.startswith("?"), F.concat(root, path(b), l))
        .when(l.startswith("#"), F.concat(F.regexp_replace(b, r"#.*$", ""), l))
        .otherwise(relative)
    )


def plain_scheme(url) -> Column:
    """The URL with ``http`` for ``https``, and with it where it has none."""
    u = _c(url)
    return F.when(u.rlike("^https?://"), F.regexp_replace(u, "^https://", "http://")).otherwise(F.concat(F.lit("http://"), F.regexp_replace(u, "^//", "")))


def archive_join(base, link) -> Column:
    """A link of an archived page, as an archive URL of the same time; one that leads out of the archive's own pages stays as it is."""
    b, l = _c(base), F.trim(_c(link))
    own = F.regexp_extract(l, r"^(?:https?://web\.archive\.org)?(/web/[0-9]+[a-z_]*/.*)$", 1)
    joined = archive_url(resolve(strip_archive(b), l), archive_ts(b))
    return F.when(own != "", F.concat(F.lit("http://web.archive.org"), own)).when(b.rlike(ARCHIVE), joined).otherwise(resolve(b, l))
