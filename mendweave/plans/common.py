"""What the query modules share: the catalogue's decorator, table access, and pieces of oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mendweave.catalog import query
from mendweave.session import share_path, written
from mendweave.sources.tables import table

__all__ = ["F", "Window", "DataFrame", "SparkSession", "query", "table", "written", "URLS", "PAIRS", "TITLES", "KEY", "literal", "values_sql"]

#: Pages with the parts of their URLs.
URLS = r"""u AS (
  SELECT page_id, url, html,
    lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
    regexp_replace(lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)), ':[0-9]+$', '') AS host,
    regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query,
    regexp_extract(url, '#(.*)$', 1) AS fragment
  FROM pages
), s AS (
  SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs,
    list_sort(list_filter(string_split(query, '&'), lambda x: regexp_matches(x, '^[^=]+=.+'))) AS pairs,
    regexp_replace(host, '^www\.', '') AS bare,
    lower(regexp_extract(path, '(\.[A-Za-z0-9]+)$', 1)) AS ext,
    regexp_extract(path, '([^/]*)/?$', 1) AS leaf,
    regexp_replace(regexp_replace(path, '/?[^/]*/?$', ''), '(/[0-9]+)+$', '') AS dir
  FROM u
)"""

#: The key that equal URLs share, from URLS' columns (of live URLs).
KEY = r"""concat_ws('|', bare,
  CASE WHEN regexp_replace(lower(path), '/index[^/]*$', '/') IN ('', '/') THEN '/' ELSE regexp_replace(regexp_replace(lower(path), '/index[^/]*$', '/'), '/$', '') END,
  CASE WHEN len(list_filter(string_split(lower(query), '&'), lambda x: regexp_matches(x, '^[^=]+=.+'))) > 0
    THEN array_to_string(list_sort(list_filter(string_split(lower(query), '&'), lambda x: regexp_matches(x, '^[^=]+=.+'))), '&') ELSE lower(query) END)"""

#: Each page and the next on its host.
PAIRS = (
    URLS
    + """, p AS (
  SELECT a.*, b.url AS url2, b.page_id AS id2, b.host AS host2, b.bare AS bare2, b.path AS path2, b.query AS query2, b.segs AS segs2, b.pairs AS pairs2, b.ext AS ext2, b.leaf AS leaf2, b.dir AS dir2
  FROM (SELECT *, lead(page_id) OVER (PARTITION BY host ORDER BY page_id) AS nx FROM s) a JOIN s b ON a.nx = b.page_id
), k AS (
  SELECT *, least(len(segs), len(segs2)) AS n,
    coalesce(list_position(list_transform(range(1, least(len(segs), len(segs2)) + 1), lambda i: segs[i] <> segs2[i]), true) - 1, least(len(segs), len(segs2))) AS common
  FROM p
)"""
)

TITLES = r"""t AS (SELECT page_id, url, html, regexp_replace(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '\s+', ' ', 'g') AS title FROM pages)"""


def values_sql(rows: list[tuple], columns: str) -> str:
    """A VALUES list for both engines."""

    def cell(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        return str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({columns})"


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    share_path(spark)
    return spark.createDataFrame(rows, schema)
