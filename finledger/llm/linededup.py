"""Site-relative line removal, in DataFrame functions only.

Pages are grouped by host.  A line's ratio is the number of the host's pages
that contain it over the host's pages; lines above ``max_ratio`` that stand on
at least ``min_pages`` pages are boilerplate of that host and are dropped from
all its pages.  Lines are compared without blanks at their ends.

Defined results: blank lines are never counted nor dropped; a line repeated
inside a page counts once; pages without host are kept whole; a null text stays
null (no lines); repeated rows are pages of their own; extra columns pass
through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: block structure of a page: scripts, styles, comments and every tag end a line
HTML_BREAK = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<[^>]*>|[\r\n]+"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; null without one."""
    found = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(found != "", found)


def boilerplate(pages: DataFrame, max_ratio: float, min_pages: int) -> DataFrame:
    """host, bad: the hashes of each host's boilerplate lines.

    ``pages`` has __host and __lines.  Both counts are partially aggregated
    before their shuffles, so a host or a line with a third of all rows only
    adds to partial counts.  A host has at most (lines per page / max_ratio)
    boilerplate lines.
    """
    known = pages.where(F.col("__host").isNotNull())
    seen = F.array_distinct(F.transform(F.filter("__lines", lambda x: F.trim(x) != ""), lambda x: F.xxhash64(F.trim(x))))
    counts = known.select("__host", F.explode(seen).alias("line")).groupBy("__host", "line").agg(
        F.count(F.lit(1)).alias("with_line")).where(F.col("with_line") >= min_pages)
    totals = known.groupBy("__host").agg(F.count(F.lit(1)).alias("of_host"))
    bad = counts.join(totals, "__host").where(F.col("with_line") > max_ratio * F.col("of_host"))
    return bad.groupBy("__host").agg(F.collect_set("line").alias("__bad"))


def drop_boilerplate(df: DataFrame, host: Column, lines: Column, max_ratio: float = 0.1, min_pages: int = 4) -> DataFrame:
    """``df`` with __lines (kept lines) and __dropped (their number).

    The boilerplate table is written first, so its size is known when the join
    is planned: Spark broadcasts it below its threshold, else shuffles both sides
    and splits a hot host.
    """
    pages = df.withColumn("__host", host).withColumn("__lines", lines)
    bad = staged(df.sparkSession, boilerplate(pages, max_ratio, min_pages), "boilerplate")
    out = pages.join(bad, "__host", "left")
    # a blank line's hash may not match: it is kept before the lookup
    kept = F.filter("__lines", lambda x: (F.trim(x) == "") | ~F.array_contains("__bad", F.xxhash64(F.trim(x))))
    out = out.withColumn("__kept", F.when(F.col("__bad").isNull(), F.col("__lines")).otherwise(kept))
    out = out.withColumn("__dropped", F.coalesce(F.size("__lines") - F.size("__kept"), F.lit(0)))
    return out.withColumn("__lines", F.col("__kept"))


def clean_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
                max_ratio: float = 0.1, min_pages: int = 4) -> DataFrame:
    """key, host, n_lines, n_dropped, text: the text lines of each page without its host's boilerplate."""
    pieces = F.transform(F.split(F.col(html).cast("string"), HTML_BREAK), lambda x: F.trim(x))
    rows = pages.select(F.col(key).alias("__key"), F.col(url).alias("__url"),
                        F.filter(pieces, lambda x: x != "").alias("__pieces"))
    out = drop_boilerplate(rows, host_of(F.col("__url")), F.col("__pieces"), max_ratio, min_pages)
    return out.select(
        F.col("__key").alias(key), F.col("__host").alias("host"),
        F.coalesce(F.size("__pieces"), F.lit(0)).alias("n_lines"), F.col("__dropped").alias("n_dropped"),
        F.array_join("__lines", "\n").alias("text"))


def clean_documents(docs: DataFrame, host: str = "source", text: str = "text",
                    max_ratio: float = 0.1, min_pages: int = 4) -> DataFrame:
    """``docs`` with the boilerplate lines of each host cut from its texts; other columns as they are."""
    lines = F.split(F.col(text).cast("string"), "\n")
    out = drop_boilerplate(docs, F.col(host).cast("string"), lines, max_ratio, min_pages)
    body = F.when(F.col("__dropped") > 0, F.array_join("__lines", "\n")).otherwise(F.col(text))
    return out.withColumn(text, body).select(*docs.columns)


SQL = r"""
WITH pages_ AS (
  SELECT page_id AS key, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
         list_filter(list_transform(string_split_regex(html,
           '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<[^>]*>|[\r\n]+'),
           lambda x: trim(x, ' ')), lambda x: x <> '') AS lines
  FROM pages),
counts AS (
  SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM pages_ WHERE host IS NOT NULL)
  GROUP BY ALL HAVING count(*) >= 4),
bad AS (
  SELECT host, list(line) AS lines FROM counts JOIN (SELECT host, count(*) AS total FROM pages_ GROUP BY host) USING (host)
  WHERE n > 0.1 * total GROUP BY host)
SELECT key AS page_id, p.host, coalesce(len(p.lines), 0)::INT AS n_lines,
       coalesce(len(p.lines) - len(list_filter(p.lines, lambda x: NOT coalesce(list_contains(b.lines, x), false))), 0)::INT AS n_dropped,
       array_to_string(list_filter(p.lines, lambda x: NOT coalesce(list_contains(b.lines, x), false)), chr(10)) AS text
FROM pages_ p LEFT JOIN bad b ON p.host = b.host
"""
