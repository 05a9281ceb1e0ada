"""Operator 4: line dedup by frequency relative to the site, in DataFrame functions only.

For each host, the pages that hold a line are counted and divided by the host's pages; lines above RATIO are
boilerplate of that host and go from all its pages. A line is identified by two 64-bit hashes with different seeds.
Every page names a line once, and counts are aggregated before they move, so neither a host with a third of all pages
nor a line on all of them gathers in one task. Boilerplate lines of a host are fewer than 1 / RATIO times the lines of
its average page. They are written and counted; up to MOST_BROADCAST of them are sent to the pages, more meet them in a
join on host, whose heavy keys adaptive execution splits. Pages of hosts without boilerplate are not looked at again.

Where pages are copied within a site, a copy's own lines are frequent too. With `most` below 1 a page that would lose
more than that share of its text stays whole if it is such a copy: its whole text, as the hash of all its lines, is
counted like a line and must be frequent itself. Other pages lose their frequent lines however many they are.
`least_chars` spares short lines, which repeat by chance.

Defined results: lines are compared without the white space at their ends; blank lines are neither counted nor dropped.
Null text has no lines and stays null. Null hosts form one host. Hosts with fewer than LEAST_PAGES pages and lines on
fewer than LEAST_HOLDERS pages have no boilerplate. A page that repeats (same row twice) counts twice. An empty table
gives no rows. Other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

RATIO = 0.3
LEAST_PAGES = 4
LEAST_HOLDERS = 3
#: Boilerplate lines, of all hosts, up to which they are broadcast (16 bytes each).
MOST_BROADCAST = 500_000

_LINE, _HOST, _BAD, _LINES = "_phonolake_line", "_phonolake_host", "_phonolake_bad", "_phonolake_lines"
# Elements whose content isn't text, and elements that end a line.
SKIP = r"(?is)<(script|style|noscript)\b[^>]*>.*?</(script|style|noscript)\s*>|<!--.*?-->"
BREAK = r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|td|table|nav|header|footer|article|section|title|body|head|html)\b[^>]*>"
BLANK = " \t\r\x0b\x0c"


def host_of(url: Column) -> Column:
    """The host of a URL, lower case, without port; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def visible_text(html: Column) -> Column:
    """Text of a page, a line for each block element."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, SKIP, ""), BREAK, "\n"), "<[^>]*>", "")


def _key(line: Column, least_chars: int = 1) -> Column:
    stripped = F.btrim(line, F.lit(BLANK))
    return F.when(F.length(stripped) >= least_chars, F.struct(F.xxhash64(stripped).alias("a"), F.xxhash64(F.lit(1), stripped).alias("b")))


def _whole(text: Column) -> Column:
    """The key of a whole text: of all its lines that aren't blank, in order."""
    keys = F.filter(F.transform(F.split(text, "\n"), _key), lambda k: k.isNotNull())
    return F.when(F.size(keys) > 0, F.struct(F.xxhash64(F.lit(2), keys).alias("a"), F.xxhash64(F.lit(3), keys).alias("b")))


def boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO, least_pages: int = LEAST_PAGES, least_holders: int = LEAST_HOLDERS, least_chars: int = 1, copies: bool = False) -> DataFrame:
    """(host, bad): the keys of each host's boilerplate lines, with copies those of its frequent whole texts too."""
    lines = F.array_distinct(F.transform(F.split(text, "\n"), lambda x: _key(x, least_chars)))
    if copies:
        lines = F.concat(lines, F.array(_whole(text)))
    of = pages.select(host.alias(_HOST), F.filter(lines, lambda k: k.isNotNull()).alias(_LINES))
    totals = of.groupBy(_HOST).agg(F.count("*").alias("pages")).filter(F.col("pages") >= least_pages)
    held = of.select(_HOST, F.explode_outer(_LINES).alias(_LINE)).filter(F.col(_LINE).isNotNull()).groupBy(_HOST, _LINE).agg(F.count("*").alias("holders")).filter(F.col("holders") >= least_holders)
    over = held.join(totals.withColumnRenamed(_HOST, "h"), F.col(_HOST).eqNullSafe(F.col("h"))).filter(F.col("holders") > F.lit(ratio) * F.col("pages"))
    return over.groupBy(_HOST).agg(F.sort_array(F.collect_list(_LINE)).alias(_BAD))


def drop_boilerplate(pages: DataFrame, host: Column, text: Column, into: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES, least_holders: int = LEAST_HOLDERS, least_chars: int = 1, most: float = 1.0, counts: tuple[str, str] | None = None) -> DataFrame:
    """pages with the text that remains in the new column `into` and, in new columns of the names `counts`, the numbers of
    lines before and of those gone."""
    if taken := {into, *(counts or ())} & set(pages.columns):
        raise ValueError(f"columns exist already: {sorted(taken)}")
    bad = materialize(boilerplate(pages, host, text, ratio, least_pages, least_holders, least_chars, most < 1).withColumnRenamed(_HOST, "_phonolake_of"))
    if (bad.agg(F.sum(F.size(_BAD) + 1)).first()[0] or 0) <= MOST_BROADCAST:
        bad = F.broadcast(bad)
    rows = pages.withColumn(_HOST, host).join(bad, F.col(_HOST).eqNullSafe(F.col("_phonolake_of")), "left").drop("_phonolake_of")
    lines = F.split(text, "\n")
    stays = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col(_BAD), _key(x, least_chars)), F.lit(False)))
    shorter = F.array_join(stays, "\n")
    touched = F.col(_BAD).isNotNull()
    if most < 1:
        copy = F.coalesce(F.array_contains(F.col(_BAD), _whole(text)), F.lit(False))
        touched = touched & ((F.length(shorter) >= F.lit(1 - most) * F.length(text)) | ~copy)
    kept = F.when(touched, shorter).otherwise(text)
    out = {into: kept}
    if counts:
        count = lambda a: F.coalesce(F.size(F.filter(a, lambda x: F.btrim(x, F.lit(BLANK)) != "")), F.lit(0))
        n, left = count(lines), F.when(touched, count(stays)).otherwise(count(lines))
        out |= {counts[0]: n.cast("long"), counts[1]: (n - left).cast("long")}
    return rows.withColumns(out).drop(_HOST, _BAD)


#: The same over the table pages, for DuckDB.
PAGES_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id,
    nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host,
    regexp_replace(regexp_replace(regexp_replace(html, '<(script|style|noscript)\b[^>]*>.*?</(script|style|noscript)\s*>|<!--.*?-->', '', 'gis'),
      '</?(p|div|br|li|ul|ol|h[1-6]|tr|td|table|nav|header|footer|article|section|title|body|head|html)\b[^>]*>', chr(10), 'gi'), '<[^>]*>', '', 'g') AS text
  FROM pages),
l AS (SELECT r, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM p),
s AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS t FROM l),
n AS (SELECT host, count(*) AS pages FROM p GROUP BY host HAVING count(*) >= 4),
b AS (
  SELECT c.host, t FROM (SELECT host, t, count(DISTINCT r) AS holders FROM s WHERE t <> '' GROUP BY host, t) c JOIN n ON c.host IS NOT DISTINCT FROM n.host
  WHERE holders >= 3 AND holders > CAST(0.3 AS DOUBLE) * pages),
k AS (
  SELECT r, count(*) FILTER (s.t <> '') AS n_lines, count(*) FILTER (b.t IS NOT NULL) AS n_dropped, coalesce(string_agg(s.line, chr(10) ORDER BY i) FILTER (b.t IS NULL), '') AS kept
  FROM s LEFT JOIN b ON s.host IS NOT DISTINCT FROM b.host AND s.t = b.t GROUP BY r)
SELECT page_id, p.host, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, CASE WHEN text IS NULL THEN NULL ELSE kept END AS kept FROM p LEFT JOIN k USING (r)
"""
