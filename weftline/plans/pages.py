"""Queries over captured pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..sources.tables import table


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and clean text of each page. A deterministic boilerplate line is added to some pages, so that the filter has work."""
    pages = table(spark, sf_dir, "pages")
    extra = F.element_at(F.array(*map(F.lit, EXTRA_LINES)), (F.col("page_id") % len(EXTRA_LINES) + 1).cast("int"))
    body = F.concat(extra, F.lit("<br>"), F.col("html"))
    return pages.select("page_id", H.title(F.col("html")).alias("title"), F.array_join(H.page_lines(body), "\n").alias("text")).select("page_id", "title", "text", F.octet_length("text").cast("long").alias("n_bytes"))


EXTRA_LINES = ["Skip to content", "We use Cookies here", "© 2025 Some Company", "[Cookie link](https://example.com)", "--", "a plain line"]

SQL_TEXT = r"""
regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({html},
 '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?is)<head\b.*?</head\s*>', ' ', 'g'),
 '(?s)<!--.*?-->', ' ', 'g'), '(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|blockquote|pre|hr|main|aside|form)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')
"""
SQL_ENTITIES = "replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"

PAGE_TEXT_SQL = (
    """
WITH raw AS (
  SELECT page_id, html, list_extract(["""
    + ", ".join("'" + x + "'" for x in EXTRA_LINES)
    + """], CAST(page_id % 6 + 1 AS INTEGER)) || '<br>' || html AS body FROM pages
), lines AS (
  SELECT page_id, html, list_filter(list_transform(string_split("""
    + SQL_ENTITIES.format(x=SQL_TEXT.format(html="body"))
    + r""", chr(10)), lambda x: regexp_replace(x, '^[ \t\r\f\v\x{00A0}]+|[ \t\r\f\v\x{00A0}]+$', '', 'g')),
    lambda x: x <> '' AND NOT (NOT contains(x, '](') AND (contains(lower(x), 'skip to content') OR contains(lower(x), 'cookie')
      OR contains(lower(x), 'privacy policy') OR contains(lower(x), 'terms of service') OR starts_with(lower(x), '©')
      OR starts_with(lower(x), 'copyright') OR (strlen(x) < 3 AND NOT regexp_matches(lower(x), '[\p{L}\p{N}]'))))) AS l FROM raw
)
SELECT page_id, regexp_replace("""
    + SQL_ENTITIES.format(x=r"nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '')")
    + r""", '^[ \t\r\f\v\x{00A0}]+|[ \t\r\f\v\x{00A0}]+$', '', 'g') AS title,
  array_to_string(l, chr(10)) AS text, CAST(strlen(array_to_string(l, chr(10))) AS BIGINT) AS n_bytes FROM lines
"""
)

QUERIES = {"page_text": page_text}
ORACLES = {"page_text": PAGE_TEXT_SQL}
