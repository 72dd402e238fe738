"""Scalar functions applied over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import times as T
from ..functions import urls as U
from ..sources.tables import table
from ._pairs import Pairs

PAIRS = Pairs()

SQL_STRIP = "replace(replace(replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]*(>|$)', '', 'g'), '>', ''), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' ')"
SQL_COUNT = "CASE WHEN {n} < 0 THEN '-' ELSE '' END || CASE WHEN abs({n}) >= 1000000 THEN printf('%.1fM', abs({n}) / 1000000.0) WHEN abs({n}) >= 1000 THEN printf('%.1fK', abs({n}) / 1000.0) ELSE CAST(abs({n}) AS VARCHAR) END"


@PAIRS.add(f"""
SELECT doc_id, {SQL_STRIP.format(x="'<p class=\"a\">' || replace(text, ' the ', ' <b>the</b> &amp;lt; &quot;x&#39; ') || '&nbsp;> tail <unclosed ' || doc_id")} AS text FROM documents
""")
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('<p class="a">'), F.replace("text", F.lit(" the "), F.lit(" <b>the</b> &amp;lt; &quot;x&#39; ")), F.lit("&nbsp;> tail <unclosed "), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", X.strip_tags(body).alias("text"))


@PAIRS.add(f"""
WITH n AS (SELECT o_orderkey, CAST(o_orderkey * o_custkey AS BIGINT) * CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE 1 END AS n FROM orders)
SELECT o_orderkey, n, {SQL_COUNT.format(n="n")} AS label FROM n
""")
def format_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("o_orderkey") * F.col("o_custkey") * F.when(F.col("o_orderkey") % 5 == 0, -1).otherwise(1)).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", n.alias("n")).select("o_orderkey", "n", X.format_count(F.col("n")).alias("label"))


@PAIRS.add(r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w FROM documents),
-- the lines so far, each ended by a line feed but the last
r AS (SELECT doc_id, list_reduce(list_prepend('', w), lambda a, x:
   CASE WHEN a = '' THEN x
        WHEN length(a) - length(replace(a, chr(10), '')) >= 4 THEN a
        WHEN strlen(regexp_extract(a, '([^\n]*)$', 1)) + 1 + strlen(x) <= 40 THEN a || ' ' || x
        ELSE a || chr(10) || x END) AS a FROM w)
SELECT doc_id, array_to_string(string_split(a, chr(10))[1:4], chr(10)) AS wrapped FROM r
""")
def wrap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.wrap(F.col("text")).alias("wrapped"))


@PAIRS.add(r"""
WITH t AS (SELECT conv_id, turn, text || CASE conv_id % 5 WHEN 0 THEN ' code: 123456' WHEN 1 THEN ' use 123-456 now' WHEN 2 THEN ' verification 12345678x' WHEN 3 THEN ' number 654321.' ELSE '' END AS t FROM conversations),
m AS (SELECT *, regexp_extract(t, '(?:code|otp|verification)[:\s]*(\d{6,8})|\b(\d{3}[-\s]?\d{3})\b', 1) || regexp_extract(t, '(?:code|otp|verification)[:\s]*(\d{6,8})|\b(\d{3}[-\s]?\d{3})\b', 2) AS g FROM t)
SELECT conv_id, turn, nullif(CASE WHEN length(regexp_replace(g, '[-\s]', '', 'g')) >= 6 THEN regexp_replace(g, '[-\s]', '', 'g') ELSE regexp_extract(t, '\b(\d{6})\b', 1) END, '') AS code,
  CASE WHEN strlen(t) <= 50 THEN t ELSE t[1:47] || '...' END AS preview FROM m
""")
def detect_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = F.element_at(F.array(*map(F.lit, [" code: 123456", " use 123-456 now", " verification 12345678x", " number 654321.", ""])), (F.col("conv_id") % 5 + 1).cast("int"))
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", extra).alias("t"))
    return df.select("conv_id", "turn", X.code_in(F.col("t")).alias("code"), X.truncate(F.col("t"), 50).alias("preview"))


@PAIRS.add("""
SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/' AS referer,
  url_encode(url || ' ~*é') AS encoded,
  array_to_string(list_sort([url_encode('url') || '=' || url_encode(url), 'b%20c=' || page_id, 'a=%26']), '&') AS form,
  regexp_extract(url, '^(https?://[^/]+)', 1) || '/x/y' AS abs_url, regexp_extract(url, '^(.*/)[^/]*$', 1) || 'seg1.ts' AS rel_url, CAST(NULL AS VARCHAR) AS dropped, 'seg1.ts' AS passed,
  nullif(regexp_extract('Post by (@user' || page_id || ') on ' || url, '(@[^\\s)]*)', 1), '') AS handle
FROM pages
""".replace("\\\\s", "\\s"))
def url_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, page = F.col("url"), F.col("page_id").cast("string")
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    return table(spark, sf_dir, "pages").select(
        "page_id", U.host(url).alias("host"), U.referer(url).alias("referer"), U.encode(F.concat(url, F.lit(" ~*é"))).alias("encoded"),
        U.form_encoded(F.array(pair("url", url), pair("b c", page), pair("a", F.lit("&")))).alias("form"),
        U.resolve_playlist(url, F.lit("/x/y")).alias("abs_url"), U.resolve_playlist(url, F.lit("seg1.ts")).alias("rel_url"), U.resolve_endpoint(url, F.lit("seg1.ts")).alias("dropped"), U.resolve_script(url, F.lit("seg1.ts")).alias("passed"),
        X.handle(F.concat(F.lit("Post by (@user"), page, F.lit(") on "), url)).alias("handle"),
    )


SQL_CLOCK = "lpad(CAST(CAST(floor({s} / 3600) AS BIGINT) AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(({s} % 3600.0) / 60) AS BIGINT) AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor({s} % 60.0) AS BIGINT) AS VARCHAR), 2, '0') || '{mark}' || lpad(CAST(CAST(floor(({s} % 1.0) * 1000) AS BIGINT) AS VARCHAR), 3, '0')"
SQL_SRT = "lpad(CAST({m} // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({m} % 3600000 // 60000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({m} % 60000 // 1000 AS VARCHAR), 2, '0') || '{mark}' || lpad(CAST({m} % 1000 AS VARCHAR), 3, '0')"
SQL_ASS = "CAST({m} // 3600000 AS VARCHAR) || ':' || lpad(CAST({m} % 3600000 // 60000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({m} % 60000 // 1000 AS VARCHAR), 2, '0') || '.' || lpad(CAST({m} % 1000 // 10 AS VARCHAR), 2, '0')"


@PAIRS.add(f"""
WITH t AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 7 AS s, CAST(trunc(l_extendedprice * 100) AS BIGINT) AS m FROM lineitem)
SELECT l_orderkey, l_linenumber, m, {SQL_CLOCK.format(s="s", mark=",")} AS clock, {SQL_SRT.format(m="m", mark=",")} AS srt, {SQL_SRT.format(m="m", mark=".")} AS vtt, {SQL_ASS.format(m="m")} AS ass,
  m AS back, CAST(trunc(s * 1000) AS BIGINT) AS ms FROM t
""")
def time_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 7).alias("s"), (F.col("l_extendedprice") * 100).cast("long").alias("m"))
    m, s = F.col("m"), F.col("s")
    return df.select("l_orderkey", "l_linenumber", "m", T.clock(s, ",").alias("clock"), T.srt_time(m).alias("srt"), T.srt_time(m, ".").alias("vtt"), T.ass_time(m).alias("ass"), T.srt_ms(T.srt_time(m)).alias("back"), T.to_ms(s).alias("ms"))


@PAIRS.add("""
WITH t AS (SELECT o_orderkey, o_orderkey % 5 AS h, o_custkey % 90 AS m, o_orderkey % 61 AS s FROM orders)
SELECT o_orderkey, nullif(h * 3600 + m * 60 + s, 0) AS iso, nullif(h * 3600 + m * 60 + s, 0) AS spoken, 'S' || (h + 1) || 'E' || m || ' ' || ((m * 60 + s) // 60) || ':' || lpad(CAST((m * 60 + s) % 60 AS VARCHAR), 2, '0') AS label,
  strftime(make_timestamp(CAST(o_orderkey * 86399 AS BIGINT) * 1000000), '%Y-%m-%d') AS day FROM t
""")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, m, s = F.col("o_orderkey") % 5, F.col("o_custkey") % 90, F.col("o_orderkey") % 61
    df = table(spark, sf_dir, "orders").select("o_orderkey", h.alias("h"), m.alias("m"), s.alias("s"))
    part = lambda c, unit: F.concat(F.col(c).cast("string"), F.lit(unit))
    iso = F.concat(F.lit("PT"), part("h", "H"), part("m", "M"), part("s", "S"))
    spoken = F.concat(part("h", "h"), part("m", "m"), F.when(F.col("o_orderkey") % 2 == 0, part("s", "s")).otherwise(F.col("s").cast("string")))
    return df.select("o_orderkey", T.iso_duration(iso).alias("iso"), T.spoken_duration(spoken).alias("spoken"), T.episode_label(F.col("h") + 1, F.col("m"), F.col("m") * 60 + F.col("s")).alias("label"), T.day(F.col("o_orderkey") * 86399).alias("day"))
