"""Queries on fetch results, made from pages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..operators import responses as R
from ..sources.tables import table
from ._pairs import Pairs

PAIRS = Pairs()


@PAIRS.add("""SELECT page_id, url FROM pages WHERE page_id % 5 < 3""")
def batch_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 5
    line = F.when(k < 2, F.concat(F.lit("  "), F.col("url"), F.lit("\t"))).when(k == 2, F.col("url")).when(k == 3, F.concat(F.lit(" # "), F.col("url"))).otherwise("   ")
    return R.urls_of(table(spark, sf_dir, "pages").select("page_id", line.alias("line")), "line").select("page_id", "url")


@PAIRS.add("""SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'ERR ' || url || ' "timed out"' ELSE '200 ' || strlen(html) || 'B ' || printf('%.0f', page_id * 1.3) || 'ms ' || url END AS line,
 chr(10) || html[1:300] || CASE WHEN strlen(html) > strlen(html[1:300]) THEN chr(10) || chr(10) || '... [' || (strlen(html) - strlen(html[1:300])) || ' more bytes]' ELSE '' END AS shown, count(*) FILTER (WHERE page_id % 7 <> 0) OVER () AS n_ok FROM pages""")
def batch_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    error = F.when(F.col("page_id") % 7 == 0, "timed out")
    n_ok = p.agg(F.count_if(F.col("page_id") % 7 != 0).alias("n_ok"))
    out = p.select("page_id", R.compact_line(F.lit(200), F.octet_length("html"), F.col("page_id") * 1.3, F.col("url"), error).alias("line"), R.shown(F.col("html"), 300).alias("shown"))
    return out.crossJoin(F.broadcast(n_ok))  # one row


@PAIRS.add("""SELECT page_id, json_extract_string(j, '$.url') AS url, json_extract_string(j, '$.t') AS title, CAST(json_extract_string(j, '$.n') AS BIGINT) AS content_length, CAST(round(page_id * 0.137, 1) AS DOUBLE) AS elapsed_ms
 FROM (SELECT page_id, json_object('url', url, 't', regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), 'n', strlen(html)) AS j FROM pages)""".replace("'t', regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)", "'t', replace(replace(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '&quot;', '\"'), '&amp;', '&')"))
def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as JSON and read again."""
    j = R.as_json(F.col("url"), F.lit(200), F.lit("text/html"), F.col("html"), H.title(F.col("html")), F.col("page_id") * 0.137)
    got = table(spark, sf_dir, "pages").select("page_id", F.from_json(j, "url STRING, metadata STRUCT<title: STRING, content_length: BIGINT>, elapsed_ms DOUBLE").alias("r"))
    return got.select("page_id", "r.url", "r.metadata.title", "r.metadata.content_length", "r.elapsed_ms")


@PAIRS.add("""WITH q AS (SELECT user_id AS id, min(event_id) AS req_ts FROM events GROUP BY 1), p AS (SELECT user_id AS id, event_id + 3.5 AS resp_ts, CASE WHEN event_type = 'error' THEN 'error' ELSE 'result' END AS outcome FROM events),
 m AS (SELECT q.*, resp_ts, outcome, row_number() OVER (PARTITION BY q.id ORDER BY resp_ts) AS n FROM q JOIN p ON p.id = q.id AND resp_ts >= req_ts AND resp_ts <= req_ts + 60)
SELECT q.id, CAST(q.req_ts AS DOUBLE) AS req_ts, CAST(resp_ts AS DOUBLE) AS resp_ts, outcome FROM q LEFT JOIN m ON q.id = m.id AND n = 1""")
def answered_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reply to each request within a minute."""
    e = table(spark, sf_dir, "events")
    asks = e.groupBy(F.col("user_id").alias("id")).agg(F.min("event_id").cast("double").alias("req_ts"))
    replies = e.select(F.col("user_id").alias("id"), (F.col("event_id") + 3.5).alias("resp_ts"), F.when(F.col("event_type") == "error", "error").otherwise("result").alias("outcome"))
    return R.answered(asks, replies, 60.0)


@PAIRS.add("""SELECT page_id, 'a=mine&b=' || page_id || '&c=' || url AS fields, CASE WHEN page_id % 3 = 0 THEN '' ELSE html END AS page_content, CAST(CASE WHEN page_id % 3 = 0 THEN 0 ELSE 200 END AS INTEGER) AS status,
 '.site.example' || chr(9) || 'TRUE' || chr(9) || '/' || chr(9) || CASE WHEN page_id % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END || chr(9) || page_id || chr(9) || 'k' || chr(9) || 'v' || page_id AS cookie FROM pages""")
def merged_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form fields with one's own over them, results as retrieval documents, and rows of a supplied cookie table as text."""
    i = F.col("page_id").cast("string")
    own = F.map_from_entries(R.field_args(F.array(F.lit("a=mine"), F.concat(F.lit("c="), F.col("url")))))
    form = F.create_map(F.lit("a"), F.lit("theirs"), F.lit("b"), i)
    fields = F.array_join(F.transform(F.array_sort(F.map_entries(R.merged_fields(form, own))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&")
    cookie = R.cookie_lines(F.lit(".site.example"), F.lit("/"), F.col("page_id") % 2 == 0, F.col("page_id"), F.lit("k"), F.concat(F.lit("v"), i))
    failed = F.col("page_id") % 3 == 0
    p = table(spark, sf_dir, "pages").select("page_id", "url", fields.alias("fields"), cookie.alias("cookie"), F.when(~failed, F.col("html")).alias("markdown"), F.when(~failed, 200).alias("status"), F.lit(1.0).alias("time_ms"))
    docs = R.documents_of(p.withColumn("url", F.concat_ws("|", "page_id", "fields", "cookie")))
    keys = F.split(F.col("metadata.source"), r"\|")
    return docs.select(F.get(keys, F.lit(0)).cast("long").alias("page_id"), F.get(keys, F.lit(1)).alias("fields"), "page_content", F.col("metadata.status").alias("status"), F.get(keys, F.lit(2)).alias("cookie"))


@PAIRS.add("""SELECT page_id, CASE WHEN page_id % 7 = 0 THEN chr(10) || '❌ ' || url || ' - "timed out"' ELSE chr(10) || '🌐 ' || url || ' [200 ' || printf('%.0f', page_id * 1.3) || 'ms]' || chr(10) || html[1:300] END AS full_text FROM pages""")
def batch_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every result with its heading and its body up to 300 characters."""
    error = F.when(F.col("page_id") % 7 == 0, "timed out")
    return table(spark, sf_dir, "pages").select("page_id", R.full_text(F.lit(200), F.col("page_id") * 1.3, F.col("url"), error, F.col("html"), True, 300).alias("full_text"))


@PAIRS.add("""WITH r AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '{"error":"timed out","url":"' || url || '"}' ELSE '{"url":"' || url || '","status":200,"elapsed_ms":1.5}' END AS j FROM pages)
SELECT page_id // 100 AS part, '[' || string_agg(j, ',' ORDER BY page_id) || ']' AS json FROM r GROUP BY 1""")
def batch_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results and errors as JSON arrays, a hundred page numbers to each."""
    ok = F.to_json(F.struct("url", F.lit(200).alias("status"), F.lit(1.5).alias("elapsed_ms")))
    j = F.when(F.col("page_id") % 7 == 0, R.error_json(F.col("url"), F.lit("timed out"))).otherwise(ok)
    return R.as_array(table(spark, sf_dir, "pages").select("page_id", j.alias("json")), "page_id", 100, "page_id")
