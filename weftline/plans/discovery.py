"""Queries that find links, requests and hints in pages, and progress in log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import discovery as D
from ..functions import urls as U
from ..sources.tables import table
from ._pairs import Pairs
from .text import SQL_STRIP

PAIRS = Pairs()

JS = [
    'fetch("/api/users/{id}"); fetch("/api/users/{id}");', "axios.post('/data/list/{id}', x); axios.get(`/api/v2/items`)", 'fetch("/b/{id}", {method: "PUT"}); "/graphql"', '$.ajax({url: "/old/{id}", type: \'get\'}); const API_URL = "https://h.example/api/";',
    'r.open("GET", "/xhr/{id}?q"); fetch(`/t/${x}/y`); fetch("/a")', 'axios({url: "/cfg/{id}", method: "delete"}); baseURL: "https://base.example/x"', "'/_/Travel/data/batchexecute'; '/travel/hotels/search?x=1'; 'a.grpc.web/b'",
]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SQL_JS = "replace(list_extract([" + ", ".join(map(_q, JS)) + "], CAST(page_id % 7 + 1 AS INTEGER)), '{id}', CAST(page_id AS VARCHAR))"
SQL_FOUND = " UNION ALL ".join(
    f"SELECT page_id, unnest(regexp_extract_all(js, {_q(p)}, {u})) AS url, {f'upper(unnest(regexp_extract_all(js, {_q(p)}, {m})))' if m else 'CAST(NULL AS VARCHAR)'} AS method, '{name}' AS source FROM s" for name, p, u, m in D.ENDPOINTS
)
SQL_SCORE = "CASE WHEN method = 'GET' THEN 10 WHEN method IS NULL THEN 5 ELSE 0 END + CASE WHEN contains(url, '/api/') THEN 20 ELSE 0 END + CASE WHEN contains(url, 'graphql') THEN 15 ELSE 0 END + " + " + ".join(f"CASE WHEN contains(lower(url), '{w}') THEN 5 ELSE 0 END" for w in D.DATA_WORDS) + " - CASE WHEN strlen(url) > 100 THEN 10 ELSE 0 END - CASE WHEN contains(url, '?') AND NOT contains(url, '=') THEN 5 ELSE 0 END"
SQL_ENDPOINTS = f"WITH s AS (SELECT page_id, {SQL_JS} AS js FROM pages), f AS ({SQL_FOUND}), e AS (SELECT DISTINCT * FROM f WHERE NOT contains(url, '${{') AND strlen(url) >= 4), r AS (SELECT *, CAST({SQL_SCORE} AS INTEGER) AS score FROM e)"


def _endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    js = F.replace(F.element_at(F.array(*map(F.lit, JS)), (F.col("page_id") % len(JS) + 1).cast("int")), F.lit("{id}"), F.col("page_id").cast("string"))
    html = F.concat(F.lit("<html><script src='x.js'>fetch(\"/never\")</script><script type='m'>"), js, F.lit("</script>"))
    scripts = table(spark, sf_dir, "pages").select("page_id", F.explode(D.inline_scripts(html)).alias("js"))
    found = scripts.select("page_id", F.explode(D.endpoints(F.col("js"))).alias("e")).select("page_id", "e.*")
    return found.withColumn("score", D.score(F.col("url"), F.col("method")))


@PAIRS.add(SQL_ENDPOINTS + " SELECT page_id, url, method, source, score, CAST(row_number() OVER (PARTITION BY page_id ORDER BY url, method, source) AS INTEGER) AS n FROM r")
def api_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests named in pages' inline scripts, in order of their url."""
    return _endpoints(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("url", F.asc_nulls_last("method"), "source")))


@PAIRS.add(SQL_ENDPOINTS + """, t AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, url, method, source) AS n FROM r)
SELECT page_id, CAST(n AS INTEGER) AS n, url, CASE WHEN starts_with(url, 'http') THEN url WHEN starts_with(url, '/') THEN 'https://page.example' || url END AS full_url FROM t WHERE n <= 3 AND (method IS NULL OR method = 'GET')""")
def endpoints_to_try(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three likeliest requests of each page, of which those that read are kept."""
    top = _endpoints(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "url", F.asc_nulls_last("method"), "source"))).filter("n <= 3")
    return top.filter("method is null or method = 'GET'").select("page_id", "n", "url", U.resolve_endpoint(F.lit("https://page.example/a/b"), F.col("url")).alias("full_url"))


@PAIRS.add(f"""
WITH h AS (SELECT page_id, '<a href="#x">x</a><a href="javascript:y()">y</a><a class="k" href="/Ouwhea"><b>twice</b></a>' || html AS html FROM pages),
l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref="([^"]*)"[^>]*>(.*?)</a>', 1)) AS href, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref="([^"]*)"[^>]*>(.*?)</a>', 2)) AS t,
 generate_subscripts(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref="([^"]*)"[^>]*>(.*?)</a>', 1), 1) AS i FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY i) AS n FROM l WHERE NOT starts_with(href, '#') AND NOT starts_with(href, 'javascript:'))
SELECT page_id, trim({SQL_STRIP.format(x="t")}, ' ') AS text, href, count(*) OVER (PARTITION BY page_id) AS n_links FROM r WHERE n = 1
""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.lit('<a href="#x">x</a><a href="javascript:y()">y</a><a class="k" href="/Ouwhea"><b>twice</b></a>'), F.col("html"))
    df = table(spark, sf_dir, "pages").select("page_id", D.links(html).alias("l"))
    return df.select("page_id", F.size("l").cast("long").alias("n_links"), F.explode("l").alias("x")).select("page_id", "x.text", "x.href", "n_links")


@PAIRS.add("""
SELECT s_suppkey, '/a' || s_suppkey AS url, CASE s_suppkey % 5 WHEN 0 THEN 'preload' WHEN 1 THEN 'preconnect' ELSE 'prefetch' END AS rel, CASE WHEN s_suppkey % 5 = 0 THEN 'style' END AS as_type, CASE s_suppkey % 5 WHEN 1 THEN 'anonymous' WHEN 2 THEN 'use-credentials' END AS crossorigin FROM supplier WHERE s_suppkey % 5 < 3
""")
def link_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    url = F.concat(F.lit("</a"), k.cast("string"), F.lit(">"))
    header = F.when(k % 5 == 0, F.concat(url, F.lit('; rel="preload"; AS=style'))).when(k % 5 == 1, F.concat(url, F.lit("; rel=preconnect; crossorigin"))).when(k % 5 == 2, F.concat(url, F.lit('; x=1; rel=prefetch;crossorigin="use-credentials"'))).when(k % 5 == 3, F.concat(url, F.lit("; as=script"))).otherwise("<>; rel=preload")
    df = table(spark, sf_dir, "supplier").select("s_suppkey", D.link_header(header).alias("l"))
    return df.filter("l is not null").select("s_suppkey", "l.*")


@PAIRS.add("""
SELECT s_suppkey, unnest(['https://c' || s_suppkey || '.example', '/f.woff2']) AS url, unnest(['preconnect', 'preload']) AS rel, unnest([NULL, 'font']) AS as_type, unnest([NULL, 'anonymous']) AS crossorigin FROM supplier
""")
def link_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.lit("<LINK rel=preconnect href=https://c"), F.col("s_suppkey").cast("string"), F.lit(".example><link rel='stylesheet' href='/s.css'><link rel=\"preload\" href=\"/f.woff2\" as='font' crossorigin=\"anonymous\"><link rel=icon>"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(D.link_hints(html)).alias("h")).select("s_suppkey", "h.*")


@PAIRS.add("""
SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 3600.0 + s_suppkey % 60 * 60 + 5.25 END AS seconds, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 1.5 ELSE NULL END AS speed, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_suppkey * 1000 + 500 AS BIGINT) END AS bitrate_bps,
 CAST(s_suppkey * CASE s_suppkey % 3 WHEN 0 THEN 1024 WHEN 1 THEN 1048576 ELSE NULL END AS BIGINT) AS bytes FROM supplier
""")
def progress_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    line = F.when(k % 4 == 0, "frame= 1 fps= 30").otherwise(F.concat(F.lit("frame= 9 time=01:"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit(":05.25 bitrate="), k.cast("string"), F.lit(".5kbits/s speed=1.5x"), F.when(k % 4 == 1, "").otherwise(" ")))
    loaded = F.concat(F.lit("[cli] Downloaded "), k.cast("string"), F.when(k % 3 == 0, " KiB").when(k % 3 == 1, " MiB").otherwise(" parts"))
    df = table(spark, sf_dir, "supplier").select("s_suppkey", D.encoder_progress(line).alias("p"), D.download_progress(loaded).alias("bytes"))
    return df.select("s_suppkey", "p.seconds", "p.speed", "p.bitrate_bps", "bytes")
