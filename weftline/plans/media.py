"""Queries on records of media tools, made from suppliers and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions import media as M
from ..sources.tables import table
from ._pairs import Pairs

PAIRS = Pairs()


@PAIRS.add("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey + 0.5 ELSE 0.0 END AS duration, 1920 AS width, 1080 AS height, CAST(CASE s_suppkey % 3 WHEN 0 THEN 25.0 WHEN 1 THEN 24.0 ELSE 30.0 END AS FLOAT) AS fps, CASE WHEN s_suppkey % 2 = 0 THEN 2 END AS channels, CASE WHEN s_suppkey % 2 = 0 THEN 48000 END AS sample_rate FROM supplier WHERE s_suppkey % 5 <> 0""")
def probed_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    video = F.concat(F.lit('{"codec_type":"video","width":1920,"height":1080,"r_frame_rate":"'), F.when(k % 3 == 0, "50/2").when(k % 3 == 1, "24").otherwise("bad"), F.lit('"}'))
    parts = F.array_compact(F.array(F.lit('{"codec_type":"data"}'), F.when(k % 5 != 0, video), F.when(k % 2 == 0, '{"codec_type":"audio","channels":2,"sample_rate":"48000"}')))
    json = F.concat(F.lit('{"format":{"duration":"'), F.when(k % 4 == 0, F.concat(k.cast("string"), F.lit(".5"))).otherwise("N/A"), F.lit('"},"streams":['), F.array_join(parts, ","), F.lit("]}"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", M.probe(json).alias("p")).filter("p is not null").select("s_suppkey", "p.*")


@PAIRS.add("""SELECT conv_id, CAST(turn AS INTEGER) AS id, CAST(turn * 2500 AS BIGINT) AS start_ms, CAST(turn * 2500 + 1250 AS BIGINT) AS end_ms, text, CASE WHEN turn % 2 = 0 THEN role END AS speaker, CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END AS n_words, 'fi' AS language FROM conversations""")
def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    word = F.array(F.struct(F.lit("w").alias("word"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end")))
    seg = F.struct(t.alias("id"), (t * 2.5).alias("start"), (t * 2.5 + 1.25).alias("end"), F.concat(F.lit(" "), F.col("text"), F.lit(" ")).alias("text"), F.when(t % 2 == 0, F.col("role")).alias("speaker"), F.when(t % 3 == 0, word).alias("words"))
    records = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.lit("fi").alias("language"), F.array_sort(F.collect_list(seg)).alias("segments"))).alias("j"))
    return records.select("conv_id", F.explode(M.transcript(F.col("j"))).alias("s")).select("conv_id", "s.*")


@PAIRS.add("""WITH t AS (SELECT conv_id, count(*) AS n, bool_and(conv_id % 4 = 0) AS scanned, string_agg(CASE WHEN turn % 3 = 1 THEN '' WHEN r > 1 THEN chr(10) || chr(10) || '---' || chr(10) || chr(10) || text ELSE text END, '' ORDER BY turn) AS x FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) GROUP BY conv_id)
SELECT conv_id, CASE WHEN conv_id % 7 = 0 THEN NULL WHEN scanned OR x = '' THEN '*Scanned PDF (' || n || ' pages) -- no text layer detected. Use OCR to extract text.*' ELSE x END AS markdown FROM t""")
def paged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page texts joined in order; blank ones, scanned documents, and bodies that are too large."""
    text = F.when(F.col("conv_id") % 4 == 0, "").when(F.col("turn") % 3 == 1, "").otherwise(F.col("text"))
    pages = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", text.alias("t")))).alias("p"))
    size = F.when(F.col("conv_id") % 7 == 0, M.MAX_BODY + 1).otherwise(1000)
    return pages.select("conv_id", M.paged_text(F.transform("p", lambda x: x["t"]), size).alias("markdown"))


@PAIRS.add(r"""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'ass=''/a\:b/' || s_suppkey || '.ass'',' ELSE '' END || 'drawtext=text=''it\''s ' || s_suppkey || '\n2\:1'':fontfile=/System/Library/Fonts/Supplemental/Arial.ttf:fontsize=48:fontcolor=0xFFFFFF:x=20:y=20:borderw=2:bordercolor=0x000000:enable=''between(t,' || CAST(s_suppkey AS VARCHAR) || ',' || CAST(s_suppkey AS VARCHAR) || '.25)''' AS graph,
 '{"k":' || s_suppkey || '}' AS data FROM supplier""")
def overlay_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    i = k.cast("string")
    entry = F.struct(F.concat(F.lit("it's "), i, F.lit("\n2:1")).alias("text"), (k * 1000).alias("start_ms"), (k * 1000 + 250).alias("end_ms"), F.lit("Arial").alias("font"), F.lit(48).alias("size"), F.lit("FFFFFF").alias("color"), F.lit("000000").alias("outline_color"), F.lit(2.9).alias("outline"), F.lit("top_left").alias("position"))
    data = M.own_data(F.create_map(F.lit("_x"), F.lit(1), F.lit("window"), F.lit(2), F.lit("k"), k.cast("int")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", M.filter_graph(F.when(k % 2 == 0, F.concat(F.lit("/a:b/"), i, F.lit(".ass"))), F.array(entry)).alias("graph"), F.to_json(data).alias("data"))


def _scheme(url: str) -> dict:
    if url.endswith("/"):
        raise ValueError("no page")
    return {"markdown": url.split("://")[0], "metadata": {"title": url.rsplit("/", 1)[1]}}


@PAIRS.add(r"""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS markdown, regexp_extract(url, '([^/]*)$', 1) AS title, CAST(NULL AS VARCHAR) AS error FROM pages WHERE url LIKE 'https://%' AND NOT url LIKE '%/' UNION ALL SELECT page_id, NULL, NULL, 'ValueError: no page' FROM pages WHERE url LIKE 'https://%/'""")
def plugin_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered function on the urls that fit its pattern."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    found = M.by_plugins(p.select("url").distinct(), [("^https://", _scheme)])
    return p.join(found, "url").select("page_id", "markdown", "title", "error")


@PAIRS.add("""SELECT event_id, '{"a":[1,"x"],"b":{"k":' || json_extract_string(props, '$.k') || '}}' AS small FROM events""")
def json_minified(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('{ "b": '), F.col("props"), F.lit(' , "a": [ 1, "x" ] }'))
    return table(spark, sf_dir, "events").select("event_id", J.pruned(text, 1000, 100).alias("small"))
