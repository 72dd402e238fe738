"""Queries on streaming manifests, made from suppliers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import manifests as M
from ..sources.tables import table
from ._pairs import Pairs

PAIRS = Pairs()


def masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    one = lambda b, res, uri: F.concat(F.lit("#EXT-X-STREAM-INF:"), F.when(b.isNotNull(), F.concat(F.lit("BANDWIDTH="), b.cast("string"), F.lit(","))).otherwise(""), F.lit(f'RESOLUTION={res},CODECS="avc1,mp4a"\n{uri}\n'))
    body = F.concat(F.lit("#EXTM3U\r\n"), one(k * 1000 % 7000000 + 1, "1920x1080", "hi/v.m3u8"), one(k * 777 % 5000000, "1280x720", "/mid.m3u8"), one(k, "1x1", "#lost"), F.lit("lost.m3u8\n"), one(F.lit(None).cast("long"), "640x360", "https://cdn.example/low.m3u8"), F.lit("#EXT-X-STREAM-INF:BANDWIDTH=5\n#EXT-X-STREAM-INF:BANDWIDTH=6\nboth-lost.m3u8\n"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.lit("https://media.example/show/master.m3u8").alias("url"), body.alias("body"))


SQL_VARIANTS = """
WITH v AS (SELECT s_suppkey, 0 AS pos, s_suppkey * 1000 % 7000000 + 1 AS bandwidth, 1080 AS height, 'https://media.example/show/hi/v.m3u8' AS uri FROM supplier UNION ALL SELECT s_suppkey, 1, s_suppkey * 777 % 5000000, 720, 'https://media.example/mid.m3u8' FROM supplier
 UNION ALL SELECT s_suppkey, 2, 0, 360, 'https://cdn.example/low.m3u8' FROM supplier), r AS (SELECT s_suppkey, CAST(bandwidth AS BIGINT) AS bandwidth, CAST(height AS INTEGER) AS height, 'avc1,mp4a' AS codecs, uri, CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY bandwidth DESC, pos) AS INTEGER) AS rank FROM v)
"""


@PAIRS.add(SQL_VARIANTS + "SELECT * FROM r")
def playlist_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.variants(masters(spark, sf_dir), "s_suppkey")


@PAIRS.add(SQL_VARIANTS + """SELECT s_suppkey, 'best' AS quality, uri FROM r WHERE rank = 1 UNION ALL SELECT s_suppkey, 'worst', uri FROM r WHERE rank = 3
 UNION ALL (SELECT s_suppkey, 'height', uri FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(height - 700), rank) AS n FROM r) WHERE n = 1)""")
def chosen_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = M.variants(masters(spark, sf_dir), "s_suppkey")
    parts = [M.choose(v, "s_suppkey", q, 700).select("s_suppkey", F.lit(q).alias("quality"), "uri") for q in ("best", "worst", "height")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A media playlist for each supplier: its number of parts, durations and end follow from its key."""
    k = F.col("s_suppkey")
    part = lambda i: F.concat(F.when(i % 3 != 2, F.concat(F.lit("#EXTINF:"), F.when(i % 4 == 1, "bad").otherwise(F.concat(((k + i) % 9).cast("string"), F.lit(".5"))), F.lit(",title\n"))).otherwise("#comment\n"), F.lit("seg"), i.cast("string"), F.lit(".ts\n"))
    body = F.concat(F.lit("#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:"), k.cast("string"), F.lit("\n"), F.when(k % 2 == 0, "#EXT-X-TARGETDURATION:6\n").otherwise(""), F.array_join(F.transform(F.sequence(F.lit(0), (k % 12).cast("int")), part), ""), F.when(k % 3 == 0, "#EXT-X-ENDLIST\n").otherwise(""))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.lit("https://media.example/show/p.m3u8").alias("url"), body.alias("body"))


SQL_SEGMENTS = """
WITH s AS (SELECT s_suppkey, unnest(range(0, s_suppkey % 12 + 1)) AS i FROM supplier),
d AS (SELECT *, CASE WHEN s_suppkey % 2 = 0 THEN 6.0 ELSE 10.0 END AS t, CASE WHEN i % 3 = 2 THEN i - 1 ELSE i END AS j FROM s),
r AS (SELECT s_suppkey, CAST(i AS INTEGER) AS idx, s_suppkey + i AS sequence, CAST(CASE WHEN j % 4 = 1 THEN t ELSE (s_suppkey + j) % 9 + 0.5 END AS DOUBLE) AS duration, 'https://media.example/show/seg' || i || '.ts' AS uri, s_suppkey % 3 <> 0 AS is_live, CAST(t AS DOUBLE) AS target_duration FROM d)
"""


@PAIRS.add(SQL_SEGMENTS + "SELECT * FROM r")
def playlist_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.segments(media(spark, sf_dir), "s_suppkey")


@PAIRS.add(SQL_SEGMENTS + """SELECT s_suppkey, idx, uri, CAST(sum(CAST(idx * 100 + 7 AS BIGINT)) OVER w AS BIGINT) AS bytes_done, count(*) OVER w AS parts_done FROM r WHERE idx < ceil(33 / target_duration) WINDOW w AS (PARTITION BY s_suppkey ORDER BY idx ROWS UNBOUNDED PRECEDING)""")
def download_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts that cover 33 seconds, with running totals."""
    parts = M.first_seconds(M.segments(media(spark, sf_dir), "s_suppkey"), 33.0).withColumn("size", (F.col("idx") * 100 + 7).cast("long"))
    return M.progress(parts, "s_suppkey", "size").select("s_suppkey", "idx", "uri", "bytes_done", "parts_done")


@PAIRS.add("""
WITH e AS (SELECT user_id, event_id, event_id * 7919 % 211 AS sequence FROM events), m AS (SELECT *, max(sequence) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e)
SELECT user_id, event_id, sequence FROM m WHERE sequence > greatest(0, coalesce(top, 0))
""")
def live_new_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of following a live playlist; the streaming form keeps the same state."""
    polls = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") * 7919 % 211).alias("sequence"))
    return M.newly_seen(polls, "user_id", ["event_id"])


@PAIRS.add("""
WITH p AS (SELECT user_id, event_id AS poll, event_id // 3 AS made, event_id % 17 <> 0 AS is_live FROM events), e AS (SELECT user_id, min(poll) FILTER (WHERE NOT is_live) AS last FROM p GROUP BY 1)
SELECT p.user_id, poll FROM p JOIN e USING (user_id) WHERE (last IS NULL OR poll <= last) AND made < (SELECT max(event_id) // 4 FROM events)
""")
def live_until_stopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls up to the one that ends a live playlist, within a time limit of three quarters of the table."""
    e = table(spark, sf_dir, "events")
    most = e.agg((F.max("event_id") / 4).cast("long").alias("most"))
    polls = e.select("user_id", F.col("event_id").alias("poll"), F.floor(F.col("event_id") / 3).alias("at"), (F.col("event_id") % 17 != 0).alias("is_live"))
    kept = M.until_stopped(polls, "user_id", "poll", "at", "is_live")
    return kept.crossJoin(F.broadcast(most)).filter("at < most").select("user_id", "poll")  # one row
