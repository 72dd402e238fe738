"""Queries on recordings: transcripts, speakers and visual events, made from conversations and events."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import intervals as I  # noqa: E741
from ..sources.tables import table
from ._pairs import Pairs

PAIRS = Pairs()

# The stand-in rows, in SQL that Spark and DuckDB read alike.
SEGMENT = "conv_id, turn AS pos, turn * 5.0D AS l_start, turn * 5.0D + 0.3D * (char_length(text) % 19) AS l_end"
SPEAKER = "conv_id, turn AS r_pos, role AS speaker, turn * 4.0D - 0.3D AS r_start, turn * 4.0D + 4.6D AS r_end"
POINT = "user_id AS conv_id, event_id AS r_pos, event_type AS action, (event_id % 97) * 0.37D AS r_start"
FUSED = """conv_id, turn AS pos, turn * 5.0D AS start, turn * 5.0D + 0.3D * (char_length(text) % 19) AS `end`,
 CASE WHEN turn % 7 = 3 THEN NULL WHEN turn % 4 < 2 THEN 'A' ELSE 'B' END AS speaker,
 CASE WHEN turn % 5 = 4 THEN NULL WHEN turn % 6 = 1 THEN concat(text, ' Never') ELSE text END AS transcript,
 CASE (conv_id + turn DIV 2) % 4 WHEN 0 THEN 'happy' WHEN 1 THEN 'sad' WHEN 2 THEN 'neutral' END AS emotion,
 ((conv_id * 7 + turn) % 100) / 100.0D AS confidence, CASE turn % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'walks' WHEN 2 THEN 'none' END AS action"""


def doubles(sql: str) -> str:
    """DuckDB reads 5.0 as a decimal; the stand-ins are doubles."""
    return re.sub(r"(\d+\.\d+)D", r"CAST(\1 AS DOUBLE)", sql).replace("`end`", '"end"').replace("DIV", "//").replace("substr(", "substring(").replace("char_length(", "length(")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(*_split(SEGMENT))


def _split(sql: str) -> list[str]:
    """Top-level commas."""
    out, depth, cur = [], 0, ""
    for c in sql:
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += c
    return [*out, cur]


def speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(*_split(SPEAKER))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_split(POINT))


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With flags: a cheerful face over negative words."""
    df = table(spark, sf_dir, "conversations").selectExpr(*_split(FUSED))
    # Negative words, as parts of words.
    negative = F.exists(X.words(F.lower("transcript")), lambda w: w.rlike("not|never|hate|terrible"))
    flag = F.coalesce(negative & (F.col("emotion") == "happy"), F.lit(False))
    return df.withColumn("flags", F.when(flag, F.array(F.lit("sentiment_mismatch"))).otherwise(F.array().cast("array<string>")))


SQL_BASE = f"""
WITH seg AS (SELECT {doubles(SEGMENT)} FROM conversations), spk AS (SELECT {doubles(SPEAKER)} FROM conversations), pt AS (SELECT {doubles(POINT)} FROM events),
fused0 AS (SELECT {doubles(FUSED)} FROM conversations),
fused AS (SELECT *, CASE WHEN emotion = 'happy' AND regexp_matches(lower(transcript), 'not|never|hate|terrible') THEN ['sentiment_mismatch'] ELSE CAST([] AS VARCHAR[]) END AS flags FROM fused0)
"""


@PAIRS.add(SQL_BASE + """, p AS (SELECT seg.conv_id, seg.pos, speaker, r_pos, least(l_end, r_end) - greatest(l_start, r_start) AS o FROM seg JOIN spk ON seg.conv_id = spk.conv_id AND r_start < l_end AND r_end > l_start),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, pos ORDER BY o DESC, r_pos) AS n FROM p WHERE o > 0)
SELECT seg.conv_id, seg.pos, l_start, l_end, speaker, o AS overlap FROM seg LEFT JOIN b ON seg.conv_id = b.conv_id AND seg.pos = b.pos AND n = 1
""")
def speaker_by_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.most_overlap(segments(spark, sf_dir), speakers(spark, sf_dir), "conv_id", "pos", "speaker").select("conv_id", "pos", "l_start", "l_end", "speaker", "overlap")


@PAIRS.add(SQL_BASE + """, b AS (SELECT seg.conv_id, seg.pos, speaker, row_number() OVER (PARTITION BY seg.conv_id, seg.pos ORDER BY r_pos) AS n FROM seg JOIN spk ON seg.conv_id = spk.conv_id AND r_start <= l_start AND r_end >= l_end)
SELECT seg.conv_id, seg.pos, speaker FROM seg LEFT JOIN b ON seg.conv_id = b.conv_id AND seg.pos = b.pos AND n = 1
""")
def speaker_by_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.first_container(segments(spark, sf_dir), speakers(spark, sf_dir), "conv_id", "pos", "speaker").select("conv_id", "pos", "speaker")


@PAIRS.add(SQL_BASE + """, b AS (SELECT seg.conv_id, seg.pos, action, row_number() OVER (PARTITION BY seg.conv_id, seg.pos ORDER BY abs(r_start - (l_start + l_end) / 2), r_pos) AS n FROM seg JOIN pt ON seg.conv_id = pt.conv_id AND r_start BETWEEN l_start - 0.5 AND l_end + 0.5)
SELECT seg.conv_id, seg.pos, action FROM seg LEFT JOIN b ON seg.conv_id = b.conv_id AND seg.pos = b.pos AND n = 1
""")
def action_near_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.nearest_point(segments(spark, sf_dir), points(spark, sf_dir), "conv_id", "pos", "action").select("conv_id", "pos", "action")


@PAIRS.add(SQL_BASE + """, pp AS (SELECT conv_id, r_start, arg_max(action, r_pos) AS last_a, arg_min(action, r_pos) AS first_a FROM pt GROUP BY ALL),
b AS (SELECT seg.conv_id, pos, l_start, pp.r_start AS bt, last_a FROM seg ASOF LEFT JOIN pp ON seg.conv_id = pp.conv_id AND seg.l_start >= pp.r_start),
a AS (SELECT b.*, pp.r_start AS a_t, first_a FROM b ASOF LEFT JOIN pp ON b.conv_id = pp.conv_id AND b.l_start < pp.r_start)
SELECT conv_id, pos, CASE WHEN bt IS NULL THEN first_a WHEN a_t IS NULL OR l_start - bt <= a_t - l_start THEN last_a ELSE first_a END AS action FROM a
""")
def action_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.nearest_asof(segments(spark, sf_dir), points(spark, sf_dir), "conv_id", "pos", "action").select("conv_id", "pos", "action")


@PAIRS.add(SQL_BASE + """, s AS (SELECT conv_id, r_pos, CASE WHEN r_pos // 2 % 2 = 0 THEN 'A' ELSE 'B' END AS speaker, r_start, r_start + 3.4 + (r_pos % 5) / 4.0 AS e FROM spk),
f AS (SELECT *, CASE WHEN lag(speaker) OVER w <> speaker OR r_start - lag(e) OVER w > 0.5 THEN 1 ELSE 0 END AS brk FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY r_pos)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY conv_id ORDER BY r_pos) AS island FROM f)
SELECT conv_id, CAST(island AS BIGINT) AS island, min(speaker) AS speaker, arg_min(r_start, r_pos) AS start, arg_max(e, r_pos) AS "end", count(*) AS n FROM i GROUP BY conv_id, island
""")
def merged_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = F.when(F.floor(F.col("r_pos") / 2) % 2 == 0, "A").otherwise("B")
    df = speakers(spark, sf_dir).select("conv_id", F.col("r_pos").alias("pos"), who.alias("speaker"), F.col("r_start").alias("start"), (F.col("r_start") + 3.4 + (F.col("r_pos") % 5) / 4.0).alias("end"))
    return I.merge_adjacent(df, "conv_id", 0.5)


@PAIRS.add(SQL_BASE + """, f AS (SELECT *, CASE WHEN lag(pos) OVER w IS NULL THEN 0 WHEN lag(speaker) OVER w IS NOT DISTINCT FROM speaker AND lag(emotion) OVER w IS NOT DISTINCT FROM emotion AND start - lag("end") OVER w <= 2.0 THEN 0 ELSE 1 END AS brk FROM fused WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY conv_id ORDER BY pos) AS island FROM f)
SELECT conv_id, CAST(island AS BIGINT) AS island, any_value(speaker) AS speaker, any_value(emotion) AS emotion, min(start) AS start, arg_max("end", pos) AS "end",
 CASE WHEN bool_or(transcript IS NOT NULL AND pos = p0) THEN string_agg(transcript, ' ' ORDER BY pos) END AS transcript, array_to_string(flatten(list(flags ORDER BY pos)), ',') AS flags
FROM (SELECT *, min(pos) OVER (PARTITION BY conv_id, island) AS p0 FROM i) GROUP BY conv_id, island
""")
def merged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.merge_fused(fused(spark, sf_dir), "conv_id", 2.0).withColumn("flags", F.array_join("flags", ","))


@PAIRS.add(SQL_BASE + """, d AS (SELECT conv_id, r_pos AS pos, CASE WHEN r_pos % 3 = 0 THEN 'A' ELSE 'B' END AS speaker, r_pos * 1000 AS s, r_pos * 1000 + (r_pos * 377) % 1500 AS e FROM spk),
r AS (SELECT *, sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) AS run FROM (SELECT *, lag(speaker) OVER (PARTITION BY conv_id ORDER BY pos) <> speaker AS b FROM d)),
m AS (SELECT *, max(e) OVER (PARTITION BY conv_id, run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM r),
i AS (SELECT *, sum(CASE WHEN s > upto + 500 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, run ORDER BY pos) AS island FROM m)
SELECT conv_id, min(speaker) AS speaker, arg_min(s, pos) AS start_ms, max(e) AS end_ms FROM i GROUP BY conv_id, run, island HAVING max(e) - arg_min(s, pos) >= 500
""")
def speaker_label_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.col("r_pos")
    df = speakers(spark, sf_dir).select("conv_id", pos.alias("pos"), F.when(pos % 3 == 0, "A").otherwise("B").alias("speaker"), (pos * 1000).alias("start_ms"), (pos * 1000 + (pos * 377) % 1500).alias("end_ms"))
    return I.speaker_labels(df, "conv_id")


@PAIRS.add(SQL_BASE + """, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY r_pos) - 1 AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM pt)
SELECT conv_id, r_pos, action, CAST(p AS DOUBLE) / 30.0 AS estimate FROM n WHERE p % (CASE WHEN n > 8 THEN n // 8 ELSE 1 END) = 0 AND p // (CASE WHEN n > 8 THEN n // 8 ELSE 1 END) < 8
""")
def sampled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most eight points of each recording, and where they would stand at 30 frames a second."""
    df = points(spark, sf_dir).withColumn("estimate", (F.row_number().over(Window.partitionBy("conv_id").orderBy("r_pos")) - 1) / 30.0)
    return I.evenly(df, "conv_id", "r_pos", 8).select("conv_id", "r_pos", "action", "estimate")


@PAIRS.add(SQL_BASE + """SELECT conv_id, pos, what, t, row_number() OVER (PARTITION BY conv_id ORDER BY t, what, pos) AS n FROM (
 SELECT conv_id, pos, 'segment_start' AS what, l_start AS t FROM seg UNION ALL SELECT conv_id, pos, 'segment_end', l_end FROM seg UNION ALL SELECT conv_id, r_pos, 'speaker_start', r_start FROM spk UNION ALL SELECT conv_id, r_pos, 'speaker_end', r_end FROM spk)
""")
def boundary_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep line: starts and ends of segments and speakers in order of time."""
    s, k = segments(spark, sf_dir), speakers(spark, sf_dir).withColumnRenamed("r_pos", "pos")
    rows = [(s, "segment_start", "l_start"), (s, "segment_end", "l_end"), (k, "speaker_start", "r_start"), (k, "speaker_end", "r_end")]
    every = None
    for df, what, at in rows:
        part = df.select("conv_id", "pos", F.lit(what).alias("what"), F.col(at).alias("t"))
        every = part if every is None else every.unionByName(part)
    return every.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("t", "what", "pos")))


SQL_WORDS = r"len(list_filter(regexp_split_to_array({x}, '[ \t\n\r\f\v]+'), lambda x: x <> ''))"


@PAIRS.add(SQL_BASE + f"""SELECT coalesce(speaker, 'Unknown') AS speaker, round(sum("end" - start), 6) AS total_time, count(*) AS segment_count, CAST(coalesce(sum({SQL_WORDS.format(x="transcript")}), 0) AS BIGINT) AS word_count, CAST(NULL AS VARCHAR) AS dominant_emotion FROM fused GROUP BY 1""")
def speaker_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fused(spark, sf_dir)
    n = F.when(F.col("transcript").isNotNull(), F.size(X.words(F.col("transcript"))))
    return df.groupBy(F.coalesce("speaker", F.lit("Unknown")).alias("speaker")).agg(F.round(F.sum(F.col("end") - F.col("start")), 6).alias("total_time"), F.count("*").alias("segment_count"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("word_count"), F.lit(None).cast("string").alias("dominant_emotion"))


@PAIRS.add(SQL_BASE + """SELECT emotion, count(*) AS n, count(*) * 100.0 / (SELECT count(*) FROM fused) AS pct, (SELECT count(*) FROM fused) AS total, (SELECT count(DISTINCT speaker) FROM fused) AS speakers FROM fused WHERE emotion IS NOT NULL GROUP BY emotion""")
def emotion_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fused(spark, sf_dir)
    total = df.agg(F.count("*").alias("total"), F.countDistinct("speaker").alias("speakers"))
    counts = df.filter("emotion is not null").groupBy("emotion").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(total)).select("emotion", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"), "total", "speakers")  # one row of totals


@PAIRS.add(SQL_BASE + """SELECT conv_id, pos, start, "end", flags[1] AS flag FROM fused WHERE len(flags) > 0""")
def flagged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir).filter(F.size("flags") > 0).select("conv_id", "pos", "start", "end", F.get("flags", F.lit(0)).alias("flag"))


@PAIRS.add("SELECT event_type, round(avg(value), 6) AS avg_ms, min(value) AS min_ms, max(value) AS max_ms, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS ok FROM events GROUP BY event_type")
def timing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average, least and greatest time of each target, and how many calls went well."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("avg_ms"), F.min("value").alias("min_ms"), F.max("value").alias("max_ms"), F.count("*").alias("n"), F.count_if(F.col("event_type") != "error").alias("ok"))
