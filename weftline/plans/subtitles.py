"""Subtitle files, styles and reports of recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import subtitles as S
from ..sources.tables import table
from ._pairs import Pairs
from .text import SQL_ASS, SQL_SRT
from .timeline import SQL_BASE, fused

PAIRS = Pairs()

SQL_ENTRIES = r"""e AS (SELECT conv_id, turn AS pos, turn * 5000 + 12 AS s, turn * 5000 + 4321 AS t, CASE WHEN turn % 3 <> 0 THEN role END AS speaker, regexp_replace(text, '\n\s*', chr(10), 'g') || '{x}' AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE trim(regexp_replace(text, '\s', '', 'g')) <> '')"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, entries): a recording's rows, in order, in one array: as many as it has turns."""
    text = F.concat(F.regexp_replace("text", r"\n\s*", "\n"), F.lit("{x}"))
    df = table(spark, sf_dir, "conversations").filter(F.regexp_replace("text", r"\s", "") != "")
    rows = df.select("conv_id", F.struct(F.col("turn").alias("pos"), (F.col("turn") * 5000 + 12).alias("start_ms"), (F.col("turn") * 5000 + 4321).alias("end_ms"), text.alias("text"), F.when(F.col("turn") % 3 != 0, F.col("role")).alias("speaker"), F.lit(None).cast("string").alias("style")).alias("e"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("e")).alias("entries"))


@PAIRS.add(f"""WITH {SQL_ENTRIES} SELECT conv_id, string_agg(n || chr(10) || {SQL_SRT.format(m='s', mark=',')} || ' --> ' || {SQL_SRT.format(m='t', mark=',')} || chr(10) || coalesce('[' || speaker || '] ', '') || text || chr(10) || chr(10), '' ORDER BY pos) AS srt,
 'WEBVTT' || chr(10) || chr(10) || string_agg(n || chr(10) || {SQL_SRT.format(m='s', mark='.')} || ' --> ' || {SQL_SRT.format(m='t', mark='.')} || chr(10) || coalesce('<v ' || speaker || '>', '') || text || chr(10) || chr(10), '' ORDER BY pos) AS vtt,
 string_agg(coalesce(speaker, 'Speaker') || ': ' || text || chr(10), '' ORDER BY pos) AS transcript FROM e GROUP BY conv_id""")
def subtitle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("entries")
    return entries(spark, sf_dir).select("conv_id", S.srt(e).alias("srt"), S.vtt(e).alias("vtt"), S.transcript(e).alias("transcript"))


@PAIRS.add(f"""WITH {SQL_ENTRIES} SELECT conv_id, CAST(n - 1 AS INTEGER) AS n, CAST(s AS BIGINT) AS start_ms, CAST(t AS BIGINT) AS end_ms, regexp_replace(coalesce('[' || speaker || '] ', '') || text, '^\\s+|\\s+$', '', 'g') AS text FROM e""")
def parsed_subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written and read again: the same entries."""
    df = entries(spark, sf_dir).select("conv_id", F.posexplode(S.parse_srt(S.srt(F.col("entries")))).alias("n", "e"))
    return df.select("conv_id", "n", "e.start_ms", "e.end_ms", F.regexp_replace("e.text", r"^\s+|\s+$", "").alias("text"))



def _style() -> Column:
    return F.struct(F.lit("Main").alias("name"), F.lit("Arial").alias("font"), F.lit(48).alias("size"), F.lit("FFAA00").alias("color"), F.lit("102030").alias("outline_color"), F.lit("000000").alias("back_color"), F.lit(0.5).alias("back_opacity"), F.lit(True).alias("bold"), F.lit(False).alias("italic"), F.lit(2).alias("outline"), F.lit(0).alias("shadow"), F.lit("bottom_center").alias("position"))
SQL_HEADER = f"'[Script Info]' || chr(10) || 'Title: Talk ' || conv_id || chr(10) || 'ScriptType: v4.00+' || chr(10) || 'PlayResX: 1920' || chr(10) || 'PlayResY: 1080' || chr(10) || 'ScaledBorderAndShadow: yes' || chr(10) || 'YCbCr Matrix: TV.709' || chr(10) || chr(10) || '[V4+ Styles]' || chr(10) || '{S.STYLE_FORMAT}' || chr(10) || 'Style: Main,Arial,48,&H0000AAFF,&H000000FF,&H00302010,&H7F000000,-1,0,0,0,100,100,0,0,1,2,0,2,20,20,20,0' || chr(10) || chr(10) || '[Events]' || chr(10) || '{S.EVENT_FORMAT}' || chr(10)"


@PAIRS.add(f"""WITH {SQL_ENTRIES} SELECT conv_id, {SQL_HEADER} || string_agg('Dialogue: 0,' || {SQL_ASS.format(m='s')} || ',' || {SQL_ASS.format(m='t')} || ',Default,' || coalesce(speaker, '') || ',0,0,0,,' || replace(replace(replace(replace(text, '\\', '\\\\'), '{{', '\\{{'), '}}', '\\}}'), chr(10), '\\N') || chr(10), '' ORDER BY pos) AS ass FROM e GROUP BY conv_id""")
def ass_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.lit("Talk "), F.col("conv_id").cast("string"))
    return entries(spark, sf_dir).select("conv_id", F.concat(S.ass_header(title, F.array(S.style_line(_style()))), S.dialogue(F.col("entries"))).alias("ass"))


PLACES = list(S.ALIGNMENT)[:9]


@PAIRS.add("""WITH p AS (SELECT s_suppkey, s_suppkey % 9 AS i, (s_suppkey % 11) / 10.0 AS o, s_suppkey % 3 AS w, upper(lpad(to_hex(s_suppkey * 7919 % 16777216), 6, '0')) AS c FROM supplier),
q AS (SELECT *, CASE i % 3 WHEN 0 THEN '20' WHEN 1 THEN '(w-text_w)/2' ELSE 'w-text_w-20' END AS x, CASE i // 3 WHEN 0 THEN 'h-text_h-20' WHEN 1 THEN '(h-text_h)/2' ELSE '20' END AS y FROM p)
SELECT s_suppkey, CAST(i + 1 AS INTEGER) AS alignment, '&H' || upper(lpad(to_hex(CAST(trunc((1.0 - CAST(o AS DOUBLE)) * 255) AS BIGINT)), 2, '0')) || c[5:6] || c[3:4] || c[1:2] AS colour,
 'fontfile=/System/Library/Fonts/Arial.ttf:fontsize=48:fontcolor=0x' || c || ':x=' || x || ':y=' || y || CASE WHEN w > 0 THEN ':borderw=' || w || ':bordercolor=0x' || c ELSE '' END || CASE WHEN o > 0 THEN ':box=1:boxcolor=0x' || c || '@' || CAST(CAST(o AS DOUBLE) AS VARCHAR) || ':boxborderw=5' ELSE '' END AS params FROM q""")
def overlay_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    c = F.lpad(F.hex(k * 7919 % 16777216), 6, "0")
    place = F.element_at(F.array(*map(F.lit, PLACES)), (k % 9 + 1).cast("int"))
    s = F.struct(F.lit("Arial").alias("font"), F.lit(48).alias("size"), c.alias("color"), c.alias("outline_color"), c.alias("back_color"), ((k % 11) / 10.0).alias("back_opacity"), (k % 3).alias("outline"), F.lit(0).alias("shadow"), place.alias("position"))
    df = table(spark, sf_dir, "supplier").select("s_suppkey", s.alias("s"))
    return df.select("s_suppkey", S.alignment(F.col("s.position")).alias("alignment"), S.colour(F.col("s.color"), S.alpha(F.col("s.back_opacity"))).alias("colour"), S.draw_params(F.col("s")).alias("params"))


@PAIRS.add(SQL_BASE + """, c AS (SELECT conv_id, count(*) AS n, count(DISTINCT speaker) AS who FROM fused GROUP BY 1),
em AS (SELECT conv_id, emotion, count(*) AS k FROM fused WHERE emotion IS NOT NULL GROUP BY ALL),
es AS (SELECT em.conv_id, string_agg('- **' || emotion || '**: ' || k || ' (' || printf('%.1f', k / c.n * 100.0) || '%)' || chr(10), '' ORDER BY k DESC, emotion) AS x FROM em JOIN c USING (conv_id) GROUP BY em.conv_id),
fl AS (SELECT conv_id, string_agg('- **' || printf('%.1f', start) || 's-' || printf('%.1f', "end") || 's**: ["' || flags[1] || '"]' || chr(10), '' ORDER BY pos) AS x FROM fused WHERE len(flags) > 0 GROUP BY conv_id),
tr AS (SELECT conv_id, string_agg('**[' || printf('%.1f', start) || 's - ' || printf('%.1f', "end") || 's]** ' || coalesce(speaker, 'Unknown') || CASE WHEN emotion IS NULL THEN '' ELSE ' (' || emotion || ' ' || printf('%.0f', confidence * 100.0) || '%)' END
 || CASE WHEN action = 'walks' THEN ' [walks]' ELSE '' END || chr(10) || '> ' || coalesce(transcript, '') || chr(10) || chr(10), '' ORDER BY pos) AS x FROM fused GROUP BY conv_id)
SELECT c.conv_id, '# Video Analysis Report' || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10) || '- **Total Segments**: ' || n || chr(10) || '- **Unique Speakers**: ' || who || chr(10) || coalesce(chr(10) || '### Emotion Distribution' || chr(10) || chr(10) || es.x, '')
 || coalesce(chr(10) || '### Flagged Segments' || chr(10) || chr(10) || fl.x, '') || chr(10) || '## Transcript' || chr(10) || chr(10) || tr.x AS report FROM c JOIN tr USING (conv_id) LEFT JOIN es USING (conv_id) LEFT JOIN fl USING (conv_id)""")
def analysis_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fused(spark, sf_dir).select("conv_id", F.struct("pos", "start", "end", "speaker", "transcript", "emotion", "confidence", "action", "flags").alias("s"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("s")).select("conv_id", S.report(F.col("s")).alias("report"))


@PAIRS.add("""SELECT conv_id, what, s AS start_ms, t AS end_ms, row_number() OVER (PARTITION BY conv_id ORDER BY s, what, turn) AS n FROM (SELECT conv_id, turn, '1 subtitle' AS what, turn * 5000 AS s, turn * 5000 + 4000 AS t FROM conversations
 UNION ALL SELECT conv_id, turn, '2 label', turn * 4000, turn * 4000 + 900 FROM conversations WHERE role <> 'system')""")
def combined_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtitles and labels in one track, by their starts."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations")
    track = lambda df, what, step, size: df.select("conv_id", "turn", F.lit(what).alias("what"), (F.col("turn") * step).alias("start_ms"), (F.col("turn") * step + size).alias("end_ms"))
    both = track(c, "1 subtitle", 5000, 4000).unionByName(track(c.filter("role <> 'system'"), "2 label", 4000, 900))
    return both.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("start_ms", "what", "turn"))).drop("turn")
