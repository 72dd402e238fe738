"""Queries on streaming services, over urls and captured records made from suppliers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import streams as S
from ..sources.tables import table
from ._pairs import Pairs

PAIRS = Pairs()

URLS = [
    ("https://areena.yle.fi/1-{k}?autoplay=true", "yle", "1-{k}", "1-{k}"), ("https://tv.nrk.no/program/KO{k}?x=1", "nrk", "KO{k}", "KO{k}"), ("https://tv.nrk.no/serie/dag/sesong/2/episode/{k}?a", "nrk", "dag/s2/e{k}", "dag"), ("https://tv.nrk.no/serie/dag/episode/", "nrk", None, "dag"),
    ("https://www.svtplay.se/video/{k}/title?id=1", "svt", "{k}", "title"), ("https://www.dr.dk/drtv/serie/show_{k}", "dr", "{k}", "show_{k}"), ("https://cdn.example/{k}.m3u8", "generic", None, None), ("https://www.twitch.tv/{k}", None, None, None),
]


def _sql(i: int) -> str:
    return "list_extract([" + ", ".join("NULL" if u[i] is None else f"'{u[i]}'" for u in URLS) + "], CAST(s_suppkey % 8 + 1 AS INTEGER))"


@PAIRS.add(f"""WITH u AS (SELECT s_suppkey, {_sql(0)} AS u, {_sql(1)} AS s, {_sql(2)} AS p, {_sql(3)} AS x, s_suppkey % 8 AS i FROM supplier)
SELECT s_suppkey, s AS service, replace(p, '{{k}}', CAST(s_suppkey AS VARCHAR)) AS program, replace(x, '{{k}}', CAST(s_suppkey AS VARCHAR)) AS series, i IN (1, 2, 3, 4, 5, 7) AS tool_reads, CASE WHEN i = 0 THEN 'yle' ELSE 'generic' END AS provider, CASE i % 4 WHEN 1 THEN 'worst' WHEN 2 THEN 'height' ELSE 'best' END AS quality, CASE WHEN i % 4 = 2 THEN 720 END AS height FROM u""")
def stream_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The service of each url, what it names there, and how it would be read."""
    k = F.col("s_suppkey")
    url = F.replace(F.element_at(F.array(*[F.lit(u[0]) for u in URLS]), (k % 8 + 1).cast("int")), F.lit("{k}"), k.cast("string"))
    df = table(spark, sf_dir, "supplier").select("s_suppkey", url.alias("u"), F.element_at(F.array(*map(F.lit, ["Best", "WORST", "720", "nonsense"])), (k % 4 + 1).cast("int")).alias("q"))
    name, ids, series = S.service(F.col("u")), None, None
    for s in S.SERVICES:
        ids = F.when(name == s, S.program_id(s, F.col("u"))) if ids is None else ids.when(name == s, S.program_id(s, F.col("u")))
        series = F.when(name == s, S.series_id(s, F.col("u"))) if series is None else series.when(name == s, S.series_id(s, F.col("u")))
    q = S.quality(F.col("q"))
    return df.select("s_suppkey", name.alias("service"), ids.alias("program"), series.alias("series"), S.tool_reads(F.col("u")).alias("tool_reads"), S.provider(F.col("u"), F.lit("x")).alias("provider"), q["kind"].alias("quality"), q["height"].alias("height"))


@PAIRS.add("""SELECT s_suppkey, 'nrk' AS service, 'n' || i AS id, 'T' || i AS title, CAST(i // 2 + 1 AS INTEGER) AS season, CAST(i AS INTEGER) AS episode, CAST(s_suppkey * 60 + 5 AS BIGINT) AS seconds FROM (SELECT s_suppkey, unnest([0, 1, 2, 3]) AS i FROM supplier)
 UNION ALL SELECT s_suppkey, 'svt', CASE WHEN i = 0 THEN 'v0' ELSE 'i' || i END, 'T' || i, 1, i, s_suppkey FROM (SELECT s_suppkey, unnest([0, 1]) AS i FROM supplier)
 UNION ALL SELECT s_suppkey, 'dr', 'p' || s_suppkey, 'T', NULL, 7, 1000000 + s_suppkey FROM supplier""")
def series_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasons and groups of captured series records as rows."""
    k = F.col("s_suppkey").cast("string")
    nrk = F.concat(F.lit('{"seasons":[{"seasonNumber":1,"episodes":[{"id":"n0","title":"T0","episodeNumber":0,"duration":"PT'), k, F.lit('M5S"},{"id":"n1","title":"T1","episodeNumber":1,"duration":"PT'), k, F.lit('M5S"}]},{"seasonNumber":3},{"seasonNumber":2,"episodes":[{"id":"n2","title":"T2","episodeNumber":2,"duration":"PT'), k, F.lit('M5S"},{"id":"n3","title":"T3","episodeNumber":3,"duration":"PT'), k, F.lit('M5S"}]}]}'))
    svt = F.concat(F.lit('{"associatedContent":[{"items":[{"item":{"id":"i0","videoSvtId":"v0","name":"T0","positionInSeason":0,"season":1,"duration":'), k, F.lit('}},{"item":null}]},{},{"items":[{"item":{"id":"i1","name":"T1","positionInSeason":1,"season":1,"duration":'), k, F.lit("}}]}]}"))
    dr = F.concat(F.lit('{"episodes":[{"productNumber":"p'), k, F.lit('","title":"T","episodeNumber":7,"durationInMilliseconds":1'), F.lpad(k, 6, "0"), F.lit("999}]}"))
    df = table(spark, sf_dir, "supplier").select("s_suppkey", nrk.alias("nrk"), svt.alias("svt"), dr.alias("dr"))
    parts = [df.select("s_suppkey", F.lit(n).alias("service"), F.explode(S.episodes(n, F.col(n))).alias("e")).select("s_suppkey", "service", "e.*") for n in ("nrk", "svt", "dr")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@PAIRS.add("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN NULL ELSE 'h' || s_suppkey END AS manifest, CASE WHEN s_suppkey % 2 = 0 THEN 'wide' ELSE 'first' END AS picture, CASE s_suppkey % 4 WHEN 0 THEN NULL ELSE 'c' || s_suppkey % 4 END AS title, CASE s_suppkey % 3 WHEN 0 THEN 'b' ELSE 'a' END AS cards FROM supplier""")
def stream_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First fitting manifest, picture, title and list."""
    k = F.col("s_suppkey")
    asset = lambda f, u: F.struct(F.lit(f).alias("format"), u.alias("url"))
    assets = F.when(k % 3 == 0, F.array(asset("DASH", F.lit("d")))).otherwise(F.array(asset("DASH", F.lit("d")), asset("HLS", F.concat(F.lit("h"), k.cast("string"))), asset("HLS", F.lit("later"))))
    images = F.array(F.struct(F.lit(480).alias("width"), F.lit("first").alias("url")), F.struct((F.when(k % 2 == 0, 960).otherwise(900)).alias("width"), F.lit("wide").alias("url")))
    titles = [F.when(k % 4 == i, f"c{i}") for i in (1, 2, 3)]
    cards = S.first_filled(F.when(k % 3 != 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")), F.array(F.lit("b")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", S.manifest(assets, ["HLS"]).alias("manifest"), S.picture(images).alias("picture"), F.coalesce(*titles).alias("title"), F.get(cards, F.lit(0)).alias("cards"))


OWN_SERVICES = [S.Service("magazine", lambda u: F.contains(u, F.lit("//blog.")), lambda u: F.regexp_extract(u, r"/([0-9]+)[^0-9]*$", 1)), S.Service("dr", lambda u: F.contains(u, F.lit("/drtv/live/")))]
OWN_BACKENDS = [S.Backend("pages", lambda u, e: F.endswith(u, F.lit(".html")))]


@PAIRS.add(r"""WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, page_id % 7 AS k, CASE page_id % 7 WHEN 0 THEN 'https://tv.nrk.no/program/' || page_id || '?from=' || url WHEN 1 THEN url || '/live.m3u8' WHEN 2 THEN 'https://www.dr.dk/drtv/live/' || page_id WHEN 3 THEN NULL ELSE url END AS u, page_id % 2 = 0 AS enc FROM pages)
SELECT page_id, u AS url, CASE WHEN k = 3 THEN NULL WHEN contains(u, '//blog.') THEN 'magazine' WHEN k = 2 THEN 'dr' WHEN k = 0 THEN 'nrk' WHEN k = 1 THEN 'generic' END AS service,
 CASE WHEN k = 3 THEN NULL WHEN contains(u, '//blog.') THEN regexp_extract(u, '/([0-9]+)[^0-9]*$', 1) WHEN k = 0 THEN CAST(page_id AS VARCHAR) END AS program, CASE WHEN k = 0 AND NOT contains(u, '//blog.') THEN regexp_extract(regexp_replace(u, '(/\?[^/]*|/)+$', ''), '([^/?]*)(?:\?[^/]*)?$', 1) END AS series,
 CASE WHEN k = 3 THEN NULL WHEN ends_with(u, '.html') THEN 'pages' WHEN NOT enc AND contains(u, '.m3u8') THEN 'native' WHEN k IN (0, 2) THEN 'streamlink' ELSE 'ffmpeg' END AS backend FROM u""".replace("\\", "\\"))
def routed_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' urls, some as a service's, to services and backends of one's own and built in."""
    k = F.col("page_id")
    i = k.cast("string")
    url = F.when(k % 7 == 0, F.concat(F.lit("https://tv.nrk.no/program/"), i, F.lit("?from="), "url")).when(k % 7 == 1, F.concat("url", F.lit("/live.m3u8"))).when(k % 7 == 2, F.concat(F.lit("https://www.dr.dk/drtv/live/"), i)).when(k % 7 != 3, F.col("url"))
    df = table(spark, sf_dir, "pages").select("page_id", url.alias("url"))
    return df.select("page_id", "url", S.routed(F.col("url"), k % 2 == 0, OWN_SERVICES, OWN_BACKENDS).alias("r")).select("page_id", "url", "r.*")
