"""Queries that route records by content type and url."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import jsonx as J
from ..functions import routing as R
from ..sources.tables import table
from ._pairs import Pairs
from .pages import SQL_ENTITIES, SQL_TEXT

PAIRS = Pairs()

TYPES = ["text/html; charset=utf-8", " Application/PDF", "application/octet-stream", "text/csv", "application/xhtml+xml", "image/png"]
URLS = [
    "https://x.com/User{id}/status/{id}?s=20", "https://old.reddit.com/r/spark/comments/{id}/title/", "https://news.ycombinator.com/item?id={id}&p=2#c", "https://github.com/apache/spark/pull/{id}", "https://www.instagram.com/reel/{id}/",
    "https://youtu.be/{id}", "https://fi.wikipedia.org/wiki/Page_{id}#top", "https://stackoverflow.com/questions/{id}/how-to", "https://mastodon.social/@user/{id}", "https://www.linkedin.com/pulse/{id}", "https://stackoverflow.com/questions/tagged/{id}",
    "https://unknown.example/@user/{id}", "http://twitter.com/User{id}/Status/{id}/photo/1", "https://example.com/{id}", "https://netflix.com/status/{id}",
]


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


@PAIRS.add(f"""
WITH r AS (SELECT page_id, html, list_extract({_sql_list(TYPES)}, CAST(page_id % 6 + 1 AS INTEGER)) AS content_type, CASE WHEN page_id % 4 = 0 THEN 'text ' ELSE '' END || html AS body FROM pages),
h AS (SELECT *, CASE WHEN lower(trim(split_part(content_type, ';', 1))) = 'application/pdf' THEN 'pdf' WHEN lower(trim(split_part(content_type, ';', 1))) IN ('text/html', 'application/xhtml+xml') THEN 'html'
 WHEN lower(trim(split_part(content_type, ';', 1))) IN ('text/plain', 'application/json', 'text/csv', 'text/xml', 'application/xml') THEN 'plain' WHEN starts_with(body, '<!') OR starts_with(lower(body), '<html') THEN 'html' ELSE 'plain' END AS handler FROM r)
SELECT page_id, content_type, handler, CASE handler WHEN 'pdf' THEN NULL WHEN 'plain' THEN body ELSE array_to_string(list_filter(list_transform(string_split({SQL_ENTITIES.format(x=SQL_TEXT.format(html="body"))}, chr(10)),
 lambda x: regexp_replace(x, '^[ \\t\\r\\f\\v\\x{{00A0}}]+|[ \\t\\r\\f\\v\\x{{00A0}}]+$', '', 'g')), lambda x: x <> '' AND NOT (NOT contains(x, '](') AND (contains(lower(x), 'skip to content') OR contains(lower(x), 'cookie')
 OR contains(lower(x), 'privacy policy') OR contains(lower(x), 'terms of service') OR starts_with(lower(x), '©') OR starts_with(lower(x), 'copyright') OR (strlen(x) < 3 AND NOT regexp_matches(lower(x), '[\\p{{L}}\\p{{N}}]'))))), chr(10)) END AS markdown FROM h
""")
def content_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each response to its converter. PDF bodies need a library that is not part of the engine and give null."""
    body = F.concat(F.when(F.col("page_id") % 4 == 0, "text ").otherwise(""), F.col("html"))
    df = table(spark, sf_dir, "pages").select("page_id", _pick(TYPES, F.col("page_id")).alias("content_type"), body.alias("body"))
    df = df.withColumn("handler", R.handler(F.col("body"), F.col("content_type")))
    return df.select("page_id", "content_type", "handler", F.when(F.col("handler") == "plain", F.make_valid_utf8(F.col("body"))).when(F.col("handler") == "html", F.array_join(H.page_lines(F.col("body")), "\n")).alias("markdown"))


def _csv_table(bodies: list[str]) -> list[str]:
    rows = [list(csv.reader(io.StringIO(b))) for b in bodies]
    line = lambda r: "| " + " | ".join(r) + " |"
    return ["\n".join([line(r[0]), "|" + " --- |" * len(r[0]), *map(line, r[1:])]) for r in rows]


def _json_outline(bodies: list[str]) -> list[str]:
    return ["\n".join(J.outline(J.parsed(b))) for b in bodies]


OWN = [
    R.Handler("html", ("text/html", "application/xhtml+xml"), column=lambda b, t: F.array_join(H.page_lines(b), "\n")), R.Handler("csv", ("text/csv",), batch=_csv_table), R.Handler("json", ("application/json",), batch=_json_outline),
    R.Handler("title", ("application/x-title",), column=lambda b, t: H.title(b)), R.Handler("plain", ("text/plain",), column=lambda b, t: F.make_valid_utf8(b)),
]
SQL_LINES = f"""array_to_string(list_filter(list_transform(string_split({SQL_ENTITIES.format(x=SQL_TEXT.format(html="html"))}, chr(10)), lambda x: regexp_replace(x, '^[ \\t\\r\\f\\v\\x{{00A0}}]+|[ \\t\\r\\f\\v\\x{{00A0}}]+$', '', 'g')), lambda x: x <> '' AND NOT (NOT contains(x, '](')
 AND (contains(lower(x), 'skip to content') OR contains(lower(x), 'cookie') OR contains(lower(x), 'privacy policy') OR contains(lower(x), 'terms of service') OR starts_with(lower(x), '©') OR starts_with(lower(x), 'copyright') OR (strlen(x) < 3 AND NOT regexp_matches(lower(x), '[\\p{{L}}\\p{{N}}]'))))), chr(10))"""


@PAIRS.add(f"""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'html' WHEN 1 THEN 'csv' WHEN 2 THEN 'json' WHEN 3 THEN 'title' WHEN 4 THEN 'html' END AS handler,
 CASE page_id % 6 WHEN 0 THEN {SQL_LINES} WHEN 1 THEN '| url | size |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || url || ' | ' || length(html) || ' |' WHEN 2 THEN CASE WHEN page_id % 4 = 0 THEN 'size: number' || chr(10) || 'url: string' END
 WHEN 3 THEN CASE WHEN page_id % 9 <> 0 THEN regexp_replace({SQL_ENTITIES.format(x=r"nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '')")}, '^[ \\t]+|[ \\t]+$', '', 'g') END WHEN 4 THEN {SQL_LINES} END AS markdown,
 CASE WHEN page_id % 6 = 2 AND page_id % 4 <> 0 THEN 'JSONDecodeError: Expecting value: line 1 column 9 (char 8)' WHEN page_id % 6 = 3 AND page_id % 9 = 0 THEN 'title: no result' END AS error FROM pages""")
def dispatched_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed bodies to handlers of one's own, some of which fail; a type that no handler names goes by how the body starts, and a null body to none."""
    k, size = F.col("page_id"), F.length("html").cast("string")
    sized = F.when(k % 4 == 0, size).otherwise("")
    body = (
        F.when(k % 6 == 1, F.concat(F.lit("url,size\n"), "url", F.lit(","), size)).when(k % 6 == 2, F.concat(F.lit('{"size":'), sized, F.lit(',"url":"'), "url", F.lit('"}')))
        .when((k % 6 == 3) & (k % 9 == 0), "<p>none</p>").when(k % 6 != 5, F.col("html"))
    )
    kind = F.element_at(F.array(*map(F.lit, ["text/html; charset=utf-8", "text/csv", "application/json", "application/x-title", "application/x-unknown", "text/plain"])), (k % 6 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", R.dispatched(body, kind, OWN).alias("d")).select("page_id", "d.*")


def _has(*xs: str) -> str:
    return "(" + " OR ".join(f"contains(u, '{x}')" for x in xs) + ")"


SQL_SITE = f"""CASE WHEN {_has('x.com/', 'twitter.com/')} AND contains(u, '/status/') THEN 'twitter' WHEN contains(u, 'reddit.com/r/') AND contains(u, '/comments/') THEN 'reddit' WHEN contains(u, 'news.ycombinator.com/item') THEN 'hackernews'
 WHEN contains(u, 'github.com/') AND {_has('/issues/', '/pull/')} THEN 'github' WHEN contains(u, 'instagram.com/') AND {_has('/p/', '/reel/')} THEN 'instagram' WHEN {_has('youtube.com/watch', 'youtu.be/')} THEN 'youtube'
 WHEN contains(u, '.wikipedia.org/wiki/') THEN 'wikipedia' WHEN regexp_matches(u, 'stackoverflow\\.com/questions/[0-9]+(/|$)') THEN 'stackoverflow' WHEN regexp_matches(u, '/@[^/]*/[0-9]+(/|$)') AND {_has(*R.INSTANCES)} THEN 'mastodon'
 WHEN {_has('linkedin.com/posts/', 'linkedin.com/pulse/', 'linkedin.com/feed/update/')} THEN 'linkedin' END"""


@PAIRS.add(f"""
WITH s AS (SELECT page_id, replace(list_extract({_sql_list(URLS)}, CAST(page_id % 15 + 1 AS INTEGER)), '{{id}}', CAST(page_id AS VARCHAR)) AS url FROM pages),
r AS (SELECT page_id, url, {SQL_SITE} AS site, CAST(page_id AS VARCHAR) AS id FROM (SELECT *, lower(split_part(url, '?', 1)) AS u FROM s))
SELECT page_id, url, site, array_to_string(CASE site WHEN 'twitter' THEN CASE WHEN contains(url, '/Status/') THEN ['', ''] WHEN contains(url, 'netflix') THEN ['netflix.com', id] ELSE ['User' || id, id] END WHEN 'reddit' THEN [url || '.json'] WHEN 'hackernews' THEN [id] WHEN 'github' THEN ['apache', 'spark', id]
 WHEN 'wikipedia' THEN ['fi', 'Page_' || id] WHEN 'stackoverflow' THEN [id] WHEN 'mastodon' THEN ['mastodon.social', id] END, ' ') AS ids FROM r
""")
def site_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each url to the first site that fits, and what the url names there."""
    url = F.replace(_pick(URLS, F.col("page_id")), F.lit("{id}"), F.col("page_id").cast("string"))
    df = table(spark, sf_dir, "pages").select("page_id", url.alias("url"))
    return df.select("page_id", "url", R.site(F.col("url")).alias("site"), F.array_join(R.site_ids(F.col("url")), " ").alias("ids"))


HINTS = ["Elisa tunnistus", "DigiD", "login via BankID", "itsme", "Nordea Codes", "OP Avain", "Aktia ID", "use your passkey", "Authenticator app", "SMS with a code", "email with a link", "plain words", "verification"]


@PAIRS.add(f"""
WITH p AS (SELECT page_id, list_extract({_sql_list(HINTS)}, CAST(page_id % 13 + 1 AS INTEGER)) AS hint, CASE WHEN page_id % 11 = 0 THEN 'https://digid.nl/' ELSE 'https://a.example/' END AS url FROM pages),
k AS (SELECT *, CASE WHEN hint = 'Elisa tunnistus' THEN 'mobile_certificate' WHEN hint IN ('DigiD') OR page_id % 11 = 0 THEN 'external_idp' WHEN hint IN ('login via BankID', 'itsme') THEN 'external_idp' WHEN hint IN ('Nordea Codes', 'OP Avain', 'Aktia ID') THEN 'mobile_app_push'
 WHEN hint = 'use your passkey' THEN 'passkey' WHEN hint = 'Authenticator app' THEN 'totp' WHEN hint = 'SMS with a code' THEN 'sms_otp' WHEN hint = 'email with a link' THEN 'email_otp' END AS kind FROM p)
SELECT page_id, hint IN ('Authenticator app', 'verification') AS asks, kind, CASE WHEN kind = 'mobile_certificate' THEN 'Elisa' WHEN kind = 'external_idp' THEN CASE WHEN hint = 'DigiD' OR page_id % 11 = 0 THEN 'DigiD' WHEN hint = 'itsme' THEN 'Itsme' ELSE 'BankID' END
 WHEN hint = 'OP Avain' AND kind = 'mobile_app_push' THEN 'OP Mobile' WHEN kind = 'mobile_app_push' THEN hint END AS detail, coalesce(kind IN ('passkey', 'totp', 'sms_otp', 'email_otp'), false) AS automatable,
 CASE kind WHEN 'mobile_certificate' THEN 'Mobile certificate (Elisa)' WHEN 'external_idp' THEN 'External identity (' || CASE WHEN hint = 'DigiD' OR page_id % 11 = 0 THEN 'DigiD' WHEN hint = 'itsme' THEN 'Itsme' ELSE 'BankID' END || ')' WHEN 'mobile_app_push' THEN 'Mobile app authorization (' || CASE hint WHEN 'OP Avain' THEN 'OP Mobile' ELSE hint END || ')'
 WHEN 'passkey' THEN 'Passkey/WebAuthn' WHEN 'totp' THEN 'Time-based OTP (1Password)' WHEN 'sms_otp' THEN 'SMS verification code' WHEN 'email_otp' THEN 'Email verification code' ELSE 'Unknown 2FA method' END AS description FROM k
""")
def second_factor_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when(F.col("page_id") % 11 == 0, "https://digid.nl/").otherwise("https://a.example/")
    df = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("<p>"), _pick(HINTS, F.col("page_id")), F.lit("</p>")).alias("html"), url.alias("url"))
    df = df.withColumn("k", R.second_factor(F.col("html"), F.col("url")))
    return df.select("page_id", R.asks_second_factor(F.col("html")).alias("asks"), F.col("k.kind").alias("kind"), F.col("k.detail").alias("detail"), F.coalesce(R.is_automatable(F.col("k")), F.lit(False)).alias("automatable"), R.describe_factor(F.col("k")).alias("description"))


@PAIRS.add("""
WITH e AS (SELECT event_id, 'clip' || event_id || list_extract(['.WAV', '.mp3', '.mp4', '.m3u8', '.ogg', ''], CAST(event_id % 6 + 1 AS INTEGER)) AS path, CAST(150 + event_id % 400 AS INTEGER) AS status, event_id % 3 = 0 AS encrypted FROM events)
SELECT event_id, path, regexp_matches(lower(path), '\\.(wav|mp3|flac|m4a|aac|ogg)$') AS audio, status BETWEEN 200 AND 299 AS ok, NOT encrypted AND contains(path, '.m3u8') AS native FROM e
""".replace("\\\\", "\\"))
def media_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("clip"), F.col("event_id").cast("string"), _pick([".WAV", ".mp3", ".mp4", ".m3u8", ".ogg", ""], F.col("event_id")))
    df = table(spark, sf_dir, "events").select("event_id", path.alias("path"), (150 + F.col("event_id") % 400).cast("int").alias("status"), (F.col("event_id") % 3 == 0).alias("encrypted"))
    return df.select("event_id", "path", R.is_audio(F.col("path")).alias("audio"), R.is_success(F.col("status")).alias("ok"), R.plays_natively(F.col("path"), F.col("encrypted")).alias("native"))
