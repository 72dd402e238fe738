"""Streaming services: whose url it is, what it names, and captured records (JSON) as streams and episodes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import times as T

# Parts of urls by service, in the order in which they are asked; endings of plain manifests; hosts that an external tool reads.
SERVICES = {"yle": ["areena.yle.fi", "arenan.yle.fi"], "nrk": ["tv.nrk.no", "nrk.no/tv", "radio.nrk.no"], "svt": ["svtplay.se", "svt.se/play"], "dr": ["dr.dk/drtv", "dr.dk/tv"]}
MANIFEST_ENDS = [".m3u8", ".mpd"]
TOOL_HOSTS = [
    "youtube.com", "youtu.be", "twitch.tv", "dailymotion.com", "vimeo.com", "facebook.com", "mixer.com", "crunchyroll.com", "mlg.com", "livestream.com", "ustream.tv", "afreeca.com",
    "bilibili.com", "huya.com", "douyu.com", "nimo.tv", "picarto.tv", "pluto.tv", "tv.se", "svtplay.se", "tv4play.se", "ruv.is", "dr.dk", "nrk.no",
]


def _any(url: Column, parts: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(url, p))


def _ends(url: Column) -> Column:
    return F.endswith(url, F.lit(MANIFEST_ENDS[0])) | F.endswith(url, F.lit(MANIFEST_ENDS[1]))


def service(url: Column) -> Column:
    out = None
    for name, parts in SERVICES.items():
        out = F.when(_any(url, parts), name) if out is None else out.when(_any(url, parts), name)
    return out.when(_ends(url), "generic")


def tool_reads(url: Column) -> Column:
    return _any(url, TOOL_HOSTS)


def provider(source: Column, name: Column) -> Column:
    """The provider that a source and an id choose; null where they choose none."""
    s = F.lower(source)
    own = _any(s, SERVICES["yle"])
    by_id = F.when(F.contains(name, F.lit("areena.yle.fi")) | F.startswith(name, F.lit("1-")), "yle").when(_ends(name), "generic")
    return F.when(s == "yle", "yle").when(s.isin("generic", "hls", "dash"), "generic").when(F.startswith(s, F.lit("http")), F.when(own, "yle").otherwise("generic")).otherwise(by_id)


def quality(text: Column) -> Column:
    """(kind, height): ``best``, ``worst`` or a height; anything else is best."""
    low = F.lower(text)
    height = F.when(low.rlike(r"^\d{1,9}$"), low.cast("int"))
    return F.struct(F.when(low == "worst", "worst").when(height.isNotNull(), "height").otherwise("best").alias("kind"), height.alias("height"))


def _segment(url: Column, after: str) -> Column:
    """What follows a path part, without a query; null without the part."""
    return F.nullif(F.regexp_extract(url, rf"/{after}/([^/?]*)", 1), F.lit(""))


def _last(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(url, r"(/\?[^/]*|/)+$", ""), r"([^/?]*)(?:\?[^/]*)?$", 1)


def program_id(name: str, url: Column) -> Column:
    """The id that a service's url names; ids by themselves stay. An episode's url without all its parts gives null."""
    episode = F.regexp_extract(url, r"/serie/([^/]*)/[^/]*/([^/]*)/[^/]*/([^/?]*)", 1)
    parts = [F.regexp_extract(url, r"/serie/([^/]*)/[^/]*/([^/]*)/[^/]*/([^/?]*)", i) for i in (1, 2, 3)]
    of_series = F.when(episode != "", F.concat(parts[0], F.lit("/s"), parts[1], F.lit("/e"), parts[2]))
    found = {
        "yle": F.regexp_extract(url, r"([^/?]*)(?:\?[^/]*)?$", 1),
        "nrk": F.coalesce(_segment(url, "program"), F.when(F.contains(url, F.lit("/serie/")) & F.contains(url, F.lit("/episode/")), of_series).otherwise(_last(url))),
        "svt": F.coalesce(_segment(url, "video"), _last(url)),
        "dr": F.regexp_extract(_last(url), r"([^_]*)$", 1),
    }[name]
    return F.when(F.startswith(url, F.lit("http")), found).otherwise(url if name != "dr" else F.regexp_extract(url, r"([^_]*)$", 1))


def series_id(name: str, url: Column) -> Column:
    found = F.coalesce(_segment(url, "serie"), _last(url)) if name in ("nrk", "dr") else _last(url)
    return F.when(F.startswith(url, F.lit("http")), found).otherwise(url)


@dataclass(frozen=True)
class Service:
    """A streaming service: which urls are its, and what they name there."""

    name: str
    matches: Callable[[Column], Column]
    program: Callable[[Column], Column] | None = None
    series: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class Backend:
    """A reader of streams, by (url, whether it is encrypted)."""

    name: str
    reads: Callable[[Column, Column], Column]


def _own(name: str) -> Service:
    return Service(name, lambda u: _any(u, SERVICES[name]), lambda u: program_id(name, u), lambda u: series_id(name, u))


BUILT_IN = [*map(_own, SERVICES), Service("generic", _ends)]
BACKENDS = [Backend("native", lambda u, e: ~e & F.contains(u, F.lit(".m3u8"))), Backend("streamlink", lambda u, e: tool_reads(u)), Backend("ffmpeg", lambda u, e: u.isNotNull())]


def routed(url: Column, encrypted: Column, services: Sequence[Service] = (), backends: Sequence[Backend] = ()) -> Column:
    """(service, program, series, backend) of each url: the first service that it fits and the first backend that reads it, those of one's
    own being asked before the built-in ones. What no service fits has no ids; a condition that is null does not fit."""
    none = F.lit(None).cast("string")
    named, program, series, reader = none, none, none, none
    for s in reversed([*services, *BUILT_IN]):
        fits = F.coalesce(s.matches(url), F.lit(False))
        named = F.when(fits, s.name).otherwise(named)
        program = F.when(fits, s.program(url) if s.program else none).otherwise(program)
        series = F.when(fits, s.series(url) if s.series else none).otherwise(series)
    for b in reversed([*backends, *BACKENDS]):
        reader = F.when(F.coalesce(b.reads(url, encrypted), F.lit(False)), b.name).otherwise(reader)
    return F.struct(named.alias("service"), program.alias("program"), series.alias("series"), reader.alias("backend"))


EPISODES = {
    "nrk": "seasons ARRAY<STRUCT<seasonNumber: INT, episodes: ARRAY<STRUCT<id: STRING, title: STRING, episodeNumber: INT, duration: STRING>>>>",
    "svt": "associatedContent ARRAY<STRUCT<items: ARRAY<STRUCT<item: STRUCT<id: STRING, videoSvtId: STRING, name: STRING, positionInSeason: INT, season: INT, duration: BIGINT>>>>>",
    "dr": "episodes ARRAY<STRUCT<productNumber: STRING, title: STRING, episodeNumber: INT, seasonNumber: INT, durationInMilliseconds: BIGINT>>",
}


def episodes(name: str, json: Column) -> Column:
    """(id, title, season, episode, seconds) of a series record, in its order; missing ids fall back, missing items go."""
    r = F.from_json(json, EPISODES[name])
    row = lambda i, t, s, e, d: F.struct(i.alias("id"), t.alias("title"), s.cast("int").alias("season"), e.alias("episode"), d.cast("long").alias("seconds"))
    if name == "nrk":
        return F.flatten(F.transform(r["seasons"], lambda s: F.transform(F.coalesce(s["episodes"], F.array()), lambda e: row(e["id"], e["title"], s["seasonNumber"], e["episodeNumber"], T.iso_duration(e["duration"])))))
    if name == "svt":
        items = F.filter(F.flatten(F.transform(r["associatedContent"], lambda c: F.coalesce(c["items"], F.array()))), lambda x: x["item"].isNotNull())
        return F.transform(items, lambda x: row(F.coalesce(x["item"]["videoSvtId"], x["item"]["id"]), x["item"]["name"], x["item"]["season"], x["item"]["positionInSeason"], x["item"]["duration"]))
    return F.transform(r["episodes"], lambda e: row(e["productNumber"], e["title"], e["seasonNumber"], e["episodeNumber"], F.floor(e["durationInMilliseconds"] / 1000)))


def manifest(assets: Column, formats: list[str]) -> Column:
    """The address of the first asset (format, url) in one of the formats."""
    return F.get(F.filter(assets, lambda a: a["format"].isin(*formats)), F.lit(0))["url"]


def picture(images: Column, least: int = 960) -> Column:
    """The first image (width, url) wide enough, else the first."""
    return F.coalesce(F.get(F.filter(images, lambda i: i["width"] >= least), F.lit(0))["url"], F.get(images, F.lit(0))["url"])


def first_filled(*lists: Column) -> Column:
    """The first list that is there and not empty."""
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists])
