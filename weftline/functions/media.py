"""Records of media tools as columns: probes, transcripts, page texts, overlay filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import subtitles as S

PROBE = "format STRUCT<duration: STRING>, streams ARRAY<STRUCT<codec_type: STRING, width: INT, height: INT, r_frame_rate: STRING, channels: INT, sample_rate: STRING>>"
TRANSCRIPT = "text STRING, language STRING, segments ARRAY<STRUCT<id: INT, start: DOUBLE, `end`: DOUBLE, text: STRING, speaker: STRING, words: ARRAY<STRUCT<word: STRING, start: DOUBLE, `end`: DOUBLE, probability: DOUBLE>>>>"
#: Largest body that is converted, in bytes.
MAX_BODY = 50 * 1024 * 1024

# Names of a script's surroundings, which are no data.
SURROUNDINGS = ["document", "window", "console", "navigator", "location", "localStorage", "sessionStorage"]


def probe(json: Column) -> Column:
    """(duration, width, height, fps, channels, sample_rate) of the first video and the first audio stream; null without video."""
    r = F.from_json(json, PROBE)
    first = lambda kind: F.get(F.filter(r["streams"], lambda s: s["codec_type"] == kind), F.lit(0))
    video, audio = first("video"), first("audio")
    rate = F.split(video["r_frame_rate"], "/")
    number = lambda i: F.get(rate, F.lit(i)).try_cast("float")
    fps = F.coalesce(F.when(F.size(rate) == 2, F.try_divide(number(0), number(1))).when(F.size(rate) == 1, number(0)), F.lit(30.0))
    out = F.struct(F.coalesce(r["format"]["duration"].try_cast("double"), F.lit(0.0)).alias("duration"), F.coalesce(video["width"], F.lit(0)).alias("width"), F.coalesce(video["height"], F.lit(0)).alias("height"), fps.cast("float").alias("fps"), audio["channels"].alias("channels"), audio["sample_rate"].try_cast("int").alias("sample_rate"))
    return F.when(video.isNotNull(), out)


def transcript(json: Column) -> Column:
    """The segments (id, start_ms, end_ms, text, speaker, n_words, language) of a transcriber's record; times are cut off to milliseconds."""
    r = F.from_json(json, TRANSCRIPT)
    ms = lambda x: F.greatest(F.lit(0), (x * 1000).cast("long"))
    return F.transform(r["segments"], lambda s: F.struct(s["id"].alias("id"), ms(s["start"]).alias("start_ms"), ms(s["end"]).alias("end_ms"), F.trim(s["text"]).alias("text"), s["speaker"].alias("speaker"), F.coalesce(F.size(s["words"]), F.lit(0)).alias("n_words"), r["language"].alias("language")))


def paged_text(pages: Column, size: Column) -> Column:
    """The texts of a document's pages, ordered, with rules between; a note if it is scanned, null if the body is too large."""
    parts = F.transform(pages, lambda t, i: F.when(t == "", "").when(i > 0, F.concat(F.lit("\n\n---\n\n"), t)).otherwise(t))
    text = F.array_join(parts, "")
    scanned = F.concat(F.lit("*Scanned PDF ("), F.size(pages).cast("string"), F.lit(" pages) -- no text layer detected. Use OCR to extract text.*"))
    blank = ~text.rlike(r"[^\s]")
    return F.when(size <= MAX_BODY, F.when(blank & (F.size(pages) > 0), scanned).otherwise(text))


def own_data(objects: Column) -> Column:
    """The entries of a script's globals (a map) that are data."""
    return F.map_filter(objects, lambda k, v: ~F.startswith(k, F.lit("_")) & ~k.isin(*SURROUNDINGS))


def _escaped(text: Column, marks: list[tuple[str, str]]) -> Column:
    for a, b in marks:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


PATH_MARKS = [("\\", "\\\\"), (":", "\\:"), ("'", "\\'")]


def filter_graph(subtitle_path: Column, entries: Column) -> Column:
    """The text of a filter graph: a subtitle file, and for each entry (text, start_ms, end_ms, font, size, color, outline_color, outline, position) a timed text."""

    def draw(e: Column) -> Column:
        at = S.draw_position(e["position"])
        seconds = lambda ms: F.regexp_replace((ms / 1000.0).cast("string"), r"\.0$", "")
        return F.concat(F.lit("drawtext=text='"), _escaped(e["text"], [*PATH_MARKS, ("\n", "\\n")]), F.lit("':fontfile=/System/Library/Fonts/Supplemental/"), e["font"], F.lit(".ttf:fontsize="), e["size"].cast("string"), F.lit(":fontcolor=0x"), e["color"], F.lit(":x="), at["x"], F.lit(":y="), at["y"], F.lit(":borderw="), e["outline"].cast("int").cast("string"), F.lit(":bordercolor=0x"), e["outline_color"], F.lit(":enable='between(t,"), seconds(e["start_ms"]), F.lit(","), seconds(e["end_ms"]), F.lit(")'"))

    subtitles = F.when(subtitle_path.isNotNull(), F.array(F.concat(F.lit("ass='"), _escaped(subtitle_path, PATH_MARKS), F.lit("'")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(subtitles, F.transform(entries, draw)), ",")


PLUGIN_SCHEMA = "url string, markdown string, title string, author string, published string, error string"


def by_plugins(urls: DataFrame, plugins: list[tuple[str, Callable[[str], dict]]], url: str = "url") -> DataFrame:
    """Each url to the first plugin (pattern, function) whose pattern it holds; a failure is a row with an error, no match gives no row."""
    import re

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(re.compile(p), f) for p, f in plugins]
        for batch in batches:
            rows = []
            for u in batch[url]:
                f = next((f for p, f in compiled if u is not None and p.search(u)), None)
                if f is None:
                    continue
                try:
                    got = f(u)
                    meta = got.get("metadata") or {}
                    rows.append((u, got["markdown"], meta.get("title"), meta.get("author"), meta.get("published"), None))
                except Exception as e:  # noqa: BLE001  a plugin's failure is its row's
                    rows.append((u, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["url", "markdown", "title", "author", "published", "error"])

    return urls.select(url).mapInPandas(run, PLUGIN_SCHEMA)
