"""Subtitles, overlay styles and reports as column expressions. Entries are structs; a document is an ordered array of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import times as T

# Positions and their numbers on a keypad.
ALIGNMENT = {"bottom_left": 1, "bottom_center": 2, "bottom_right": 3, "middle_left": 4, "middle_center": 5, "middle_right": 6, "top_left": 7, "top_center": 8, "top_right": 9, "custom": 5}
STYLE_FORMAT = "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"
EVENT_FORMAT = "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"
SECONDARY = "&H000000FF"


def _cat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def srt(entries: Column) -> Column:
    """Numbered blocks of (start_ms, end_ms, text, speaker); a speaker stands in brackets before the text."""
    block = lambda e, i: _cat((i + 1).cast("string"), "\n", T.srt_time(e["start_ms"]), " --> ", T.srt_time(e["end_ms"]), "\n", F.when(e["speaker"].isNotNull(), _cat("[", e["speaker"], "] ")).otherwise(""), F.coalesce(e["text"], F.lit("")), "\n\n")
    return F.array_join(F.transform(entries, block), "")


def vtt(entries: Column) -> Column:
    block = lambda e, i: _cat((i + 1).cast("string"), "\n", T.srt_time(e["start_ms"], "."), " --> ", T.srt_time(e["end_ms"], "."), "\n", F.when(e["speaker"].isNotNull(), _cat("<v ", e["speaker"], ">")).otherwise(""), F.coalesce(e["text"], F.lit("")), "\n\n")
    return _cat("WEBVTT\n\n", F.array_join(F.transform(entries, block), ""))


def parse_srt(body: Column) -> Column:
    """The entries of a subtitle file, as (start_ms, end_ms, text). Blocks without a number or with a bad time line are left out."""
    blocks = F.split(F.regexp_replace(body, "\r\n", "\n"), r"\n[ \t]*\n\s*")

    def entry(b: Column) -> Column:
        lines = F.split(F.regexp_replace(b, r"^\s+|\s+$", ""), "\n")
        times = F.split(F.get(lines, F.lit(1)), "-->")
        ms = lambda i: T.srt_ms(F.trim(F.get(times, F.lit(i))))
        numbered = F.trim(F.get(lines, F.lit(0))).rlike(r"^\d+$") & (F.size(times) == 2)
        return F.when(numbered & ms(0).isNotNull() & ms(1).isNotNull(), F.struct(ms(0).alias("start_ms"), ms(1).alias("end_ms"), F.array_join(F.slice(lines, F.lit(3), F.size(lines)), "\n").alias("text")))

    return F.filter(F.transform(blocks, entry), lambda e: e.isNotNull())


def transcript(entries: Column) -> Column:
    return F.array_join(F.transform(entries, lambda e: _cat(F.coalesce(e["speaker"], F.lit("Speaker")), ": ", F.coalesce(e["text"], F.lit("")), "\n")), "")


GENERATORS = {"srt": srt, "vtt": vtt, "txt": transcript}


def generated(kind: Column, entries: Column, also: dict[str, Callable[[Column], Column]] | None = None) -> Column:
    """The entries in the format that each row names, by generators of one's own (asked first) or the built-in ones; null for others."""
    out = F.lit(None).cast("string")
    for name, make in {**GENERATORS, **(also or {})}.items():
        out = F.when(kind == name, make(entries)).otherwise(out)
    return out


def escape_ass(text: Column) -> Column:
    for a, b in [("\\", "\\\\"), ("{", "\\{"), ("}", "\\}"), ("\n", "\\N")]:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def dialogue(entries: Column) -> Column:
    line = lambda e: _cat("Dialogue: 0,", T.ass_time(e["start_ms"]), ",", T.ass_time(e["end_ms"]), ",", F.coalesce(e["style"], F.lit("Default")), ",", F.coalesce(e["speaker"], F.lit("")), ",0,0,0,,", escape_ass(F.coalesce(e["text"], F.lit(""))), "\n")
    return F.array_join(F.transform(entries, line), "")


def ass_header(title: Column, styles: Column, width: int = 1920, height: int = 1080) -> Column:
    """styles: lines from ``style_line``."""
    return _cat("[Script Info]\nTitle: ", title, f"\nScriptType: v4.00+\nPlayResX: {width}\nPlayResY: {height}\nScaledBorderAndShadow: yes\nYCbCr Matrix: TV.709\n\n[V4+ Styles]\n{STYLE_FORMAT}\n", F.array_join(F.transform(styles, lambda s: _cat(s, "\n")), ""), f"\n[Events]\n{EVENT_FORMAT}\n")


def colour(rgb: Column, alpha: Column | str = "00") -> Column:
    """RRGGBB as &HAABBGGRR."""
    return _cat("&H", alpha, F.substring(rgb, 5, 2), F.substring(rgb, 3, 2), F.substring(rgb, 1, 2))


def alpha(opacity: Column) -> Column:
    return F.lpad(F.hex(F.floor((F.lit(1.0) - opacity) * 255).cast("long")), 2, "0")


def alignment(position: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in ALIGNMENT.items() for x in kv]), position)


def style_line(s: Column) -> Column:
    """From a struct (name, font, size, color, outline_color, back_color, back_opacity, bold, italic, outline, shadow, position)."""
    flag = lambda c: F.when(c, "-1").otherwise("0")
    return _cat("Style: ", s["name"], ",", s["font"], ",", s["size"].cast("string"), ",", colour(s["color"]), f",{SECONDARY},", colour(s["outline_color"]), ",", colour(s["back_color"], alpha(s["back_opacity"])), ",", flag(s["bold"]), ",", flag(s["italic"]), ",0,0,100,100,0,0,1,", s["outline"].cast("string"), ",", s["shadow"].cast("string"), ",", alignment(s["position"]).cast("string"), ",20,20,20,0")


def draw_position(position: Column, margin: int = 20) -> Column:
    """(x, y) expressions of a named place."""
    m = str(margin)
    across = F.when(F.endswith(position, F.lit("left")), m).when(F.endswith(position, F.lit("right")), f"w-text_w-{m}").otherwise("(w-text_w)/2")
    down = F.when(F.startswith(position, F.lit("top")), m).when(F.startswith(position, F.lit("bottom")), f"h-text_h-{m}").otherwise("(h-text_h)/2")
    return F.struct(across.alias("x"), down.alias("y"))


def draw_params(s: Column) -> Column:
    """A style as the parameters of a text filter; outline, shadow and box only where they are set."""
    at = draw_position(s["position"])
    whole = lambda c: F.floor(c).cast("int").cast("string")
    parts = F.array(
        _cat("fontfile=/System/Library/Fonts/", s["font"], ".ttf"), _cat("fontsize=", s["size"].cast("string")), _cat("fontcolor=0x", s["color"]), _cat("x=", at["x"]), _cat("y=", at["y"]),
        F.when(s["outline"] > 0, _cat("borderw=", whole(s["outline"]), ":bordercolor=0x", s["outline_color"])), F.when(s["shadow"] > 0, _cat("shadowx=", whole(s["shadow"]), ":shadowy=", whole(s["shadow"]), ":shadowcolor=0x000000@0.5")),
        F.when((s["back_color"] != "") & (s["back_opacity"] > 0), _cat("box=1:boxcolor=0x", s["back_color"], "@", s["back_opacity"].cast("string"), ":boxborderw=5")),
    )
    return F.array_join(F.array_compact(parts), ":")


def one_decimal(x: Column, digits: int = 1) -> Column:
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))


def emotion_label(primary: Column, confidence: Column) -> Column:
    return _cat(primary, ": ", one_decimal(confidence * 100, 0), "%")


def report(segments: Column) -> Column:
    """A markdown report of an ordered array of (start, end, speaker, transcript, emotion, confidence, action, flags)."""
    n = F.size(segments)
    who = F.array_distinct(F.filter(F.transform(segments, lambda s: s["speaker"]), lambda x: x.isNotNull()))
    feelings = F.filter(F.transform(segments, lambda s: s["emotion"]), lambda x: x.isNotNull())
    counted = F.array_sort(F.transform(F.array_distinct(feelings), lambda e: F.struct((-F.size(F.filter(feelings, lambda x: x == e))).alias("n"), e.alias("e"))))
    share = F.transform(counted, lambda c: _cat("- **", c["e"], "**: ", (-c["n"]).cast("string"), " (", one_decimal(-c["n"] / n * 100.0), "%)\n"))
    flagged = F.filter(segments, lambda s: F.size(s["flags"]) > 0)
    flags = F.transform(flagged, lambda s: _cat("- **", one_decimal(s["start"]), "s-", one_decimal(s["end"]), 's**: ["', F.array_join(s["flags"], '", "'), '"]\n'))

    def line(s: Column) -> Column:
        feeling = F.when(s["emotion"].isNotNull(), _cat(" (", s["emotion"], " ", one_decimal(s["confidence"] * 100.0, 0), "%)")).otherwise("")
        action = F.when(~s["action"].isin("unknown", "none"), _cat(" [", s["action"], "]")).otherwise("")
        return _cat("**[", one_decimal(s["start"]), "s - ", one_decimal(s["end"]), "s]** ", F.coalesce(s["speaker"], F.lit("Unknown")), feeling, F.coalesce(action, F.lit("")), "\n> ", F.coalesce(s["transcript"], F.lit("")), "\n\n")

    return _cat(
        "# Video Analysis Report\n\n## Summary\n\n- **Total Segments**: ", n.cast("string"), "\n- **Unique Speakers**: ", F.size(who).cast("string"), "\n",
        F.when(F.size(feelings) > 0, _cat("\n### Emotion Distribution\n\n", F.array_join(share, ""))).otherwise(""), F.when(F.size(flagged) > 0, _cat("\n### Flagged Segments\n\n", F.array_join(flags, ""))).otherwise(""),
        "\n## Transcript\n\n", F.array_join(F.transform(segments, line), ""),
    )
