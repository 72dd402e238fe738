"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space between words, as an explicit class that Java and RE2 read alike.
BLANK = r"[ \t\n\r\f\v]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def strip_tags(html: Column) -> Column:
    """Drops tags, an unclosed one up to the end, and stray ``>``; decodes entities, ``&amp;`` first."""
    bare = F.replace(F.regexp_replace(html, r"<[^>]*(>|$)", ""), F.lit(">"), F.lit(""))
    return F.replace(decode_entities(bare), F.lit("&nbsp;"), F.lit(" "))


def decode_entities(text: Column) -> Column:
    """The five named and numbered entities, ``&amp;`` first, so that ``&amp;lt;`` ends as ``<``."""
    # Entities and characters, in order.
    for name, char in [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def format_count(n: Column) -> Column:
    """1500 as 1.5K, 3800000 as 3.8M; half-even on the binary value. Signs are kept."""
    size = F.abs(n)
    short = lambda d, unit: F.concat(F.replace(F.format_number(size / d, 1), F.lit(","), F.lit("")), F.lit(unit))
    text = F.when(size >= 1_000_000, short(1e6, "M")).when(size >= 1_000, short(1e3, "K")).otherwise(size.cast("string"))
    return F.when(n < 0, F.concat(F.lit("-"), text)).otherwise(text)


def wrap(text: Column, width: int = 40, lines: int = 4) -> Column:
    """Greedy wrapping by bytes; a word longer than a line has its own; what exceeds the lines is dropped."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def put(acc: Column, w: Column) -> Column:
        fits = F.octet_length(acc["line"]) + 1 + F.octet_length(w) <= width
        return (
            F.when(F.size(acc["done"]) >= lines, acc)
            .when(acc["line"] == "", F.struct(acc["done"].alias("done"), w.alias("line")))
            .when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["line"], F.lit(" "), w).alias("line")))
            .otherwise(F.struct(F.concat(acc["done"], F.array(acc["line"])).alias("done"), w.alias("line")))
        )

    def close(acc: Column) -> Column:
        every = F.when(acc["line"] != "", F.concat(acc["done"], F.array(acc["line"]))).otherwise(acc["done"])
        return F.array_join(F.slice(every, 1, lines), "\n")

    return F.aggregate(words(text), zero, put, close)


def truncate(text: Column, most: int) -> Column:
    """At most so many characters, the last three being dots if something is left out (characters, so that none is cut)."""
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def code_in(text: Column) -> Column:
    """A one-time-code-like number in a text, for detection and redaction: after a cue, or two groups of three; else six digits alone."""
    named = F.regexp_extract(text, r"(?:code|otp|verification)[:\s]*(\d{6,8})|\b(\d{3}[-\s]?\d{3})\b", 1)
    grouped = F.regexp_extract(text, r"(?:code|otp|verification)[:\s]*(\d{6,8})|\b(\d{3}[-\s]?\d{3})\b", 2)
    alone = F.regexp_extract(text, r"\b(\d{6})\b", 1)
    clean = F.regexp_replace(F.concat(named, grouped), r"[-\s]", "")
    return F.nullif(F.when(F.length(clean) >= 6, clean).otherwise(alone), F.lit(""))


def handle(title: Column) -> Column:
    """The first ``@`` and what follows up to white space or a closing bracket; null without one."""
    return F.nullif(F.regexp_extract(title, r"(@[^\s)]*)", 1), F.lit(""))
