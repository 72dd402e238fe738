"""HTML to text with native expressions only: the whole conversion stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Space characters trimmed at line ends, as an explicit class that Java and RE2 read alike.
SPACES = r"[ \t\r\f\v\x{00A0}]"
#: Elements that are dropped with what they hold, then those that end a line.
DROPPED = ["script", "style", "head"]
BLOCK = "p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|blockquote|pre|hr|main|aside|form"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def decode_entities(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def _replaced(html: Column, begin: str, rest: str, by: str) -> Column:
    """What begins and has its rest, replaced. Where the rest is missing, nothing behind matches either: there the page's end is taken as
    it is in one step, so that a search does not go to the end from every beginning."""
    return F.regexp_replace(html, f"(?is){begin}(?:{rest}|(?<=({begin}))(.*)$)", f"{by}$1$2")


def raw_text(html: Column) -> Column:
    """The text of a page, a line for each block; entities decoded, ``&amp;`` last."""
    for name in DROPPED:
        html = _replaced(html, rf"<{name}\b", rf".*?</{name}\s*>", " ")
    html = _replaced(html, "<!--", ".*?-->", " ")
    html = _replaced(html, rf"</?(?:{BLOCK})\b", "[^>]*>", "\n")
    return decode_entities(_replaced(html, "<", "[^>]*>", ""))


def title(html: Column) -> Column:
    """The first title, trimmed, null if there is none or an empty one."""
    found = F.nullif(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>|<title.*$", 1), F.lit(""))
    return F.regexp_replace(decode_entities(found), rf"^{SPACES}+|{SPACES}+$", "")


def trimmed_lines(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, rf"^{SPACES}+|{SPACES}+$", ""))
    return F.filter(lines, lambda x: x != "")


# The phrases and prefixes that mark a line.
PHRASES = ["skip to content", "cookie", "privacy policy", "terms of service"]
PREFIXES = ["©", "copyright"]


def is_boilerplate(line: Column, low: Column | None = None) -> Column:
    """Navigation and legal lines, unless they hold a markdown link. Byte lengths count for the shortest ones. low: the line in lower case."""
    low = F.lower(line) if low is None else low
    short = (F.octet_length(line) < 3) & ~low.rlike(r"[\p{L}\p{N}]")
    named = F.lit(False)
    for x in PHRASES:
        named = named | F.contains(low, F.lit(x))
    for x in PREFIXES:
        named = named | F.startswith(low, F.lit(x))
    return ~F.contains(line, F.lit("](")) & (named | short)


def boilerplate(line: str) -> bool:
    """The same of one line."""
    low = line.lower()
    return "](" not in line and (any(x in low for x in PHRASES) or low.startswith(tuple(PREFIXES)) or (len(line.encode()) < 3 and not any(c.isalnum() for c in low)))


def page_lines(html: Column) -> Column:
    both = F.transform(trimmed_lines(raw_text(html)), lambda x: F.struct(x.alias("line"), F.lower(x).alias("low")))  # lower case once a line
    return F.transform(F.filter(both, lambda x: ~is_boilerplate(x["line"], x["low"])), lambda x: x["line"])
