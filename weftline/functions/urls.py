"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Null on what is no url."""
    return F.try_parse_url(url, F.lit("HOST"))


def referer(url: Column) -> Column:
    return F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), host(url), F.lit("/"))


def encode(text: Column) -> Column:
    """Percent-encoding that keeps letters, digits and ``-_.~`` only."""
    out = F.url_encode(text)
    for a, b in [("+", "%20"), ("*", "%2A"), ("%7E", "~")]:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def form_encoded(pairs: Column) -> Column:
    """(name, value) structs as sorted ``name=value`` joined by ``&``."""
    return F.array_join(F.array_sort(F.transform(pairs, lambda p: F.concat(encode(p["name"]), F.lit("="), encode(p["value"])))), "&")


def bare(url: Column) -> Column:
    """Lower-cased, without its query: what the site predicates look at."""
    return F.lower(F.split_part(url, F.lit("?"), F.lit(1)))


def _origin(base: Column) -> Column:
    return F.regexp_extract(base, r"^(https?://[^/]+)", 1)


def resolve_playlist(base: Column, rel: Column) -> Column:
    """Full urls stay; absolute paths go to the origin; others replace what follows the base's last slash."""
    folder = F.regexp_extract(base, r"^(.*/)[^/]*$", 1)
    parent = F.when(F.length(F.regexp_replace(base, r"^https?://[^/]*", "")) > 0, folder).otherwise(F.concat(base, F.lit("/")))
    return F.when(rel.rlike("^https?://"), rel).when(F.startswith(rel, F.lit("/")), F.concat(_origin(base), rel)).otherwise(F.concat(parent, rel))


def resolve_endpoint(base: Column, rel: Column) -> Column:
    """Full urls stay; absolute paths go to the origin; others are dropped (null)."""
    return F.when(F.startswith(rel, F.lit("http")), rel).when(F.startswith(rel, F.lit("/")), F.concat(_origin(base), rel))


def resolve_script(base: Column, rel: Column) -> Column:
    """As for endpoints, but what is neither is passed through."""
    return F.coalesce(resolve_endpoint(base, rel), rel)
