"""Links, hints, forms of requests and progress lines found in text, as column expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import markup as M
from . import text as X

# Name, pattern, the group of the url and of the method.
ENDPOINTS = [
    ("fetch", r"""fetch\s*\(\s*["'`]([^"'`]+)["'`]""", 1, 0),
    ("fetch_with_method", r"""fetch\s*\(\s*["'`]([^"'`]+)["'`]\s*,\s*\{[^}]*method:\s*["'](\w+)["']""", 1, 2),
    ("axios_method", r"""axios\.(\w+)\s*\(\s*["'`]([^"'`]+)["'`]""", 2, 1),
    ("axios_config", r"""axios\s*\(\s*\{[^}]*url:\s*["'`]([^"'`]+)["'`][^}]*method:\s*["'](\w+)["']""", 1, 2),
    ("xhr_open", r"""\.open\s*\(\s*["'](\w+)["']\s*,\s*["'`]([^"'`]+)["'`]""", 2, 1),
    ("jquery_ajax", r"""\$\.ajax\s*\(\s*\{[^}]*url:\s*["'`]([^"'`]+)["'`][^}]*type:\s*["'](\w+)["']""", 1, 2),
    ("graphql_endpoint", r"""["'`](/graphql|/__graphql|/api/graphql)["'`]""", 1, 0),
    ("base_url", r"""baseURL:\s*["'`](https?://[^"'`]+)["'`]""", 1, 0),
    ("api_constant", r"""(?:API_URL|ENDPOINT|API_ENDPOINT)\s*=\s*["'`]([^"'`]+)["'`]""", 1, 0),
    ("google_batchexecute", r"""["'`](/_/[A-Za-z]+/data/batchexecute)["'`]""", 1, 0),
    ("google_rpc", r"""["'`]((?:https?://[^"'`]+)?/_/[A-Za-z]+[^"'`]*)["'`]""", 1, 0),
    ("google_travel", r"""["'`](/travel/[a-z]+/(?:search|offers|booking)[^"'`]*)["'`]""", 1, 0),
    ("grpc_web", r"""["'`]([^"'`]+\.grpc\.web[^"'`]*)["'`]""", 1, 0),
    ("internal_data", r"""["'`](/(?:data|_ah|api/v\d+)/[^"'`]+)["'`]""", 1, 0),
]
# Words that make a url likelier to give data.
DATA_WORDS = ["data", "list", "get", "fetch", "load", "users", "items"]


def endpoints(js: Column) -> Column:
    """Distinct (url, method, source) of a script; urls with placeholders or under four bytes are left out."""
    found = []
    for name, pattern, url, method in ENDPOINTS:
        urls = F.regexp_extract_all(js, F.lit(pattern), F.lit(url))
        if method:
            both = F.arrays_zip(urls.alias("u"), F.regexp_extract_all(js, F.lit(pattern), F.lit(method)).alias("m"))
            found.append(_with_method(both, name))
        else:
            found.append(_without_method(urls, name))
    return F.array_distinct(F.filter(F.concat(*found), lambda e: ~F.contains(e["url"], F.lit("${")) & (F.octet_length(e["url"]) >= 4)))


def _with_method(both: Column, name: str) -> Column:
    return F.transform(both, lambda p: F.struct(p["u"].alias("url"), F.upper(p["m"]).alias("method"), F.lit(name).alias("source")))


def _without_method(urls: Column, name: str) -> Column:
    return F.transform(urls, lambda u: F.struct(u.alias("url"), F.lit(None).cast("string").alias("method"), F.lit(name).alias("source")))


def inline_scripts(html: Column) -> Column:
    """The texts of scripts without an address of their own."""

    @F.arrow_udf("array<string>")
    def run(batch: pa.Array) -> pa.Array:
        return pa.array([[text for attrs, text in M.scripts(x) if "src" not in attrs] for x in batch.to_pylist()], pa.list_(pa.string()))

    return run(html)


def score(url: Column, method: Column) -> Column:
    """How likely an endpoint gives data."""
    words = sum((F.contains(F.lower(url), F.lit(w)).cast("int") * 5 for w in DATA_WORDS), F.lit(0))
    base = F.when(method == "GET", 10).when(method.isNull(), 5).otherwise(0)
    long, odd = F.octet_length(url) > 100, F.contains(url, F.lit("?")) & ~F.contains(url, F.lit("="))
    return base + F.contains(url, F.lit("/api/")).cast("int") * 20 + F.contains(url, F.lit("graphql")).cast("int") * 15 + words - long.cast("int") * 10 - odd.cast("int") * 5


def links(html: Column) -> Column:
    """(text, href) of a page's links, the first of each address; anchors and scripts are left out. A link that is not closed ends
    at the next one, or with the page."""

    @F.arrow_udf("array<struct<text:string,href:string>>")
    def run(batch: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("text", pa.string()), ("href", pa.string())]))
        return pa.array([list(first(x).values()) for x in batch.to_pylist()], kind)

    def first(page: str | None) -> dict:
        found: dict[str, dict] = {}
        for text, href in M.links(page):
            if not href.startswith(("#", "javascript:")):
                found.setdefault(href, {"text": text, "href": href})
        return found

    return F.transform(run(html), lambda p: F.struct(F.trim(X.strip_tags(p["text"])).alias("text"), p["href"].alias("href")))


def link_header(header: Column) -> Column:
    """(url, rel, as_type, crossorigin) of ``<url>; rel=…``; null without an address or a rel."""
    parts = F.transform(F.split(header, ";"), F.trim)
    url = F.regexp_replace(F.get(parts, F.lit(0)), "^<+|>+$", "")
    pairs = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.struct(F.lower(F.trim(F.split_part(p, F.lit("="), F.lit(1)))).alias("k"), F.when(F.contains(p, F.lit("=")), F.regexp_replace(F.trim(F.regexp_extract(p, "(?s)=(.*)$", 1)), '^"+|"+$', "")).alias("v")))
    last = lambda k: F.try_element_at(F.filter(pairs, lambda p: p["k"] == k), F.lit(-1))
    rel, cross = last("rel")["v"], last("crossorigin")
    return F.when((url != "") & (F.coalesce(rel, F.lit("")) != ""), F.struct(url.alias("url"), rel.alias("rel"), last("as")["v"].alias("as_type"), F.when(cross.isNotNull(), F.coalesce(cross["v"], F.lit("anonymous"))).alias("crossorigin")))


def _attr(tag: Column, name: str) -> Column:
    """An attribute's value, quoted or bare; the name may end another one's, as in ``data-as=``."""
    found = F.regexp_extract(tag, rf"""(?is){name}=("[^"]*"|'[^']*'|[^\s>"']*)""", 1)
    here = tag.rlike(rf"(?i){name}=")
    return F.when(here, F.regexp_replace(found, "^[\"']|[\"']$", ""))


def link_hints(html: Column) -> Column:
    """(url, rel, as_type, crossorigin) of link tags that connect or load ahead."""

    @F.arrow_udf("array<string>")
    def tags(batch: pa.Array) -> pa.Array:
        return pa.array([[x[t.start : t.end] for t in M.scan(x or "") if t.kind == "open" and t.name == "link"] for x in batch.to_pylist()], pa.list_(pa.string()))

    every = F.transform(tags(html), lambda t: F.struct(_attr(t, "href").alias("url"), _attr(t, "rel").alias("rel"), _attr(t, "as").alias("as_type"), _attr(t, "crossorigin").alias("crossorigin")))
    return F.filter(every, lambda h: h["url"].isNotNull() & h["rel"].rlike("preconnect|dns-prefetch|preload|prefetch"))


def encoder_progress(line: Column) -> Column:
    """(seconds, speed, bitrate_bps) of an encoder's status line; null without a time of three parts."""
    t = F.regexp_extract(line, r"time=(\S+)", 1)
    p = F.split(t, ":")
    n = lambda i: F.get(p, F.lit(i)).try_cast("double")
    seconds = F.when(F.size(p) == 3, n(0) * 3600 + n(1) * 60 + n(2))
    speed = F.regexp_extract(line, r"speed=(.*)$", 1)
    rate = F.regexp_replace(F.regexp_extract(line, r"bitrate=\s*(\S+)", 1), "(kbits/s)+$", "").try_cast("double")
    return F.when(seconds.isNotNull(), F.struct(seconds.alias("seconds"), F.regexp_replace(speed, "x+$", "").try_cast("double").alias("speed"), (rate * 1000).cast("long").alias("bitrate_bps")))


def download_progress(line: Column) -> Column:
    """Bytes of ``Downloaded N KiB``; null on other lines."""
    value, unit = F.regexp_extract(line, r"Downloaded\s+(\S+)\s+(\S+)", 1).try_cast("double"), F.regexp_extract(line, r"Downloaded\s+(\S+)\s+(\S+)", 2)
    return (value * F.when(unit == "KiB", 1024.0).when(unit == "MiB", 1024.0**2).when(unit == "GiB", 1024.0**3)).cast("long")

