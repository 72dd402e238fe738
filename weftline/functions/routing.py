"""Which converter or site a record belongs to, as ordered conditions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls as U

# Mime types by handler, in the handlers' order.
HANDLERS = {"pdf": ["application/pdf"], "html": ["text/html", "application/xhtml+xml"], "plain": ["text/plain", "application/json", "text/csv", "text/xml", "application/xml"]}
HTML_STARTS = ["<!", "<html", "<HTML"]

# Hosts that count as instances of the federated network.
INSTANCES = [
    "mastodon.social", "mastodon.online", "hachyderm.io", "fosstodon.org", "infosec.exchange", "techhub.social", "mstdn.social", "mas.to", "mastodon.world",
    "universeodon.com", "mastodon.gamedev.place", "ruby.social", "mathstodon.xyz", "social.vivaldi.net", "toot.community",
]


def mime(content_type: Column) -> Column:
    return F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))


def handler(body: Column, content_type: Column, also: dict[str, list[str]] | None = None) -> Column:
    """By mime type, else by how the body starts, else plain. also: further handlers' types, asked first."""
    m, out = mime(content_type), None
    for name, types in [*(also or {}).items(), *HANDLERS.items()]:
        out = F.when(m.isin(*types), name) if out is None else out.when(m.isin(*types), name)
    starts = F.lit(False)
    for s in HTML_STARTS:
        starts = starts | F.startswith(body, F.lit(s))
    return out.when(starts, "html").otherwise("plain")


@dataclass(frozen=True)
class Handler:
    """A converter of bodies of some types: a column function of (body, content type), or a function of a list of bodies that
    returns as many texts. The second kind may fail: for all, or (asked again one by one) for some."""

    name: str
    types: tuple[str, ...]
    column: Callable[[Column, Column], Column] | None = None
    batch: Callable[[list[str]], list[str | None]] | None = None


def dispatched(body: Column, content_type: Column, handlers: Sequence[Handler]) -> Column:
    """(handler, markdown, error) of each body, by the handlers of one's own, then by those that are built in.

    Every handler sees its own rows only: column functions stand behind conditions, and one Arrow function takes the bodies of all
    others, null where a row is not theirs, and deals each batch to them. What fails is its row's error and stops nothing; a column
    function that gives null has failed. A null body gives nulls.
    """
    which = F.when(body.isNotNull(), handler(body, content_type, {h.name: list(h.types) for h in handlers}))
    by_name = {h.name: h.batch for h in handlers if h.batch}

    @F.arrow_udf("struct<markdown:string,error:string>")
    def run(names: pa.Array, bodies: pa.Array) -> pa.Array:
        out: list[dict | None] = [None] * len(names)
        theirs: dict[str, list[int]] = {}
        for i, n in enumerate(names.to_pylist()):
            if n is not None:
                theirs.setdefault(n, []).append(i)
        for n, rows in theirs.items():
            for i, got in zip(rows, converted(by_name[n], bodies.take(pa.array(rows)).to_pylist()), strict=True):
                out[i] = got
        return pa.array(out, pa.struct([("markdown", pa.string()), ("error", pa.string())]))

    markdown, error = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h in handlers:
        if h.column:
            got = h.column(body, content_type)
            markdown = F.when(which == h.name, got).otherwise(markdown)
            error = F.when((which == h.name) & got.isNull(), F.lit(f"{h.name}: no result")).otherwise(error)
    if by_name:
        theirs = which.isin(*by_name)
        got = run(F.when(theirs, which), F.when(theirs, body))
        markdown, error = F.when(theirs, got["markdown"]).otherwise(markdown), F.when(theirs, got["error"]).otherwise(error)
    return F.struct(which.alias("handler"), markdown.alias("markdown"), error.alias("error"))


def converted(batch: Callable[[list[str]], list[str | None]], bodies: list[str]) -> list[dict]:
    """What a batch function makes of bodies; if it fails, of each alone."""
    try:
        found = list(batch(bodies))
        if len(found) != len(bodies):
            raise ValueError(f"{len(found)} texts of {len(bodies)} bodies")
        return [{"markdown": x, "error": None} for x in found]
    except Exception as e:  # noqa: BLE001  a handler's failure is its row's
        if len(bodies) == 1:
            return [{"markdown": None, "error": f"{type(e).__name__}: {e}"}]
    return [x for b in bodies for x in converted(batch, [b])]


def sites(url: Column) -> list[tuple[str, Column]]:
    """The sites' conditions in the order in which they are asked."""
    u = U.bare(url)
    has = lambda *xs: reduce(lambda a, b: a | b, (F.contains(u, F.lit(x)) for x in xs))
    question = F.regexp_extract(u, r"stackoverflow\.com/questions/([0-9]*)(?:/|$)", 1)
    return [
        ("twitter", has("x.com/", "twitter.com/") & has("/status/")), ("reddit", has("reddit.com/r/") & has("/comments/")), ("hackernews", has("news.ycombinator.com/item")), ("github", has("github.com/") & has("/issues/", "/pull/")),
        ("instagram", has("instagram.com/") & has("/p/", "/reel/")), ("youtube", has("youtube.com/watch", "youtu.be/")), ("wikipedia", has(".wikipedia.org/wiki/")), ("stackoverflow", has("stackoverflow.com/questions/") & (question != "")),
        ("mastodon", u.rlike(r"^[^@]*?/@[^/]*/[0-9]+(?:/|$)") & has(*INSTANCES)), ("linkedin", has("linkedin.com/posts/", "linkedin.com/pulse/", "linkedin.com/feed/update/")),
    ]


@dataclass(frozen=True)
class Provider:
    """A site of one's own: its name, which urls are its, and what it makes of a body."""

    name: str
    matches: Callable[[Column], Column]
    extract: Callable[[Column, Column], Column]


def extracted(url: Column, body: Column, providers: Sequence[Provider], otherwise: Column) -> Column:
    """What the first provider that matches makes of a body; what else is given where none matches or it makes nothing."""
    out = None
    for p in providers:
        out = F.when(p.matches(url), p.extract(url, body)) if out is None else out.when(p.matches(url), p.extract(url, body))
    return otherwise if out is None else F.coalesce(out, otherwise)


def site(url: Column, also: Sequence[Provider] = ()) -> Column:
    """The first site that fits, one's own after the others; null if none does."""
    out = None
    for name, fits in [*sites(url), *((p.name, p.matches(url)) for p in also)]:
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out


def site_ids(url: Column) -> Column:
    """What a site's url names, as an array: user and status, owner, repository and number, and so on; null for other urls."""
    plain = F.split_part(url, F.lit("?"), F.lit(1))
    bare = F.split_part(plain, F.lit("#"), F.lit(1))
    g = lambda p, i, x=plain: F.regexp_extract(x, p, i)
    name = site(url)
    return (
        F.when(name == "twitter", F.array(g(r"([^/]*)/status/([^/]*)", 1), g(r"([^/]*)/status/([^/]*)", 2)))
        .when(name == "reddit", F.array(F.when(F.endswith(plain, F.lit(".json")), plain).otherwise(F.concat(plain, F.lit(".json")))))
        .when(name == "hackernews", F.array(F.regexp_extract(F.split_part(url, F.lit("#"), F.lit(1)), r"[?&]id=([^&?]*)", 1)))
        .when(name == "github", F.array(*[g(r"([^/]*)/([^/]*)/(?:issues|pull)/([^/]*)", i) for i in (1, 2, 3)]))
        .when(name == "wikipedia", F.array(g(r"^https?://([^.]*)", 1, bare), g(r"/wiki/(.*)$", 1, bare)))
        .when(name == "stackoverflow", F.array(g(r"stackoverflow\.com/questions/([^/]*)", 1, bare)))
        .when(name == "mastodon", F.array(g(r"^https?://([^/]*)", 1, bare), g(r"/@[^/]*/([^/]*)", 1, bare)))
    )


# Words that mark a page that asks for a second factor.
SECOND_FACTOR = ["two-factor", "2fa", "mfa", "verification", "authenticator", "security code", "otp", "one-time password"]


def asks_second_factor(html: Column) -> Column:
    low = F.lower(html)
    return F.exists(F.array(*map(F.lit, SECOND_FACTOR)), lambda k: F.contains(low, k))


def second_factor(html: Column, url: Column) -> Column:
    """The kind of second factor a page asks for, as a struct (kind, detail); null if none is named. The first that fits counts."""
    h, u = F.lower(html), F.lower(url)
    has = lambda *xs: reduce(lambda a, b: a | b, (F.contains(h, F.lit(x)) for x in xs))
    kind = lambda k, d=None: F.struct(F.lit(k).alias("kind"), (d if isinstance(d, Column) else F.lit(d).cast("string")).alias("detail"))
    operator = F.when(has("telia"), "Telia").when(has("elisa"), "Elisa").when(has("dna"), "DNA").otherwise("Mobile Operator")
    # The words of each kind.
    out = F.when(has("mobiilivarmenne", "mobiilitunnistus", "telia tunnistus", "elisa tunnistus", "dna tunnistus"), kind("mobile_certificate", operator))
    for word, at, name in [("digid", "digid.nl", "DigiD"), ("bankid", "bankid.com", "BankID"), ("itsme", "itsme.be", "Itsme")]:
        out = out.when(has(word) | F.contains(u, F.lit(at)), kind("external_idp", name))
    for name, found in [("Nordea Codes", ["nordea codes", "tunnuslukusovellus"]), ("OP Mobile", ["op-mobiili", "op avain"]), ("Aktia ID", ["aktia id"]), ("Danske ID", ["danske id"])]:
        out = out.when(has(*found), kind("mobile_app_push", name))
    out = out.when(has("webauthn", "passkey", "credential.create", "navigator.credentials"), kind("passkey"))
    out = out.when(has("authenticator", "6-digit", "one-time password", "totp"), kind("totp"))
    out = out.when(has("sms") & has("code", "verify"), kind("sms_otp"))
    return out.when(has("email") & has("code", "verify", "link"), kind("email_otp"))


def describe_factor(kind: Column) -> Column:
    """What to call a kind in a sentence; an unknown one has its own words."""
    detail = lambda text: F.concat(F.lit(text + " ("), kind["detail"], F.lit(")"))
    k = kind["kind"]
    # What each kind is called.
    return F.when(k == "totp", "Time-based OTP (1Password)").when(k == "sms_otp", "SMS verification code").when(k == "email_otp", "Email verification code").when(k == "passkey", "Passkey/WebAuthn").when(k == "mobile_app_push", detail("Mobile app authorization")).when(k == "mobile_certificate", detail("Mobile certificate")).when(k == "external_idp", detail("External identity")).otherwise("Unknown 2FA method")


def is_automatable(kind: Column) -> Column:
    return kind["kind"].isin("totp", "sms_otp", "email_otp", "passkey")


def is_audio(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(wav|mp3|flac|m4a|aac|ogg)$")


def is_success(status: Column) -> Column:
    return status.between(200, 299)


def plays_natively(url: Column, encrypted: Column) -> Column:
    return ~encrypted & F.contains(url, F.lit(".m3u8"))
