"""Captured site records (JSON) as markdown with metadata.

Each site has a schema and two expressions over the parsed record. Unknown fields are ignored and missing ones null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X
from . import urls as U


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _if(value: Column, *parts: Column | str) -> Column:
    """The parts where the value is there, else nothing."""
    return F.when(value.isNotNull(), _text(*parts)).otherwise("")


def _joined(items: Column, sep: str = "") -> Column:
    return F.coalesce(F.array_join(items, sep), F.lit(""))


def _comments(children: Column, body: Callable[[Column], Column], render: Callable[[Column], Column], title: str, most: int = 10) -> Column:
    """A heading where there are children, and the first ones that have a body."""
    shown = F.transform(F.slice(F.filter(children, lambda c: body(c).isNotNull()), 1, most), render)
    return F.when(F.size(children) > 0, F.concat(F.lit(f"### {title}\n\n"), _joined(shown))).otherwise("")


def _counts(parts: list[tuple[Column, str]], zeros: bool) -> Column:
    """``1.5K likes · 3 replies`` of the counts that are there (and, without zeros, above zero)."""
    shown = [F.when((n.isNotNull() if zeros else n > 0), _text(X.format_count(n), " " + word)) for n, word in parts]
    return F.array_join(F.array_compact(F.array(*shown)), " · ")


def _twitter(r: Column, url: Column) -> Column:
    a = r["author"]
    blocks = F.transform(r["article"]["content"]["blocks"], lambda b: _if(b["text"], b["text"], "\n\n"))
    body = F.when(r["article"].isNotNull(), _joined(blocks)).otherwise(_if(r["text"], r["text"], "\n\n"))
    counts = _counts([(r["likes"], "likes"), (r["retweets"], "reposts"), (r["replies"], "replies"), (r["views"], "views")], True)
    return _text("## @", a["screen_name"], " (", a["name"], ")\n\n", body, F.when(counts != "", _text("📊 ", counts, "\n")).otherwise(""), _if(r["created_at"], "🕐 ", r["created_at"], "\n"), "\n[View on X](", r["url"], ")\n")


def _reddit(r: Column, url: Column) -> Column:
    p, children = r["post"], r["comments"]
    comments = _comments(children, lambda c: c["body"], lambda c: _text("**u/", c["author"], "** (", X.format_count(c["score"]), " points):\n\n", c["body"], "\n\n---\n\n"), "Top Comments")
    head = _text("## ", p["title"], "\n\nby u/", p["author"], " · ", X.format_count(p["score"]), " points · ", X.format_count(p["num_comments"]), " comments\n\n")
    return _text(head, F.when(F.coalesce(p["selftext"], F.lit("")) != "", _text(p["selftext"], "\n\n")).otherwise(""), F.when(~p["is_self"], _text("🔗 ", p["url"], "\n\n")).otherwise(""), comments)


def _hackernews(r: Column, url: Column) -> Column:
    points = F.coalesce(_text(X.format_count(r["points"]), " points"), F.lit("0 points"))
    comments = _comments(r["children"], lambda c: c["text"], lambda c: _text("**", F.coalesce(c["author"], F.lit("unknown")), "**:\n\n", c["text"], "\n\n---\n\n"), "Top Comments")
    return _text(_if(r["title"], "## ", r["title"], "\n\n"), _if(r["author"], "by ", r["author"], " · "), points, " · ", F.size(r["children"]).cast("string"), " comments\n\n", _if(r["url"], "🔗 ", r["url"], "\n\n"), _if(r["text"], r["text"], "\n\n"), comments)


def _github(r: Column, url: Column) -> Column:
    labels = F.transform(r["labels"], lambda x: x["name"])
    shown = F.transform(F.slice(r["thread"], 1, 10), lambda c: _text("**@", c["user"]["login"], "**:\n\n", c["body"], "\n\n---\n\n"))
    head = _text("## ", r["title"], " [", F.upper(r["state"]), "]\n\nby @", r["user"]["login"], " · ", r["comments"].cast("string"), " comments", F.when(F.size(labels) > 0, _text(" · Labels: ", _joined(labels, ", "))).otherwise(""), "\n\n")
    return _text(head, _if(r["body"], r["body"], "\n\n"), F.when(F.size(r["thread"]) > 0, _text("### Comments\n\n", _joined(shown))).otherwise(""))


def _instagram(r: Column, url: Column) -> Column:
    return _text("## @", r["author_name"], "\n\n", _if(r["title"], r["title"], "\n\n"), "![Instagram post](", r["thumbnail_url"], ")\n\n[View on Instagram](", url, ")\n")


def _youtube(r: Column, url: Column) -> Column:
    return _text("## ", r["title"], "\n\nby ", r["author_name"], "\n\n![YouTube video](", r["thumbnail_url"], ")\n\n[Watch on YouTube](", url, ")\n")


def _wikipedia(r: Column, url: Column) -> Column:
    lang = F.regexp_extract(url, r"^https?://([^.]*)", 1)
    page = F.coalesce(r["content_urls"]["desktop"]["page"], _text("https://", lang, ".wikipedia.org/wiki/", U.encode(r["title"])))
    thumb = r["thumbnail"]["source"]
    return _text("## ", r["title"], "\n\n", _if(r["description"], "*", r["description"], "*\n\n"), _if(thumb, "![", r["title"], "](", thumb, ")\n\n"), _if(r["extract"], r["extract"], "\n\n"), "[Read full article on Wikipedia](", page, ")\n")


def _stackoverflow(r: Column, url: Column) -> Column:
    q = r["question"]
    head = _text("## ", X.decode_entities(q["title"]), "\n\nAsked by ", q["owner"]["display_name"], " · ", X.format_count(q["score"]), " votes · ", q["answer_count"].cast("string"), " answers · ", X.format_count(q["view_count"]), " views\n\n")
    tags = F.when(F.size(q["tags"]) > 0, _text("Tags: ", _joined(q["tags"], ", "), "\n\n")).otherwise("")
    # At most three answers come with a question.
    answers = F.transform(F.slice(r["answers"], 1, 3), lambda a: _text("**", a["owner"]["display_name"], "** (", X.format_count(a["score"]), " votes)", F.when(a["is_accepted"], " [ACCEPTED]").otherwise(""), "\n\n", _if(a["body"], X.strip_tags(a["body"]), "\n\n"), "---\n\n"))
    body = _if(q["body"], "### Question\n\n", X.strip_tags(q["body"]), "\n\n")
    return _text(head, tags, body, F.when(F.size(r["answers"]) > 0, _text("### Top Answers\n\n", _joined(answers))).otherwise(""), "[View on Stack Overflow](", q["link"], ")\n")


def _mastodon(r: Column, url: Column) -> Column:
    a, content = r["account"], X.strip_tags(r["content"])
    display = F.when(a["display_name"] == "", a["username"]).otherwise(a["display_name"])
    media = F.transform(r["media_attachments"], lambda m: _if(m["url"], "![", F.coalesce(m["description"], F.lit("Media attachment")), "](", m["url"], ")\n\n"))
    counts = _counts([(r["favourites_count"], "favourites"), (r["reblogs_count"], "boosts"), (r["replies_count"], "replies")], False)
    return _text("## ", display, " (@", a["username"], ")\n\n", F.when(content == "", "").otherwise(_text(content, "\n\n")), _joined(media), F.when(counts != "", _text(counts, "\n")).otherwise(""), r["created_at"], "\n", _if(r["url"], "\n[View on Mastodon](", r["url"], ")\n"))


def _linkedin(r: Column, url: Column) -> Column:
    bare = F.regexp_replace(X.strip_tags(r["html"]), r"^\s+|\s+$", "")
    body = F.when(F.coalesce(bare, F.lit("")) != "", _text(bare, "\n\n")).otherwise("")
    return _text(_if(r["title"], "## ", r["title"], "\n\n"), _if(r["author_name"], "by ", r["author_name"], "\n\n"), _if(r["thumbnail_url"], "![LinkedIn post](", r["thumbnail_url"], ")\n\n"), body, "[View on LinkedIn](", url, ")\n")


@dataclass(frozen=True)
class Site:
    schema: str
    markdown: Callable[[Column, Column], Column]
    likes: Callable[[Column], Column] | None = None


OEMBED = "title STRING, author_name STRING, thumbnail_url STRING, html STRING"

SITES = {
    "twitter": Site("url STRING, text STRING, author STRUCT<screen_name: STRING, name: STRING>, article STRUCT<content: STRUCT<blocks: ARRAY<STRUCT<text: STRING>>>>, likes BIGINT, retweets BIGINT, replies BIGINT, views BIGINT, created_at STRING", _twitter, lambda r: r["likes"]),
    "reddit": Site("post STRUCT<title: STRING, author: STRING, score: BIGINT, num_comments: BIGINT, selftext: STRING, is_self: BOOLEAN, url: STRING>, comments ARRAY<STRUCT<author: STRING, body: STRING, score: BIGINT>>", _reddit, lambda r: F.greatest(r["post"]["score"], F.lit(0))),
    "hackernews": Site("title STRING, author STRING, points BIGINT, url STRING, text STRING, children ARRAY<STRUCT<author: STRING, text: STRING>>", _hackernews, lambda r: r["points"]),
    "github": Site("title STRING, state STRING, user STRUCT<login: STRING>, comments BIGINT, labels ARRAY<STRUCT<name: STRING>>, body STRING, thread ARRAY<STRUCT<user: STRUCT<login: STRING>, body: STRING>>", _github),
    "instagram": Site(OEMBED, _instagram),
    "youtube": Site(OEMBED, _youtube),
    "wikipedia": Site("title STRING, description STRING, extract STRING, thumbnail STRUCT<source: STRING>, content_urls STRUCT<desktop: STRUCT<page: STRING>>", _wikipedia),
    "stackoverflow": Site("question STRUCT<title: STRING, owner: STRUCT<display_name: STRING>, score: BIGINT, answer_count: BIGINT, view_count: BIGINT, tags: ARRAY<STRING>, body: STRING, link: STRING>, answers ARRAY<STRUCT<owner: STRUCT<display_name: STRING>, score: BIGINT, is_accepted: BOOLEAN, body: STRING>>", _stackoverflow, lambda r: r["question"]["score"]),
    "mastodon": Site("url STRING, content STRING, created_at STRING, account STRUCT<username: STRING, display_name: STRING>, favourites_count BIGINT, reblogs_count BIGINT, replies_count BIGINT, media_attachments ARRAY<STRUCT<url: STRING, description: STRING>>", _mastodon, lambda r: r["favourites_count"]),
    "linkedin": Site(OEMBED, _linkedin),
}


def render(site: str, json: Column, url: Column) -> Column:
    """(markdown, platform, canonical_url, likes) of a captured record; a null markdown where the JSON does not parse."""
    s = SITES[site]
    r = F.from_json(json, s.schema)
    likes = s.likes(r) if s.likes else F.lit(None)
    return F.struct(s.markdown(r, url).alias("markdown"), F.lit(site).alias("platform"), url.alias("canonical_url"), likes.cast("long").alias("likes"))


def og_meta(html: Column) -> Column:
    """The last non-empty og:title, og:description and og:image of a page."""

    def last(name: str) -> Column:
        found = F.regexp_extract_all(html, F.lit(rf'<meta\s+property="og:{name}"\s+content="([^"]+)"'), F.lit(1))
        return F.try_element_at(found, F.lit(-1))

    return F.struct(*[last(n).alias(n) for n in ("title", "description", "image")])


def og_markdown(og: Column, url: Column) -> Column:
    """The way out where a site's own record is missing; null without a title or a description."""
    text = _text(_if(og["title"], "## ", og["title"], "\n\n"), _if(og["description"], og["description"], "\n\n"), _if(og["image"], "![Instagram post](", og["image"], ")\n\n"), "[View on Instagram](", url, ")\n")
    return F.when(og["title"].isNotNull() | og["description"].isNotNull(), text)
