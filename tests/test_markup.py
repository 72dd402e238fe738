"""The scanner and the tree: literal cases, and pages that would take a backtracking or copying reader minutes or its stack."""

import time

import pytest
from pyspark.sql import functions as F

from weftline.functions import discovery, html, jsonx, markup, parser, streams, subtitles


def names(html):
    t = markup.tree(html)
    return [(e.tag, t.elements[e.parent].tag if e.parent >= 0 else None) for e in t.elements]


def test_scan():
    got = [(x.kind, x.name, x.inner) for x in markup.scan("""a<B c="x>y" d='>'>1 < 2<!-- <p> --><?x?><!doctype z></b ><script>if (a<b) "</p>"</SCRIPT>&amp;""")]
    assert got == [("text", "", "a"), ("open", "b", """ c="x>y" d='>'"""), ("text", "", "1 "), ("text", "", "<"), ("text", "", " 2"), ("close", "b", " "), ("open", "script", ""), ("raw", "script", 'if (a<b) "</p>"'), ("close", "script", ""), ("text", "", "&amp;")]
    assert [x.kind for x in markup.scan("a<b c=")] == ["text"] and [x.kind for x in markup.scan("a<!-- b <p>")] == ["text"] and list(markup.scan("")) == []
    assert markup.attributes(""" A=1 b = "x &amp; y" c='z' d a=2 e=&lt; /""") == {"a": "1", "b": "x & y", "c": "z", "d": "", "e": "<"}


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<html><head><title>x</title><body><h1>a</h1>", [("html", None), ("head", "html"), ("title", "head"), ("body", "html"), ("h1", "body")]),
        ("<head><meta><p>a", [("head", None), ("meta", "head"), ("p", None)]),
        ("<p>a<p>b<div>c<p>d</div>", [("p", None), ("p", None), ("div", None), ("p", "div")]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", [("ul", None), ("li", "ul"), ("li", "ul"), ("ul", "li"), ("li", "ul"), ("li", "ul")]),
        ("<table><tr><td>a<td>b<tr><th>c<table><tr><td>d</table></table>", [("table", None), ("tr", "table"), ("td", "tr"), ("td", "tr"), ("tr", "table"), ("th", "tr"), ("table", "th"), ("tr", "table"), ("td", "tr")]),
        ("<table><tbody><tr><td><p>x</tbody><tfoot><tr><td>y", [("table", None), ("tbody", "table"), ("tr", "tbody"), ("td", "tr"), ("p", "td"), ("tfoot", "table"), ("tr", "tfoot"), ("td", "tr")]),
        ("<select><option>a<option>b<optgroup><option>c</select><p>", [("select", None), ("option", "select"), ("option", "select"), ("optgroup", "select"), ("option", "optgroup"), ("p", None)]),
        ("<dl><dt>a<dd>b<dt>c</dl>", [("dl", None), ("dt", "dl"), ("dd", "dl"), ("dt", "dl")]),
        ("<a href=x>a<a href=y>b<h1>c<h2>d", [("a", None), ("a", None), ("h1", "a"), ("h2", "a")]),
        ("<form><form><input></form><br></p><i>", [("form", None), ("input", "form"), ("br", None), ("i", None)]),
        ("<table><td>a</div></p>b</table>", [("table", None), ("td", "table")]),
    ],
)
def test_tree(html, want):
    assert names(html) == want


def test_text_ranges():
    t = markup.tree("<div>a<p>b<b>c</b></div>d<title>x &lt; y</title>")
    assert [t.text(i) for i in range(4)] == ["abc", "bc", "c", "x < y"] and [e.last for e in t.elements] == [3, 3, 3, 4]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<html><head><title>x</title><body><h1>Hello</h1><p>world</p>", "# Hello\nworld"),
        ("<ul><li>a<li><p>b</p><p>c<li></ul>", "- a\n- b\nc"),
        ("<p><b>bold <br><p>plain<i></i> <em> x </em>", "**bold**\nplain * x*"),
        ("<p>to <a href='/a?b&amp;c'>one<p>two<a href=/d>three", "to [one](/a?b&c)\ntwo[three](/d)"),
        ("<head><script>a</script></head><pre>x\n y</pre><noscript>z</noscript>", "x y"),
        ("no tags &amp; none", "no tags & none"), ("<br>", ""), ("<b>", ""), ("</b></p></html>", ""),
    ],
)
def test_markdown(html, want):
    assert parser.markdown_of(html) == want


def quick(f, seconds=5.0):
    start = time.perf_counter()
    out = f()
    assert time.perf_counter() - start < seconds
    return out


N = 30_000
LONG = {
    "links": "<a href=/b>t " * N, "quoted links": '<a href="/b">t ' * N, "attribute": f"<script data-config='{'x' * 1_000_000}'>fetch('/api/x')</script>", "attributes": "<p " + "a=b " * N + ">x", "paragraphs": "<p>x" * N,
    "nested": "<div>x" * N, "spans": "<p><object>" + "<span>" * N + "<p>y" * 1000, "marks": "<b>" * N + "x" + "<br>" * N, "comments": "<!-- x" * N, "angles": "<" * N, "open tags": "<link " * N, "scripts": "<script>" * N,
    "quotes": "<a x=\"" * N, "end tags": "</p></div></b>" * N, "cells": "<table><tr>" + "<td>x" * N, "lists": "<ul><li>" * N, "entities": "&amp;&" * N,
}


@pytest.mark.parametrize("name", LONG)
def test_long_pages(name):
    page = LONG[name]
    quick(lambda: markup.tree(page))
    quick(lambda: parser.markdown_of(page))
    quick(lambda: markup.links(page))
    quick(lambda: markup.scripts(page))
    quick(lambda: parser.token_of(page, "p > em [name=x], div div b#none"))
    quick(lambda: parser.forms_of(page))
    quick(lambda: jsonx.page_state(page, "__NEXT_DATA__"))


def test_linear():
    took = []
    for n in (20_000, 80_000):
        start = time.perf_counter()
        parser.token_of("<p>x" * n, "#none")
        took.append(time.perf_counter() - start)
    assert took[1] < 12 * max(took[0], 0.02)


def test_long_pages_as_columns(spark):
    pages = spark.createDataFrame([(k, v) for k, v in LONG.items()] + [("null", None), ("empty", "")], "name string, html string")
    got = {r.name: r for r in pages.select("name", F.size(discovery.links(F.col("html"))).alias("links"), discovery.inline_scripts(F.col("html")).alias("scripts"), F.size(discovery.link_hints(F.col("html"))).alias("hints"), parser.markdown(F.col("html")).alias("md")).collect()}
    assert got["links"].links == 1 and got["attribute"].scripts == ["fetch('/api/x')"] and got["null"].links == 0 and got["null"].md is None and got["empty"].md == ""
    assert got["paragraphs"].md == "\n".join(["x"] * N)


def test_native_text_of_long_pages(spark):
    """The native conversion takes unclosed tags by the ten thousand in linear time, and gives what it gave."""
    pages = spark.createDataFrame([(k, v) for k, v in LONG.items()] + [("titles", "<title>" * N), ("heads", "<head><style>" * N), ("blocks", "<p " * N), ("mixed", "a<script>b</script >c<script>d<!-- e -->f<!-- g<p>h<title>T</title><title>")], "name string, html string")
    start = time.perf_counter()
    got = {r.name: r for r in pages.select("name", html.raw_text(F.col("html")).alias("text"), html.title(F.col("html")).alias("title")).collect()}
    assert time.perf_counter() - start < 60
    assert got["mixed"].text == "a c d f T"
    assert (got["mixed"].title, got["titles"].title, got["titles"].text, got["blocks"].text) == ("T", None, "", "\n" + "<p " * N)


DEEP = ["[" * 1_000_000, "[" * 1_000_000 + "]" * 1_000_000, '{"a":' * 500_000 + "1" + "}" * 500_000, '{"k":1,"b":' + "[" * 128 + "]" * 128 + "}"]


def test_deep_json(spark):
    for text in DEEP:
        assert quick(lambda t=text: jsonx.first_value(t)) is None and quick(lambda t=text: jsonx.page_state(f'<script id="S">{t}</script>', "S")) is None
    right = "[" * 127 + "]" * 127
    assert jsonx.compact(jsonx.first_value("x = " + right + ";")) == right and jsonx.compact(jsonx.parsed(right)) == right
    assert jsonx.parsed('"' + "[" * 500 + '"') == "[" * 500 and jsonx.parsed('["' + '\\"[' * 500 + '"]') == ['"[' * 500]
    with pytest.raises(ValueError, match="too deep"):
        jsonx.parsed("[" + right + "]")
    j = F.col("j")
    rows = spark.createDataFrame([(t,) for t in [*DEEP, right, '{"k":[1,2,3]}', None, "", "nul"]], "j string").select(jsonx.pruned(j, 1, 2).alias("cut"), jsonx.outlined(j).alias("outline"), jsonx.at_path(j, "k").alias("k"), jsonx.state(F.concat(F.lit("<script>window.S = "), j), "S").alias("s")).collect()
    assert all(r.cut is None and r.outline is None and r.s is None for r in rows[:4] + rows[6:])
    assert rows[4].cut == '[["[depth limit]"]]' or rows[4].cut == '["[depth limit]"]'
    assert (rows[5].cut, rows[5].outline, rows[5].k, rows[5].s) == ('{"k":["[depth limit]","... +2 more"]}', "k: [3 items]", "[1,2,3]", '{"k":[1,2,3]}')


def test_own_strategies(spark):
    own = [streams.Service("mine", lambda u: F.startswith(u, F.lit("my:")), lambda u: F.substr(u, F.lit(4)))]
    readers = [streams.Backend("mine", lambda u, e: F.when(F.startswith(u, F.lit("my:")), e))]
    rows = spark.createDataFrame([("my:7", True), ("my:7.m3u8", False), ("https://areena.yle.fi/1-5", False), (None, True)], "u string, e boolean")
    got = rows.select(streams.routed(F.col("u"), F.col("e"), own, readers).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in got] == [("mine", "7", None, "mine"), ("mine", "7.m3u8", None, "native"), ("yle", "1-5", "1-5", "ffmpeg"), (None, None, None, None)]
    entry = F.array(F.struct(F.lit(0).alias("start_ms"), F.lit(1500).alias("end_ms"), F.lit("hi").alias("text"), F.lit("A").alias("speaker")))
    kinds = spark.createDataFrame([("srt",), ("txt",), ("n",), ("x",)], "k string")
    got = kinds.select(subtitles.generated(F.col("k"), entry, {"n": lambda e: F.size(e).cast("string")}).alias("t")).collect()
    assert [r.t for r in got] == ["1\n00:00:00,000 --> 00:00:01,500\n[A] hi\n\n", "A: hi\n", "1", None]


def test_command_line(spark, sf, tmp_path, capsys):
    from weftline.__main__ import main

    assert main([]) == 0 and "page_text" in capsys.readouterr().out
    assert main(["strip_tags", "--tables", sf, "--to", str(tmp_path / "out"), "--format", "json"]) == 0
    assert spark.read.json(str(tmp_path / "out")).count() > 0
    with pytest.raises(SystemExit):
        main(["strip_tags"])


def test_boilerplate_of_both_tiers(spark):
    lines = ["Skip to content", "a cookie", "[cookie](x)", "© x", "Copyright", "--", "é", "·", "a·", "—", "plain", "x](y)", "PRIVACY POLICY", "7", "漢"]
    got = spark.createDataFrame([(x,) for x in lines], "l string").select(html.is_boilerplate(F.col("l")).alias("b")).collect()
    assert [r.b for r in got] == [html.boilerplate(x) for x in lines]
