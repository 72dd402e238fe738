"""Literal cases, and sequential models for what folds rows in order."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from weftline.functions import discovery, html, jsonx, parser, routing, text, times, urls
from weftline.operators import intervals, layout, manifests, responses
from weftline.streaming import live


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)] if values else [Row(_=1)]).select(column.alias("x")).first().x


@pytest.mark.parametrize(("n", "want"), [(999, "999"), (1500, "1.5K"), (8800, "8.8K"), (999999, "1000.0K"), (1000000, "1.0M"), (3800000, "3.8M"), (-1500, "-1.5K"), (1250, "1.2K"), (0, "0")])
def test_format_count(spark, n, want):
    assert one(spark, text.format_count(F.col("n")), n=n) == want


@pytest.mark.parametrize(("s", "want"), [("PT1H", 3600), ("PT30M", 1800), ("PT1H30M", 5400), ("PT45M30S", 2730), ("PT90S", 90), ("PT2H15M30S", 8130), ("PT", None), ("PT0S", None)])
def test_iso_duration(spark, s, want):
    assert one(spark, times.iso_duration(F.col("s")), s=s) == want


@pytest.mark.parametrize(("s", "want"), [("1h", 3600), ("30m", 1800), ("1h30m", 5400), ("90", 90), ("1m30", 90), ("2H", 7200), ("x", None)])
def test_spoken_duration(spark, s, want):
    assert one(spark, times.spoken_duration(F.col("s")), s=s) == want


@pytest.mark.parametrize(("ms", "srt", "ass"), [(0, "00:00:00,000", "0:00:00.00"), (1000, "00:00:01,000", "0:00:01.00"), (61000, "00:01:01,000", "0:01:01.00"), (3661500, "01:01:01,500", "1:01:01.50")])
def test_subtitle_times(spark, ms, srt, ass):
    df = spark.createDataFrame([Row(m=ms)])
    assert df.select(times.srt_time(F.col("m")), times.ass_time(F.col("m")), times.srt_ms(times.srt_time(F.col("m")))).first() == (srt, ass, ms)


@pytest.mark.parametrize(("line", "want"), [("Skip to content", True), ("Cookie Policy", True), ("Privacy Policy", True), ("Terms of Service", True), ("© 2025 Company", True), ("Copyright 2025", True), ("--", True), ("ab", False), ("This is actual content", False), ("Welcome to our site", False), ("[Link](https://example.com)", False), ("é", False)])
def test_boilerplate(spark, line, want):
    assert one(spark, html.is_boilerplate(F.col("l")), l=line) is want


@pytest.mark.parametrize(("body", "kind", "want"), [("<p>", "text/html; charset=utf-8", "html"), ("x", "application/xhtml+xml", "html"), ("x", "text/plain", "plain"), ("{}", "application/json", "plain"), ("<!DOCTYPE html>", "application/octet-stream", "html"), ("x", "application/octet-stream", "plain"), ("%PDF", "Application/PDF", "pdf"), ("x", None, "plain")])
def test_handler(spark, body, kind, want):
    df = spark.createDataFrame([(body, kind)], "b string, k string")
    assert df.select(routing.handler(F.col("b"), F.col("k"))).first()[0] == want


@pytest.mark.parametrize(("base", "rel", "want"), [("https://e.com/a/b.m3u8", "c.ts", "https://e.com/a/c.ts"), ("https://e.com/a/b.m3u8", "/c.ts", "https://e.com/c.ts"), ("https://e.com/a/b", "http://o/x", "http://o/x"), ("https://e.com", "c.ts", "https://e.com/c.ts")])
def test_resolve(spark, base, rel, want):
    assert one(spark, urls.resolve_playlist(F.col("b"), F.col("r")), b=base, r=rel) == want


def test_attributes(spark):
    got = one(spark, manifests.attributes(F.col("a")), a='BANDWIDTH=1280000,CODECS="avc1,mp4a",RESOLUTION=720x480,BANDWIDTH=5')
    assert got == {"BANDWIDTH": "5", "CODECS": "avc1,mp4a", "RESOLUTION": "720x480"}
    assert one(spark, manifests.attributes(F.col("a")), a="") == {}


def test_strip_tags(spark):
    assert one(spark, text.strip_tags(F.col("h")), h="<p>a &amp;lt; b</p> > c&nbsp;<x") == "a < b  c "


def test_link_header(spark):
    head = lambda s: one(spark, discovery.link_header(F.col("s")), s=s)
    assert head("</a.css>; rel=preload; as=style") == ("/a.css", "preload", "style", None)
    assert head("</b.js>; rel=preload; as=script; crossorigin") == ("/b.js", "preload", "script", "anonymous")
    assert head("</c>; as=x") is None and head("<>; rel=preload") is None


def test_wrap_model(spark):
    r = random.Random(2)

    def model(s, width=40, lines=4):
        out, line = [], ""
        for w in s.split():
            if len(out) >= lines:
                break
            if not line:
                line = w
            elif len(line.encode()) + 1 + len(w.encode()) <= width:
                line += " " + w
            else:
                out.append(line)
                line = w
        return "\n".join((out + [line] if line else out)[:lines])

    cases = [" ".join("".join(r.choice("aébc") for _ in range(r.randint(1, 45))) for _ in range(r.randint(0, 40))) for _ in range(60)]
    got = spark.createDataFrame([(i, s) for i, s in enumerate(cases)], "i int, s string").select("i", text.wrap(F.col("s")).alias("w")).collect()
    assert {x.i: x.w for x in got} == {i: model(s) for i, s in enumerate(cases)}


def test_forms_and_tokens():
    page = '<form action="/login" method="post"><input type="hidden" name="csrf" value="abc123"><input name=u><input type=password name=p></form><form><select name=s><option value="">-<option value=b>B</select></form>'
    a, b = parser.forms_of(page)
    assert a["is_login_form"] and a["hidden_fields"] == {"csrf": "abc123"} and a["method"] == "POST" and a["fields"] == {"csrf": "abc123", "u": "", "p": ""}
    assert b["fields"] == {"s": "b"} and not b["is_login_form"] and b["method"] == "GET"
    assert parser.token_of(page, "input[name=csrf]") == "abc123" and parser.token_of("<meta id=t class='x y'><p class=y> z </p>", "p.y") == "z" and parser.token_of(page, "#none") is None


def test_markdown():
    got = parser.markdown_of("<head><title>t</title></head><h2>Head</h2><p>a <b>b</b> <a href='/x'>link</a></p><ul><li>one<li>two</ul><script>var x='</p>'</script>")
    assert got == "## Head\na **b** [link](/x)\n- one\n- two"
    assert parser.markdown_of(None) is None and parser.markdown_of("") == ""


def test_json():
    assert jsonx.cut({"a": [1, 2, 3], "b": {"c": {"d": 1}}}, 2, 3) == {"a": [1, 2, "... +1 more"], "b": {"c": {"d": "[depth limit]"}}}
    assert jsonx.outline([{"a": 1, "b": [1], "c": {"d": None}}]) == ["[0]:", "  a: number", "  b: [1 items]", "  c: {...}", "    d: null"]
    assert jsonx.first_value('x = {"a": "}\\""}; y') == {"a": '}"'} and jsonx.first_value("none") is None


def test_intervals_model(spark):
    r = random.Random(4)
    left = [(i % 3, i, r.uniform(0, 100)) for i in range(60)]
    left = [(k, i, s, s + r.uniform(0, 9)) for k, i, s in left]
    right = [(i % 3, i, r.uniform(0, 100)) for i in range(50)]
    right = [(k, i, s, s + r.choice([0.0, 2.0, 40.0, 90.0])) for k, i, s in right]
    a = spark.createDataFrame(left, "k int, pos int, l_start double, l_end double")
    b = spark.createDataFrame(right, "k int, r_pos int, r_start double, r_end double").withColumn("v", F.col("r_pos"))

    def overlap(k, s, e):
        best = (0, None)
        for k2, i, s2, e2 in right:
            o = min(e, e2) - max(s, s2)
            if k == k2 and o > best[0]:
                best = (o, i)
        return best[1]

    assert {x.pos: x.v for x in intervals.most_overlap(a, b, "k", "pos", "v", 7.0).collect()} == {i: overlap(k, s, e) for k, i, s, e in left}
    inside = {i: next((j for k2, j, s2, e2 in right if k == k2 and s2 <= s and e2 >= e), None) for k, i, s, e in left}
    assert {x.pos: x.v for x in intervals.first_container(a, b, "k", "pos", "v", 7.0).collect()} == inside


def test_intervals_of_all_lengths(spark):
    """One interval of a thousand million seconds, and lengths over nine orders, beside many short ones."""
    r = random.Random(6)
    span = lambda n: [(k, i, s, s + r.choice([0.0, 3.0, 30.0, 10.0 ** r.uniform(0, 9)])) for i in range(n) for k, s in [(i % 2, r.uniform(-1e3, 1e6 if i % 3 else 500.0))]]
    left = [*span(300), (0, 300, -5.0, 1e9), (1, 301, 7.0, 2.0), (0, 302, None, 3.0), (0, 303, float("nan"), 3.0), (0, 304, 1.0, float("inf")), (1, 305, 1e300, 1.5e300)]
    right = [*span(300), (1, 300, 0.0, 1e9), (0, 301, 5.0, 5.0), (None, 302, 5.0, 5.0)]
    a = spark.createDataFrame(left, "k int, pos int, l_start double, l_end double")
    b = spark.createDataFrame(right, "k int, r_pos int, r_start double, r_end double")
    ok = lambda *x: all(v is not None and abs(v) < float("inf") for v in x)
    for slack in (0.0, 2.5):
        want = sorted((i, j) for k, i, s, e in left for k2, j, s2, e2 in right if k == k2 and ok(s, e, s2, e2) and s2 <= e + slack and s - slack <= e2)
        assert sorted((x.pos, x.r_pos) for x in intervals.overlap_pairs(a, b, "k", slack=slack).collect()) == want and len(want) > 1000


def test_one_wild_interval(spark):
    """Rows are bounded by levels: the wild interval costs its bins, and two rows for each of the others, not its length."""
    short = spark.range(100_000).selectExpr("0 as k", "id as pos", "id * 10.0D as l_start", "id * 10.0D + 4 as l_end")
    long = spark.createDataFrame([(0, 0, 3.0, 1e9), (0, 1, 50.0, 51.0)], "k int, r_pos int, r_start double, r_end double")
    assert intervals.overlap_pairs(short, long, "k").groupBy("r_pos").count().orderBy("r_pos").collect() == [(0, 100_000), (1, 1)]
    levels = spark.createDataFrame([([0, 25],)], "_levels array<int>")
    binned = intervals._binned(intervals._leveled(short, F.col("l_start"), F.col("l_end"), 30.0, "l"), F.col("l_start"), F.col("l_end"), 30.0, "l", levels, lambda n, own: n > own)
    assert binned.count() <= 4 * 100_000


def test_label_track(spark):
    rows = [(0, 0, "John", 0, 1000), (0, 1, "John", 1000, 2000), (0, 2, "Jane", 2500, 4000), (0, 3, "Jane", 9000, 9100)]
    got = intervals.speaker_labels(spark.createDataFrame(rows, "k int, pos int, speaker string, start_ms long, end_ms long"), "k")
    assert sorted((x.speaker, x.start_ms, x.end_ms) for x in got.collect()) == [("Jane", 2500, 4000), ("John", 0, 2000)]


def test_tables(spark):
    rows = []
    for line, (a, b) in enumerate([("Name", "Age"), ("Ann", "30"), ("Bob", "41"), ("plain", "")]):
        rows += [(0, 0, c, i * 6.0, 100.0 - 12 * line, 6.0, 10.0) for i, c in enumerate(a)] + [(0, 0, c, 60 + i * 6.0, 100.0 - 12 * line, 6.0, 10.0) for i, c in enumerate(b)]
    found = layout.lines(spark.createDataFrame(rows, "doc int, page int, ch string, x double, y double, width double, height double"), "doc")
    got = layout.tables(found, "doc").select(layout.markdown(F.col("rows")).alias("m")).collect()
    assert [x.m for x in got] == ["| Name | Age |\n| --- | --- |\n| Ann | 30 |\n| Bob | 41 |\n"]
    df = spark.createDataFrame([Row(a=[10.0, 50.0], b=[12.0, 48.0], c=[10.0], d=[20.0, 50.0], e=[])], "a array<double>, b array<double>, c array<double>, d array<double>, e array<double>")
    assert df.select(*[layout.aligned(F.col("a"), F.col(x)) for x in "abcd"], layout.aligned(F.col("e"), F.col("e"))).first() == (True, True, False, False, False)


def test_field_args(spark):
    assert one(spark, responses.field_args(F.array(F.lit("a=b=c"), F.lit("d=")))) == [("a", "b=c"), ("d", "")]
    with pytest.raises(Exception, match="no = in bad"):
        one(spark, responses.field_args(F.array(F.lit("bad"))))


def test_url_list(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("https://a\n\n # note\n  https://b \n")
    assert [r.url for r in responses.url_list(spark, str(tmp_path / "urls.txt")).collect()] == ["https://a", "https://b"]


def run(stream, name, spark, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_follow_stream(spark, tmp_path):
    polls = [("k", s, p) for p, window in enumerate([[0, 1, 2], [1, 2, 3], [3, 2], [5, 4, 6]]) for s in window]
    for i in range(4):
        spark.createDataFrame([x for x in polls if x[2] == i], "key string, sequence long, poll long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, sequence long, poll long").option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in"))
    got = run(live.follow(stream, "key"), "followed", spark)
    assert sorted(r.sequence for r in got) == [1, 2, 3, 4, 5, 6]


def test_answered_stream(spark, tmp_path):
    spark.sql("select 1L as id, timestamp'2024-01-01 00:00:00' as req_ts union all select 2L, timestamp'2024-01-01 00:00:00'").coalesce(1).write.parquet(str(tmp_path / "q"))
    spark.sql("select 1L as r_id, timestamp'2024-01-01 00:00:30' as resp_ts, 'result' as outcome union all select 2L, timestamp'2024-01-01 00:05:00', 'result'").coalesce(1).write.parquet(str(tmp_path / "p"))
    read = lambda p, s: spark.readStream.schema(s).parquet(str(tmp_path / p))
    got = run(live.answered(read("q", "id long, req_ts timestamp"), read("p", "r_id long, resp_ts timestamp, outcome string")), "answers", spark)
    assert [r.id for r in got] == [1]


def test_links_in_any_quotes(spark):
    from weftline.functions import discovery as D

    html = """<a class=x href='/a'>one</a><a href=/b>two <b>x</b></a><a data-href="/no" href = "/c">three</a><a href="/a">again</a><a href='#x'>no</a><A HREF="javascript:y">no</A><a>none</a>"""
    row = spark.createDataFrame([(html,)], "html string").select(D.links(D.F.col("html")).alias("l")).first()
    assert [(x.href, x.text) for x in row.l] == [("/a", "one"), ("/b", "two x"), ("/c", "three")]


def test_selectors():
    page = """<form id=f><p class="a b"><input name=x value=1></p><div><p lang=en-GB><b>t</b></p></div></form><input name=x value=2><p data-k="u v">w</p>"""
    at = lambda s: parser.token_of(page, s)
    assert (at("form input"), at("p > input"), at("form > input"), at("div input"), at("#f p.b.a [name=x]")) == ("1", "1", None, None, "1")
    assert (at("em, div b"), at("p[lang|=en]"), at("[data-k~=v]"), at("[data-k~='u v']"), at("form > * > b"), at("div > p > b")) == ("t", "t", "w", None, None, "t")
    assert at('[name="x"]') == "1" and at("[name^='']") is None
    for bad in ("", "p >", "p::before", "a + b", "p,"):
        with pytest.raises(ValueError, match="not understood"):
            at(bad)


def test_own_routes(spark):
    wiki = routing.Provider("own", lambda u: F.contains(u, F.lit("own.example/")), lambda u, b: F.nullif(F.regexp_extract(b, "<h1>(.*?)</h1>", 1), F.lit("")))
    rows = spark.createDataFrame([("https://own.example/1", "<h1>a</h1>"), ("https://own.example/2", "none"), ("https://x.com/u/status/1", "<h1>b</h1>"), (None, None)], "u string, b string")
    got = rows.select(routing.site(F.col("u"), [wiki]).alias("s"), routing.extracted(F.col("u"), F.col("b"), [wiki], F.lit("else")).alias("e"), routing.handler(F.col("b"), F.lit("application/epub+zip"), {"epub": ["application/epub+zip"]}).alias("h"))
    assert [tuple(r) for r in got.collect()] == [("own", "a", "epub"), ("own", "else", "epub"), ("twitter", "else", "epub"), (None, "else", "epub")]


def test_stop_rules(spark, tmp_path):
    polls = [("k", s, p, 10.0 * p, p != 2) for p, window in enumerate([[1, 2], [2, 3], [4], [5, 6]]) for s in window]
    polls += [("m", s, p, 10.0 * p, True) for p in range(5) for s in (p, p + 1)]
    schema = "key string, sequence long, poll long, at double, live boolean"
    df = spark.createDataFrame(polls, schema)
    kept = manifests.until_stopped(df, "key", "poll", "at", "live", 35.0)
    assert sorted({(r.key, r.poll) for r in kept.collect()}) == [("k", 0), ("k", 1), ("k", 2), ("m", 0), ("m", 1), ("m", 2), ("m", 3)]
    for i in range(5):
        df.filter(F.col("poll") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(live.follow(stream, "key", at="at", seconds=35.0, is_live="live"), "stopped", spark)
    assert sorted((r.key, r.sequence) for r in got) == [("k", 1), ("k", 2), ("k", 3), ("k", 4), ("m", 1), ("m", 2), ("m", 3), ("m", 4)]


def test_rendered_errors(spark):
    none = F.lit(None).cast("string")
    assert one(spark, responses.full_text(F.lit(200), F.lit(12.4), F.lit("u"), none, F.lit("abc"), True, 2)) == "\n\U0001f310 u [200 12ms]\nab"
    assert one(spark, responses.full_text(F.lit(200), F.lit(12.4), F.lit("u"), none, none, True, 0)) == "\n\U0001f310 u [200 12ms]"
    assert one(spark, responses.quoted(F.lit('a "b"\n[c]'))) == '"a \\"b\\"\\n[c]"'
