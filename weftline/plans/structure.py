"""Queries that need a parser, recursion or layout: JSON, forms, structured markdown, glyphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions import parser as P
from ..operators import layout as L
from ..sources.tables import table
from ._pairs import Pairs

PAIRS = Pairs()


@PAIRS.add("""SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS missing,
 '{"a":{"b":null,"c":true},"k":' || json_extract_string(props, '$.k') || ',"l":[1,2,"... +' || CASE WHEN event_id % 2 = 0 THEN '1' ELSE '3' END || ' more"]}' AS cut,
 '{"a":{"b":"[depth limit]","c":"[depth limit]"},"k":' || json_extract_string(props, '$.k') || ',"l":["[depth limit]",' || CASE WHEN event_id % 2 = 0 THEN '"[depth limit]","[depth limit]"]}' ELSE '"[depth limit]","[depth limit]","... +2 more"]}' END AS shallow,
 '{"a":"[depth limit]","k":"[depth limit]","l":"[depth limit]"}' AS names,
 'a: {...}' || chr(10) || '  b: null' || chr(10) || '  c: bool' || chr(10) || 'k: number' || chr(10) || 'l: [' || CASE WHEN event_id % 2 = 0 THEN 3 ELSE 5 END || ' items]' AS outline FROM events""")
def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths, cut values and outlines of JSON without a fixed schema."""
    items = F.when(F.col("event_id") % 2 == 0, "[1,2,3]").otherwise("[1,2,3,4,5]")
    text = F.concat(F.lit('{"l": '), items, F.lit(', "a": {"c": true, "b": null}, '), F.regexp_replace("props", r"^\{", ""))
    df = table(spark, sf_dir, "events").select("event_id", text.alias("j"))
    j = F.col("j")
    cuts = [J.pruned(j, most, depth).alias(name) for name, most, depth in (("cut", 2, 3), ("shallow", 3, 2), ("names", 3, 1))]
    return df.select("event_id", J.at_path(j, "k").alias("k"), J.at_path(j, "l.0").alias("missing"), *cuts, J.outlined(j).alias("outline"))


@PAIRS.add("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN '{"a":"}","id":' || page_id || '}' WHEN 1 THEN '[1,{"b":"\\\\""}]' WHEN 2 THEN '{"s":' || page_id || '}' END AS state FROM pages""".replace("\\\\", "\\"))
def page_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id").cast("string")
    script = (
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">{"id": '), i, F.lit(', "a": "}"}</script>')))
        .when(F.col("page_id") % 4 == 1, F.lit('<script>window.__NEXT_DATA__ = [1, {"b": "\\""}]; x = {};</script>'))
        .when(F.col("page_id") % 4 == 2, F.concat(F.lit('<script>self.__NEXT_DATA__={"s":'), i, F.lit("};</script>")))
        .otherwise(F.lit("<script>window.__NEXT_DATA__ = none; self.__NEXT_DATA__ = 1</script>"))
    )
    return table(spark, sf_dir, "pages").select("page_id", J.state(F.concat(script, F.regexp_replace("html", r"(?is)<script\b.*?</script>|[{\[]", "")), "__NEXT_DATA__").alias("state"))


@PAIRS.add("""WITH s AS (SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN '### Redux/Vuex (`__INITIAL_STATE__`)' || chr(10) || chr(10) || '```json' || chr(10) || '{' || chr(10) || '  "path": "' || url || '"' || chr(10) || '}' || chr(10) || '```' END AS a,
 CASE WHEN page_id % 2 = 0 THEN '### Relay (`__RELAY_STORE__`)' || chr(10) || chr(10) || '```json' || chr(10) || '"' || repeat('x', 8191) || chr(10) || '... [' || (page_id % 100 + 2) || ' more bytes]' || chr(10) || '```' END AS b FROM pages)
SELECT page_id, nullif(concat_ws(chr(10) || chr(10), a, b), '') AS sections FROM s""")
def page_state_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of one page, the second longer than what is shown."""
    first = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit('<script>window.__INITIAL_STATE__ = {"path": "'), "url", F.lit('"};</script>'))).otherwise("")
    long = F.repeat(F.lit("x"), (8191 + F.col("page_id") % 100 + 1).cast("int"))
    second = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<script id="__RELAY_STORE__" type="application/json">"'), long, F.lit('"</script>'))).otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", J.state_sections(F.concat(second, first)).alias("sections"))


@PAIRS.add("""SELECT page_id, action, method, enctype, fields, hidden, is_login, 'tok' || page_id AS csrf FROM (
 SELECT page_id, '/login' AS action, 'POST' AS method, 'application/x-www-form-urlencoded' AS enctype, 'csrf=tok' || page_id || '&lang=fi&note=a b&pw=&user=u2' AS fields, 'csrf=tok' || page_id AS hidden, true AS is_login FROM pages
 UNION ALL SELECT page_id, '', 'GET', 'multipart/form-data', 'q=', '', false FROM pages)""")
def page_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id").cast("string")
    html = F.concat(F.lit("<form action=/login method=post><input type=hidden name=csrf value=tok"), i, F.lit('><input name=user value=u1><input name="user" value="u2"><input type=password name=pw><select name=lang><option value=sv>x<option value=fi selected>y</select><textarea name=note>a b</textarea></form><form enctype="multipart/form-data"><input name=q><input value=nameless></form>'))
    df = table(spark, sf_dir, "pages").select("page_id", F.explode(P.forms(html)).alias("f"), P.token(html, "input[name=csrf]").alias("csrf"))
    pairs = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&")
    return df.select("page_id", "f.action", "f.method", "f.enctype", pairs(F.col("f.fields")).alias("fields"), pairs(F.col("f.hidden_fields")).alias("hidden"), F.col("f.is_login_form").alias("is_login"), "csrf")


# The pages' bold texts hold no tags and end at a line break before the next block; none has an end tag.
SQL_MARKDOWN = r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<head\b.*?</head\s*>|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<!doctype[^>]*>', '', 'g'), '\s+', ' ', 'g'),
 '<b>([^<]*?) *<br> ?(?:<p>|</?article>|<footer>|</p>)', '**\1**' || chr(10), 'g'), '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', '[\2](\1)', 'g'), '<li[^>]*>', chr(10) || '- ', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '<h1[^>]*>', chr(10) || '# ', 'g'), '</?(?:p|div|article|nav|ul|footer|br|h1|li)\b[^>]*>', chr(10), 'g'), '</?(?:html|body)\b[^>]*>', '', 'g') AS h FROM a),
c AS (SELECT page_id, list_filter(list_transform(string_split(replace(replace(replace(replace(replace(replace(replace(h, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), chr(10)), lambda x: trim(x, ' ')), lambda x: NOT regexp_full_match(x, '[-#*` ]*')
 AND NOT (NOT contains(x, '](') AND (contains(lower(x), 'skip to content') OR contains(lower(x), 'cookie') OR contains(lower(x), 'privacy policy') OR contains(lower(x), 'terms of service') OR starts_with(lower(x), '©') OR starts_with(lower(x), 'copyright') OR (strlen(x) < 3 AND NOT regexp_matches(lower(x), '[\p{L}\p{N}]'))))) AS l FROM b)
SELECT page_id, array_to_string(l, chr(10)) AS markdown FROM c"""


@PAIRS.add(SQL_MARKDOWN)
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown with headings, lists, links and emphasis, by a tree, without boilerplate."""
    return table(spark, sf_dir, "pages").select("page_id", P.markdown(F.col("html")).alias("markdown"))


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten part names to a page, each on a line; spaces in names are gaps wide enough for a column in two names of three."""
    k = F.col("p_partkey")
    df = table(spark, sf_dir, "part").select(k, F.posexplode(F.split(F.concat(F.lpad((k % 7).cast("string"), 2, "x"), F.lit(" "), "p_name"), "")).alias("i", "ch")).filter("ch <> '' and ch <> ' '")
    wide = F.when(F.floor(F.col("p_partkey") / 4) % 3 > 0, 30.0).otherwise(4.0)
    gap = F.when(F.col("i") > 2, wide).otherwise(0.0)
    return df.select((F.floor(F.col("p_partkey") / 10)).alias("doc"), F.lit(0).alias("page"), "ch", (F.col("i") * 6.0 + gap).alias("x"), (1000.0 - F.col("p_partkey") % 10 * 12).alias("y"), F.lit(6.0).alias("width"), F.lit(10.0).alias("height"), "p_partkey")


@PAIRS.add("""WITH g AS (SELECT p_partkey, p_partkey // 10 AS doc, lpad(CAST(p_partkey % 7 AS VARCHAR), 2, 'x') AS a, p_name AS b, CASE WHEN p_partkey // 4 % 3 > 0 THEN 30.0 ELSE 4.0 END AS w FROM part),
n AS (SELECT *, string_split(b, ' ') AS p FROM g)
SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY p_partkey) - 1 AS BIGINT) AS line, a || CASE WHEN w + 6 > 3 THEN ' ' ELSE '' END || array_to_string(p, ' ') AS text, CASE WHEN w > 6 THEN '30.0' ELSE '' END AS bounds FROM n""")
def glyph_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = L.lines(glyphs(spark, sf_dir).drop("p_partkey"), "doc")
    return df.select("doc", "line", "text", F.array_join(F.transform("bounds", lambda b: b.cast("string")), ",").alias("bounds"))


def drifting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same glyphs, with columns that stand up to 12 apart from line to line: some align with the line before and not with their run's first."""
    moved = F.when((F.col("x") > 12) & (F.floor(F.col("p_partkey") / 4) % 3 > 0), 3.0 * (F.col("p_partkey") % 9)).otherwise(0.0)
    return glyphs(spark, sf_dir).withColumn("x", F.col("x") + moved).drop("p_partkey")


# A line's bound is half-way of its gap. Runs are walked from line to line with the bound and the number of their first line.
SQL_RUNS = """WITH RECURSIVE g AS (SELECT p_partkey // 10 AS doc, row_number() OVER (PARTITION BY p_partkey // 10 ORDER BY p_partkey) - 1 AS line, lpad(CAST(p_partkey % 7 AS VARCHAR), 2, 'x') AS a, p_name AS b,
 CASE WHEN p_partkey // 4 % 3 > 0 THEN 15 + (30 + 3.0 * (p_partkey % 9)) / 2 END AS bound, CASE WHEN p_partkey // 4 % 3 > 0 THEN 30 + 3.0 * (p_partkey % 9) ELSE 4 END AS gap, 1000.0 - p_partkey % 10 * 12 AS y FROM part),
r AS (SELECT doc, line, bound AS b0, line AS l0 FROM g WHERE line = 0
 UNION ALL SELECT g.doc, g.line, CASE WHEN abs(g.bound - r.b0) < 5 THEN r.b0 ELSE g.bound END, CASE WHEN abs(g.bound - r.b0) < 5 THEN r.l0 ELSE g.line END FROM r JOIN g ON g.doc = r.doc AND g.line = r.line + 1),
n AS (SELECT *, dense_rank() OVER (PARTITION BY doc ORDER BY l0) - 1 AS n FROM r),
t AS (SELECT doc, n, min(l0) AS l0, 0.0::DOUBLE AS x_min, CAST(max((length(a) + length(b)) * 6.0 + 6 + gap) AS DOUBLE) AS x_max, CAST(min(y) AS DOUBLE) AS y_min, CAST(max(y) AS DOUBLE) AS y_max,
 string_agg('| ' || a || ' | ' || replace(b, ' ', '') || ' |' || chr(10) || CASE WHEN line = l0 THEN '| --- | --- |' || chr(10) ELSE '' END, '' ORDER BY line) AS markdown FROM n JOIN g USING (doc, line) GROUP BY doc, n HAVING count(*) >= 3 AND bool_and(b0 IS NOT NULL))
"""


@PAIRS.add(SQL_RUNS + "SELECT doc, 0 AS page, CAST(n AS INTEGER) AS n, x_min, x_max, y_min, y_max, markdown FROM t")
def glyph_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as markdown with their boxes; runs are anchored to their first line."""
    df = L.tables(L.lines(drifting(spark, sf_dir), "doc"), "doc")
    return df.select("doc", "page", "n", "x_min", "x_max", "y_min", "y_max", L.markdown(F.col("rows")).alias("markdown"))


@PAIRS.add(SQL_RUNS + """SELECT g.doc, g.line, 0 AS page, a || ' ' || b AS text, CAST(t.n AS INTEGER) AS "table", coalesce(g.line = t.l0, false) AS emits FROM g JOIN n USING (doc, line) LEFT JOIN t ON t.doc = n.doc AND t.n = n.n""")
def lines_in_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.lines(drifting(spark, sf_dir), "doc")
    return L.place_tables(found, L.tables(found, "doc"), "doc")
