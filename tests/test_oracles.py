"""Every query against its DuckDB check, and those without one for rows."""

import math
import os

import duckdb
import pytest

from weftline.plans import registry


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for p in os.listdir(sf):
        c.execute(f"create view {p.split('.')[0]} as select * from '{sf}/{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def rows_of(columns, rows):
    return sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = rows_of(columns, df.collect())
    if name not in registry.ORACLES:
        assert got
        return
    found = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == rows_of(columns, [dict(zip(names, r, strict=True)) for r in found.fetchall()])


def same_as_sql(spark, folder, name, table):
    """A query over one table of a folder equals its SQL over it."""
    df = registry.QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    c = duckdb.connect()
    c.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    found = c.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    want = rows_of(columns, [dict(zip(names, r, strict=True)) for r in found.fetchall()])
    assert want and rows_of(columns, df.collect()) == want


def test_days_beyond_four_digits(spark, tmp_path):
    """Keys of a table 60 times as large give years of five digits."""
    keys = [0, 1, 2_932_930, 2_932_931, 2_932_932, 8_999_999, 100_000_000]
    spark.createDataFrame([(k, k % 14_999) for k in keys], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    same_as_sql(spark, tmp_path, "durations", "orders")


def test_markdown_of_cut_references(spark, tmp_path):
    """Titles and links are cut, some inside a reference; with no semicolon it stays as it is."""
    page = "<!doctype html><html><head><title>{0}</title></head><body><article><h1>{0}</h1>\n<p>{0} x<br>a &lt;b&gt; &amp;lt; <a href=\"/{0}\">{0}</a></p></article></body></html>"
    rows = [(i, page.format(x)) for i, x in enumerate(["one&&&amp", "&lt", "a &am", "&copy", "&copy; &amp;", "&amp;amp", "&amp;amp;", "&ampere;", "&"])]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    same_as_sql(spark, tmp_path, "page_markdown", "pages")


def test_mastodon_without_first_word_or_text(spark, tmp_path):
    """Ids of every kind meet texts that are null, empty or begin with a space."""
    texts = [None, "", " ", "  lead", " y", "\n y", "word and more", "u1 x"]
    rows = [(20 * k + i, x) for k, x in enumerate(texts) for i in range(20)] + [(-7, " a"), (-8, None), (None, "a b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    same_as_sql(spark, tmp_path, "site_mastodon", "documents")


def test_mastodon_names_of_records(spark):
    """The renderer's own rule: an empty display name gives way to the username; a record without content is none."""
    from weftline.functions import sites

    record = '{"content": %s, "created_at": "d", "account": {"username": "u1", "display_name": ""}, "favourites_count": 0, "reblogs_count": 0, "replies_count": 0, "media_attachments": []}'
    df = spark.createDataFrame([(record % x,) for x in ('"<p>x</p>"', '""', "null")], "json string")
    got = [r.m for r in df.select(sites.render("mastodon", df.json, df.json)["markdown"].alias("m")).collect()]
    assert got == ["## u1 (@u1)\n\nx\n\nd\n", "## u1 (@u1)\n\nd\n", None]
