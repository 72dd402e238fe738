"""Corpus queries that SQL can express, against their SQL."""

import duckdb
import pytest

from weftline.llm import mixing, queries


def same(df, sql, folder):
    c = duckdb.connect()
    for name in ("documents", "benchmark"):
        c.execute(f"create view {name} as select * from '{folder[name]}'")
    found = c.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = lambda rows: sorted(rows, key=repr)
    assert order(tuple(r[n] for n in names) for r in df.collect()) == order(found.fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, sf, name):
    same(queries.QUERIES[name](spark, sf), queries.ORACLES[name], {t: f"{sf}/{t}.parquet" for t in ("documents", "benchmark")})


@pytest.mark.parametrize("which", ["odd_docs", "no_docs"])
def test_mixing_of_odd_rows(which, request, sf):
    docs = request.getfixturevalue(which)
    folder = docs.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://") if docs.inputFiles() else None
    if folder is None:
        pytest.skip("no file to read")
    got = mixing.assign(docs, mixing.Mix(rows_per_range=2, ranges_per_block=3)).select("doc_id", "size", "source_size", "target", "taken", "source")
    same(got, queries.OP5_SQL, {"documents": f"{folder}/*.parquet", "benchmark": f"{sf}/benchmark.parquet"})
