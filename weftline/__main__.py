"""``python -m weftline``: the queries by name, run over a folder of tables and shown, or written.

    python -m weftline                              lists the queries
    python -m weftline page_text --tables DIR       shows the first rows
    python -m weftline page_text --tables DIR --to OUT --format json
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from .plans import registry


def main(args: Sequence[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="weftline", description="Queries over captured pages, media and events.")
    p.add_argument("query", nargs="?", choices=sorted(registry.QUERIES), metavar="QUERY")
    p.add_argument("--tables", help="folder of Parquet tables")
    p.add_argument("--to", help="folder to write to; without it, rows are shown")
    p.add_argument("--format", default="parquet", help="of what is written")
    p.add_argument("--mode", default="errorifexists", choices=["errorifexists", "append", "overwrite", "ignore"])
    p.add_argument("--rows", type=int, default=20, help="that are shown")
    p.add_argument("--plan", action="store_true", help="show the plan and run nothing")
    a = p.parse_args(args)
    if not a.query:
        for name, f in sorted(registry.QUERIES.items()):
            print(f"{name:28}{(f.__doc__ or '').strip().splitlines()[0] if f.__doc__ else ''}")
        return 0
    if not a.tables:
        p.error("--tables is missing")
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName(f"weftline {a.query}").getOrCreate()
    df = registry.QUERIES[a.query](spark, a.tables)
    if a.plan:
        df.explain("formatted")
    elif a.to:
        df.write.format(a.format).mode(a.mode).save(a.to)
    else:
        df.show(a.rows, truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
