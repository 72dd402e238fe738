"""From placed glyphs to lines, columns and tables. Documents and pages are the keys; what is ordered is a page's worth."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .intervals import islands


def lines(glyphs: DataFrame, doc: str) -> DataFrame:
    """(doc, line, page, x, y, x_end, text, bounds, chars) of glyphs (doc, page, ch, x, y, width, height).

    Order is page, y downwards, x. A line ends at a page's end or where y falls by 0.4 of the height of the document's
    first glyph; a gap wider than half the line's mean glyph, and than 1, is a space; one wider than two bounds a column.
    """
    order = Window.partitionBy(doc).orderBy("page", F.desc("y"), "x")
    step = 0.4 * F.first("height").over(order.rowsBetween(Window.unboundedPreceding, 0))
    new = (F.lag("page").over(order) != F.col("page")) | (F.abs(F.col("y") - F.lag("y").over(order)) >= step)
    marked = glyphs.withColumn("_new", new).withColumn("_n", F.row_number().over(order))
    marked = islands(marked, [doc], ["_n"], F.col("_new"))
    c = F.struct("_n", "ch", "x", "y", "width")
    rows = marked.groupBy(doc, F.col("island").alias("line"), "page").agg(F.array_sort(F.collect_list(c)).alias("chars"), F.avg("width").alias("mean"))
    rows = rows.withColumn("gaps", F.transform("chars", lambda g, i: F.when(i > 0, g["x"] - (F.get("chars", i - 1)["x"] + F.get("chars", i - 1)["width"]))))
    text = F.array_join(F.transform("chars", lambda g, i: F.concat(F.when(F.get("gaps", i) > F.greatest(0.5 * F.col("mean"), F.lit(1.0)), " ").otherwise(""), g["ch"])), "")
    bounds = F.filter(F.transform("gaps", lambda g, i: F.when(g > 2 * F.col("mean"), F.get("chars", i)["x"] - g / 2)), lambda b: b.isNotNull())
    last = F.element_at("chars", -1)
    return rows.select(doc, "line", "page", F.get("chars", F.lit(0))["x"].alias("x"), F.get("chars", F.lit(0))["y"].alias("y"), (last["x"] + last["width"]).alias("x_end"), text.alias("text"), bounds.alias("bounds"), "chars")


def aligned(a: Column, b: Column, tolerance: float = 5.0) -> Column:
    """As many bounds on both sides, at least one, each nearer than the tolerance."""
    return (F.size(a) == F.size(b)) & (F.size(a) > 0) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: d < tolerance)


class _Runs:
    """Walks a page's lines in order and yields its tables: runs of lines that align with the run's first line."""

    def __init__(self, doc: str, least: int, tolerance: float) -> None:
        self.doc, self.least, self.tolerance = doc, least, tolerance
        self.run: list = []
        self.n = -1

    def fits(self, bounds: list[float]) -> bool:
        first = self.run[0]["bounds"] if self.run else []
        return 0 < len(first) == len(bounds) and all(abs(a - b) < self.tolerance for a, b in zip(first, bounds, strict=True))

    def put(self, line: Row) -> Iterator[tuple]:
        if not self.fits(line["bounds"]):
            yield from self.end()
            self.n += 1
            self.run = []
        self.run.append(line)

    def end(self) -> Iterator[tuple]:
        bounds = self.run[0]["bounds"] if self.run else []
        if len(self.run) >= self.least and bounds:
            of = lambda name: [line[name] for line in self.run]
            yield (self.run[0][self.doc], self.run[0]["page"], self.n, min(of("x")), max(of("x_end")), min(of("y")), max(of("y")), [self.cells(line["chars"], bounds) for line in self.run])

    @staticmethod
    def cells(chars: list, bounds: list[float]) -> list[str]:
        """A line's text by column: a glyph's column is the number of bounds at or left of it."""
        found = [""] * (len(bounds) + 1)
        for g in chars:
            found[bisect.bisect_right(bounds, g["x"])] += g["ch"]
        return [x.strip(" ") for x in found]


def tables(found: DataFrame, doc: str, least: int = 3, tolerance: float = 5.0) -> DataFrame:
    """(doc, page, n, x_min, x_max, y_min, y_max, rows) of runs of lines that align with the run's first line.

    The first line, not the one before, is compared, so a page's lines are walked in order: a table function over lines that are
    partitioned by page and sorted by line, which holds one run at a time.
    """
    types = dict(found.dtypes)
    schema = f"{doc} {types[doc]}, page {types['page']}, n int, x_min double, x_max double, y_min double, y_max double, rows array<array<string>>"

    class Walk:
        def __init__(self) -> None:
            self.runs = _Runs(doc, least, tolerance)

        def eval(self, line: Row) -> Iterator[tuple]:
            yield from self.runs.put(line)

        def terminate(self) -> Iterator[tuple]:
            yield from self.runs.end()

    lines_of = found.select(doc, "page", "line", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("x_end").cast("double").alias("x_end"), "bounds", F.transform("chars", lambda g: F.struct(g["ch"].alias("ch"), g["x"].alias("x"))).alias("chars"))
    return F.udtf(Walk, returnType=schema)(lines_of.asTable().partitionBy(doc, "page").orderBy("line"))


def markdown(rows: Column) -> Column:
    """A table of ragged rows: short ones are filled with empty cells."""
    n = F.array_max(F.transform(rows, F.size))
    line = lambda r: F.concat(F.lit("|"), F.array_join(F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.lit(" "), F.coalesce(F.try_element_at(r, k), F.lit("")), F.lit(" |"))), ""), F.lit("\n"))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit(" --- |"), n), ""), F.lit("\n"))
    body = F.concat(line(F.get(rows, F.lit(0))), rule, F.array_join(F.transform(F.slice(rows, F.lit(2), F.size(rows)), line), ""))
    return F.when(F.coalesce(n, F.lit(0)) > 0, body).otherwise("")


def place_tables(found: DataFrame, boxes: DataFrame, doc: str, slack: float = 5.0) -> DataFrame:
    """Lines in order with the first table whose box holds them; a table is marked at the first line it holds."""
    b = boxes.select(doc, "page", F.col("n").alias("table"), "x_min", "x_max", "y_min", "y_max")
    inside = F.col("y").between(F.col("y_min"), F.col("y_max")) & F.col("x").between(F.col("x_min") - slack, F.col("x_max") + slack)
    held = found.select(doc, "line", "page", "x", "y").join(b, [doc, "page"]).filter(inside).groupBy(doc, "line").agg(F.min("table").alias("table"))
    out = found.select(doc, "line", "page", "text").join(held, [doc, "line"], "left")
    at = F.row_number().over(Window.partitionBy(doc, "page", "table").orderBy("line"))
    return out.withColumn("emits", F.col("table").isNotNull() & (at == 1))
