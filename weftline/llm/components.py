"""Connected components by contraction: least neighbours, pointer jumping, and links between what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import write_table


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v: long): the least node reachable.

    A round gives each node the least of itself and its neighbours, then that one's own; links then join the nodes they
    were given, and those within one node go. So links shrink from round to round, and rounds end when none is left.
    Links to null are ignored; no links give no rows. Hubs are plain equi-joins, which Spark may split, and minima that
    are combined before the shuffle.
    """
    left = write_table(links.filter("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    roots = None
    for i in range(max_rounds):
        if left.isEmpty():
            break
        ends = left.select(F.col("u").alias("node"), F.col("v").alias("near")).union(left.select(F.col("v"), F.col("u")))
        least = write_table(ends.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("to")), f"least{i}")
        own = least.select(F.col("node").alias("to"), F.col("to").alias("further"))
        given = write_table(least.join(own, "to").select("node", F.col("further").alias("given")), f"given{i}")
        a, b = given.select(F.col("node").alias("u"), F.col("given").alias("a")), given.select(F.col("node").alias("v"), F.col("given").alias("b"))
        moved = left.join(a, "u").join(b, "v").filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        left = write_table(moved, f"links{i}")
        step = given.select(F.col("node").alias("root"), "given")
        found = given.select("node", F.col("given").alias("root")) if roots is None else roots.join(step, "root", "left").select("node", F.coalesce("given", "root").alias("root"))
        roots = write_table(found, f"roots{i}")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if roots is None:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots
