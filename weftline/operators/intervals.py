"""Joins of intervals and points, and islands of rows, within a recording.

Spark has no range join: a pure range condition compares all rows of a key. Both sides are therefore put in time bins,
joined by key and bin, and checked again; a pair that meets in several bins counts in the first it shares.

Bins come in levels, each twice as wide as the one before. An interval's own level is the first whose bins are as long as it is, so
it lies in two of them, however long it is; two intervals meet at the greater of their levels. For that an interval is also put in
the (at most two) bins of those greater levels that the other side has intervals of. One wild end among short intervals costs each
of them two rows more, and does not become as many rows as it is long.

Defined results: an interval with a bound that is null, not a number or infinite meets nothing; one that ends before it starts meets
what holds both its bounds, in the order they have.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _level(start: Column, end: Column, width: float) -> Column:
    """The least n for which bins of width * 2**n are as long as the interval; 0 or more."""
    longer = F.greatest((end - start) / width, F.lit(1.0))
    return F.ceil(F.log2(longer)).cast("int")


def _bin(at: Column, level: Column, width: float) -> Column:
    return F.floor(at / (F.pow(F.lit(2.0), level) * width))


def _leveled(df: DataFrame, start: Column, end: Column, width: float, name: str) -> DataFrame:
    known = [x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) for x in (start.cast("double"), end.cast("double"))]
    return df.filter(known[0] & known[1]).withColumn(f"_{name}_level", _level(start, end, width))


def _binned(df: DataFrame, start: Column, end: Column, width: float, name: str, other: DataFrame, wider: Callable[[Column, Column], Column]) -> DataFrame:
    """A row for each bin of the interval's own level (_of: this side) and of those levels of the other side that are wider (_of: the other)."""
    own, theirs = F.col(f"_{name}_level"), F.filter("_levels", lambda n: wider(n, F.col(f"_{name}_level")))
    mine, yours = ("l", "r") if name == "l" else ("r", "l")
    at = F.concat(F.array(F.struct(F.lit(mine).alias("of"), own.alias("level"))), F.transform(theirs, lambda n: F.struct(F.lit(yours).alias("of"), n.alias("level"))))
    met = df.crossJoin(F.broadcast(other)).withColumn("_at", F.explode(at))  # other: one row with a side's levels, about a thousand at most
    first, last = (_bin(x, F.col("_at.level"), width) for x in (start, end))
    met = met.withColumns({"_of": F.col("_at.of"), "_level": F.col("_at.level"), f"_{name}_first": first})
    return met.withColumn("_bin", F.explode(F.sequence(F.col(f"_{name}_first"), F.greatest(F.col(f"_{name}_first"), last)))).drop("_at", "_levels", f"_{name}_level")


def overlap_pairs(left: DataFrame, right: DataFrame, key: str, width: float = 30.0, slack: float = 0.0) -> DataFrame:
    """Pairs of the same key whose closed intervals meet, the left's widened by ``slack``. left: l_start, l_end; right: r_start, r_end."""
    l_bounds, r_bounds = (F.col("l_start") - slack, F.col("l_end") + slack), (F.col("r_start"), F.col("r_end"))
    a, b = _leveled(left, *l_bounds, width, "l"), _leveled(right, *r_bounds, width, "r")
    levels = lambda df, n: df.agg(F.collect_set(f"_{n}_level").alias("_levels"))
    # Of two intervals of one level the left one's bins count.
    x = _binned(a, *l_bounds, width, "l", levels(b, "r"), lambda n, own: n > own)
    y = _binned(b, *r_bounds, width, "r", levels(a, "l"), lambda n, own: n >= own)
    met = x.join(y, [key, "_of", "_level", "_bin"])
    same = F.col("_bin") == F.greatest("_l_first", "_r_first")
    return met.filter(same & (F.col("r_start") <= F.col("l_end") + slack) & (F.col("l_start") - slack <= F.col("r_end"))).drop("_of", "_level", "_bin", "_l_first", "_r_first")


def most_overlap(left: DataFrame, right: DataFrame, key: str, pos: str, value: str, width: float = 30.0) -> DataFrame:
    """Each left row with the value of the right row that it shares most time with, first of equals by ``r_pos``; null if none."""
    shared = F.least("l_end", "r_end") - F.greatest("l_start", "r_start")
    pairs = overlap_pairs(left, right, key, width).withColumn("_o", shared).filter("_o > 0")
    best = pairs.groupBy(key, pos).agg(F.max_by(value, F.struct("_o", -F.col("r_pos"))).alias(value), F.max("_o").alias("overlap"))
    return left.join(best, [key, pos], "left")


def first_container(left: DataFrame, right: DataFrame, key: str, pos: str, value: str, width: float = 30.0) -> DataFrame:
    """Each left row with the value of the first right row that contains it; null if none."""
    pairs = overlap_pairs(left, right, key, width).filter("r_start <= l_start and r_end >= l_end")
    best = pairs.groupBy(key, pos).agg(F.min_by(value, "r_pos").alias(value))
    return left.join(best, [key, pos], "left")


def nearest_point(left: DataFrame, points: DataFrame, key: str, pos: str, value: str, slack: float = 0.5, width: float = 30.0) -> DataFrame:
    """Each left row with the value of the point (r_start) nearest its middle, within ``slack`` of it, first of equals."""
    middle = (F.col("l_start") + F.col("l_end")) / 2
    pairs = overlap_pairs(left, points.withColumn("r_end", F.col("r_start")), key, width, slack)
    best = pairs.groupBy(key, pos).agg(F.min_by(value, F.struct(F.abs(F.col("r_start") - middle), "r_pos")).alias(value))
    return left.join(best, [key, pos], "left")


def nearest_asof(left: DataFrame, points: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """Each left row (l_start) with the value of the last point at or before it or the first after it, whichever is nearer.

    One sort of both sides together; ties go to the one before.
    """
    none = lambda t: F.lit(None).cast(t)
    v_type, p_type = points.schema[value].dataType, left.schema[pos].dataType
    p = points.select(key, F.col("r_start").alias("_t"), F.lit(0).alias("_k"), none(p_type).alias(pos), F.struct(F.col("r_start").alias("t"), F.col(value).alias("v")).alias("_p"), F.col("r_pos").alias("_n"))
    q = left.select(key, F.col("l_start").alias("_t"), F.lit(1).alias("_k"), F.col(pos), F.lit(None).cast(p.schema["_p"].dataType).alias("_p"), F.lit(None).cast(p.schema["_n"].dataType).alias("_n"))
    back = Window.partitionBy(key).orderBy("_t", "_k", "_n").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy("_t", "_k", "_n").rowsBetween(0, Window.unboundedFollowing)
    both = p.unionByName(q).withColumn("_b", F.last("_p", ignorenulls=True).over(back)).withColumn("_a", F.first("_p", ignorenulls=True).over(ahead)).filter("_k = 1")
    nearer = F.when(F.col("_a").isNull() | (F.col("_t") - F.col("_b.t") <= F.col("_a.t") - F.col("_t")), F.col("_b.v")).otherwise(F.col("_a.v"))
    found = both.select(key, pos, F.when(F.col("_b").isNull(), F.col("_a.v")).otherwise(nearer).cast(v_type).alias(value))
    return left.join(found, [key, pos], "left")


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column) -> DataFrame:
    """Adds ``island``: rows count up in it from 0 wherever ``starts`` is true, in order within the keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_new", starts).withColumn("island", F.sum(F.coalesce(F.col("_new"), F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merge_adjacent(df: DataFrame, key: str, gap: float) -> DataFrame:
    """(key, pos, speaker, start, end): runs of one speaker with gaps of at most ``gap`` become one row that ends where the last one does."""
    w = Window.partitionBy(key).orderBy("pos")
    new = (F.lag("speaker").over(w) != F.col("speaker")) | (F.col("start") - F.lag("end").over(w) > gap)
    marked = islands(df, [key], ["pos"], new)
    return marked.groupBy(key, "island").agg(F.first("speaker").alias("speaker"), F.min_by("start", "pos").alias("start"), F.max_by("end", "pos").alias("end"), F.count("*").alias("n"))


def merge_fused(df: DataFrame, key: str, gap: float) -> DataFrame:
    """(key, pos, start, end, speaker, transcript, emotion, flags): neighbours alike in speaker and emotion (null equals null).

    Texts are joined only where both are there: a first text that is null stays null.
    """
    w = Window.partitionBy(key).orderBy("pos")
    first = F.lag("pos").over(w).isNull()
    same = F.lag("speaker").over(w).eqNullSafe(F.col("speaker")) & F.lag("emotion").over(w).eqNullSafe(F.col("emotion")) & (F.col("start") - F.lag("end").over(w) <= gap)
    marked = islands(df, [key], ["pos"], ~first & ~same)
    rows = F.array_sort(F.collect_list(F.struct("pos", "start", "end", "transcript", "flags")))
    out = marked.groupBy(key, "island").agg(F.first("speaker").alias("speaker"), F.first("emotion").alias("emotion"), rows.alias("r"))
    texts = F.array_join(F.filter(F.transform("r", lambda x: x["transcript"]), lambda t: t.isNotNull()), " ")
    return out.select(key, "island", "speaker", "emotion", F.get("r", F.lit(0))["start"].alias("start"), F.element_at("r", -1)["end"].alias("end"), F.when(F.get("r", F.lit(0))["transcript"].isNotNull(), texts).alias("transcript"), F.flatten(F.transform("r", lambda x: x["flags"])).alias("flags"))


def speaker_labels(df: DataFrame, key: str, gap_ms: int = 500, least_ms: int = 500) -> DataFrame:
    """(key, pos, speaker, start_ms, end_ms): a speaker's neighbouring rows merge while they start within the gap of the latest end so far; short labels go."""
    w = Window.partitionBy(key).orderBy("pos")
    runs = islands(df, [key], ["pos"], F.lag("speaker").over(w) != F.col("speaker")).withColumnRenamed("island", "run")
    before = Window.partitionBy(key, "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_upto", F.max("end_ms").over(before))
    marked = islands(runs, [key, "run"], ["pos"], F.col("start_ms") > F.col("_upto") + gap_ms)
    out = marked.groupBy(key, "run", "island").agg(F.first("speaker").alias("speaker"), F.min_by("start_ms", "pos").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return out.filter(F.col("end_ms") - F.col("start_ms") >= least_ms).drop("run", "island")


def evenly(df: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """At most so many rows of each key, at equal steps from the first."""
    pos = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    n = F.count("*").over(Window.partitionBy(key))
    step = F.when(n > most, F.floor(n / most)).otherwise(1)
    return df.withColumn("_p", pos).withColumn("_s", step).filter((F.col("_p") % F.col("_s") == 0) & (F.floor(F.col("_p") / F.col("_s")) < most)).drop("_p", "_s")
