"""Mixing sources to target weights.

Every row gets a hash-random key; a source's key range is cut into equal ranges of about ``rows_per_range`` rows, whose
token counts are summed and run into prefix sums, first over blocks of ranges, then over the ranges of the cut's block. That
places a source's cut in one range; whole epochs and the ranges
before the cut are taken whole, and only the range with the cut is sorted by row, up to the exact budget. So no source
is ever sorted in one task, however large. A row at the cut is taken in part, by words from its start.

Defined results: null texts have no words; a null source is a source, last in order; rows with equal keys are ordered
by id and size, and rows alike in all three may share a cut either way; a source without words takes nothing; an empty
table gives no rows; extra columns are passed on by ``mix``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import WORD_SEPARATORS, words_of, write_table


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (1, 2, 3)  # repeating, by the sources' order
    share: float = 1.0  # of all words
    most: int = 3  # times its size that a source may give
    seed: int = 17
    rows_per_range: int = 1000
    ranges_per_block: int = 1000


def with_sizes(docs: DataFrame, mix: Mix = Mix(), text: str = "text") -> DataFrame:
    """Adds ``size`` (words) and ``_key`` (60 random bits from the seed, the id and the text, above three of zero)."""
    told = F.concat_ws(":", F.lit(str(mix.seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit(""))))
    key = F.shiftleft(F.conv(F.substring(F.md5(told), 1, 15), 16, 10).cast("long"), 3)
    return docs.withColumn("size", F.size(words_of(F.col(text))).cast("long")).withColumn("_key", key)


def targets(sources: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(source, source_size, n_rows) with ``rank`` and ``target``: shares by weight, at most so many times the source's size.

    Sources whose limit for each unit of weight is least are full first; what they leave is shared by the others'
    weights. Running sums in that order find the full ones. One row per source stands in the mix's own list, so this is
    one small task whatever the corpus holds.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, mix.weights)), ((F.col("rank") - 1) % len(mix.weights) + 1).cast("int"))
    ranked = sources.withColumn("rank", F.row_number().over(by_name)).withColumn("w", w)
    limit = F.col("source_size") * mix.most
    every = Window.partitionBy()
    fill = every.orderBy(limit / F.col("w"), "rank")
    goal = (F.sum("source_size").over(every) * mix.share).cast("double")
    run = ranked.withColumns({"_goal": goal, "_full": F.coalesce(F.sum(limit).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_w": F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing))})
    # A source is full if sharing among it and all later ones would give it its limit or more.
    run = run.withColumn("_is_full", (F.col("_goal") - F.col("_full")) * F.col("w") > limit.cast("double") * F.col("_w"))
    left = F.col("_goal") - F.coalesce(F.sum(F.when(F.col("_is_full"), limit)).over(every), F.lit(0))
    open_w = F.sum(F.when(~F.col("_is_full"), F.col("w"))).over(every)
    target = F.when(F.col("_is_full"), limit.cast("double")).when(open_w > 0, left * F.col("w") / open_w).otherwise(F.lit(0.0))
    return run.withColumn("target", target).select("source", "source_size", "n_rows", "rank", "target")


def _range(n: Column) -> Column:
    """The key's range of n: by its upper 31 bits."""
    return F.shiftright(F.shiftright("_key", 32) * n, 31)


def plan(sized: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """A written table with a row for each source: target, whole epochs, and the range and remainder of the last one's cut."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    goals = targets(sources, mix).withColumn("budget", F.floor("target").cast("long"))
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("int")
    goals = goals.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    goals = write_table(goals.withColumn("n_ranges", F.ceil(F.col("n_rows") / mix.rows_per_range).cast("long")), "goals")
    slim = goals.select(F.col("source").alias("_s"), "rank", "n_ranges")
    ranges = sized.join(slim, F.col("source").eqNullSafe(F.col("_s"))).groupBy("rank", _range(F.col("n_ranges")).alias("range")).agg(F.sum("size").alias("n"))
    ranges = write_table(ranges.withColumn("block", F.expr(f"range div {mix.ranges_per_block}")), "ranges")

    def held(parts: DataFrame, by: str) -> DataFrame:
        """Of each source the part with the cut: the one in which the remainder, counted from the first part's start, ends."""
        run = parts.withColumn("upto", F.sum("n").over(Window.partitionBy("rank").orderBy(by))).withColumn("before", F.col("upto") - F.col("n"))
        return run.filter("before <= rest and rest < upto")

    blocks = held(ranges.groupBy("rank", "block").agg(F.sum("n").alias("n")).join(goals.select("rank", "rest"), "rank"), "block")
    near = ranges.join(blocks.select("rank", "block", F.col("before").alias("_ahead"), (F.col("rest") - F.col("before")).alias("rest")), ["rank", "block"])
    at = held(near, "range").select("rank", F.col("range").alias("cut"), (F.col("_ahead") + F.col("before")).alias("before"))
    # A remainder of nothing, or a source without words, has no cut: everything lies behind it.
    done = goals.join(at, "rank", "left").withColumns({"cut": F.coalesce("cut", F.lit(-1)), "before": F.coalesce("before", F.lit(0))})
    return write_table(done, "plan")


def decide(sized: DataFrame, plans: DataFrame) -> DataFrame:
    """Adds source_size, target and ``taken``: the words of each row that the mix takes, repeats counted."""
    slim = plans.select(F.col("source").alias("_s"), "source_size", "target", "epochs", "rest", "n_ranges", "cut", "before", "rank")
    placed = sized.join(slim, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_range", _range(F.col("n_ranges")))
    far = placed.filter("_range <> cut").withColumn("taken", F.col("size") * (F.col("epochs") + (F.col("_range") < F.col("cut")).cast("int")))
    ordered = Window.partitionBy("rank").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.filter("_range = cut").withColumn("_start", F.col("before") + F.sum("size").over(ordered) - F.col("size"))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("_start")))
    edge = edge.withColumn("taken", F.col("size") * F.col("epochs") + last).drop("_start")
    return far.unionByName(edge).drop("_s", "_range", "_key", "rest", "n_ranges", "cut", "before", "rank")


def assign(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """A narrow row for each document: doc_id, source, size, source_size, target, epochs, taken."""
    sized = write_table(with_sizes(docs.select("doc_id", "source", "text"), mix).drop("text"), "sizes")
    return decide(sized, plan(sized, mix))


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word, spaces kept: pieces end where a word ends."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, F.lit(1), n), "")


def mix(docs: DataFrame, config: Mix = Mix()) -> DataFrame:
    """The mixed documents, with their own columns: a row for each whole take, and one for a part at a cut.

    Only the rows of the cut ranges are shuffled with their texts.
    """
    columns = docs.columns
    bare = docs.select(F.struct(*columns).alias("_doc"), "doc_id", "source", "text")
    plans = plan(write_table(with_sizes(bare.select("doc_id", "source", "text"), config).drop("text"), "sizes"), config)
    taken = decide(with_sizes(bare, config), plans)
    part = F.when(F.col("size") > 0, F.col("taken") % F.greatest("size", F.lit(1))).otherwise(F.lit(0))
    # A text without words weighs nothing; it comes once, so that a mix loses no row for being empty.
    whole = F.when(F.col("size") > 0, F.expr("taken div greatest(size, 1)")).otherwise(F.lit(1))
    takes = F.concat(F.array_repeat(F.lit(0).cast("long"), whole.cast("int")), F.when(part > 0, F.array(part.cast("long"))).otherwise(F.array().cast("array<long>")))
    rows = taken.select("_doc", F.explode(takes).alias("_n"))
    text = F.when(F.col("_n") > 0, first_words(F.col("_doc.text"), F.col("_n").cast("int"))).otherwise(F.col("_doc.text"))
    out = {c: F.col(f"_doc.`{c}`") for c in columns} | {"text": text}
    if "n_chars" in columns:
        out["n_chars"] = F.when(F.col("_n") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_doc.n_chars"))
    return rows.select(*[out[c].alias(c) for c in columns])
