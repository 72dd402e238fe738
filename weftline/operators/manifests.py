"""Streaming manifests as tables, and the choice and limits of what they list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U


def _lines(body: Column) -> Column:
    return F.split(F.regexp_replace(body, "\r\n?", "\n"), "\n")


def attributes(text: Column) -> Column:
    """``K=V,K="a,b"`` as a map; of a repeated key the last counts."""
    keys = F.transform(F.regexp_extract_all(text, F.lit(r'([^=,]+)=("[^"]*"|[^,]*)'), F.lit(1)), F.trim)
    values = F.transform(F.regexp_extract_all(text, F.lit(r'([^=,]+)=("[^"]*"|[^,]*)'), F.lit(2)), lambda v: F.trim(F.replace(v, F.lit('"'), F.lit(""))))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.filter(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i"))), lambda p: p["i"] == F.size(keys) - F.array_position(F.reverse(keys), p["k"]).cast("int"))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))


INF = "#EXT-X-STREAM-INF:"


def variants(playlists: DataFrame, key: str, url: str = "url", body: str = "body") -> DataFrame:
    """(key, rank, bandwidth, height, codecs, uri): the streams of master playlists, widest first.

    The line after a stream's attributes is its address; a comment there loses the stream.
    """
    zero = F.struct(F.lit(None).cast("string").alias("open"), F.array().cast("array<struct<attrs:string,uri:string>>").alias("found"))

    def step(acc: Column, line: Column) -> Column:
        took = F.when(F.startswith(line, F.lit("#")), acc["found"]).otherwise(F.concat(acc["found"], F.array(F.struct(acc["open"].alias("attrs"), line.alias("uri")))))
        closed = F.struct(F.lit(None).cast("string").alias("open"), took.alias("found"))
        opened = F.struct(F.substr(line, F.lit(len(INF) + 1)).alias("open"), acc["found"].alias("found"))
        return F.when(acc["open"].isNotNull(), closed).when(F.startswith(line, F.lit(INF)), opened).otherwise(acc)

    rows = playlists.select(key, url, F.posexplode(F.aggregate(_lines(F.col(body)), zero, step, lambda a: a["found"])).alias("pos", "v"))
    a = attributes(F.col("v.attrs"))
    rows = rows.select(key, "pos", F.coalesce(F.try_element_at(a, F.lit("BANDWIDTH")).try_cast("long"), F.lit(0)).alias("bandwidth"), F.coalesce(F.get(F.split(F.try_element_at(a, F.lit("RESOLUTION")), "x"), F.lit(1)).try_cast("int"), F.lit(0)).alias("height"), F.try_element_at(a, F.lit("CODECS")).alias("codecs"), U.resolve_playlist(F.col(url), F.col("v.uri")).alias("uri"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("bandwidth"), "pos"))).drop("pos")


def choose(streams: DataFrame, key: str, quality: str, height: int | None = None) -> DataFrame:
    """One stream of each playlist: ``best``, ``worst``, or that nearest a height (of two the wider)."""
    order = {"best": [F.col("rank")], "worst": [F.desc("rank")], "height": [F.abs(F.col("height") - F.lit(height or 0)), F.col("rank")]}[quality]
    return streams.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def segments(playlists: DataFrame, key: str, url: str = "url", body: str = "body") -> DataFrame:
    """(key, sequence, duration, uri, is_live, target_duration, idx): the parts of media playlists.

    Durations and the first sequence number hold from their lines on; a duration that is no number is the target so far.
    """
    rows = playlists.select(key, url, F.contains(F.col(body), F.lit("\n#EXT-X-ENDLIST")).alias("ended"), F.posexplode(_lines(F.col(body))).alias("pos", "line"))
    tag = lambda name: F.when(F.startswith("line", F.lit(name)), F.substr(F.col("line"), F.lit(len(name) + 1)))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    so_far = lambda value, default: F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(default))
    number = lambda name, kind, default: F.when(tag(name).isNotNull(), F.coalesce(tag(name).try_cast(kind), F.lit(default)))
    rows = rows.withColumns({"first": so_far(number("#EXT-X-MEDIA-SEQUENCE:", "long", 0), 0), "target_duration": so_far(number("#EXT-X-TARGETDURATION:", "double", 10.0), 10.0)})
    inf = tag("#EXTINF:")
    duration = F.when(inf.isNotNull(), F.coalesce(F.split_part(inf, F.lit(","), F.lit(1)).try_cast("double"), F.col("target_duration")))
    rows = rows.withColumn("duration", so_far(duration, 0.0)).filter(~F.startswith("line", F.lit("#")) & (F.col("line") != ""))
    idx = F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1
    rows = rows.withColumn("idx", idx)
    return rows.select(key, "idx", (F.col("first") + F.col("idx")).alias("sequence"), "duration", U.resolve_playlist(F.col(url), F.col("line")).alias("uri"), (~F.col("ended")).alias("is_live"), "target_duration")


def first_seconds(parts: DataFrame, seconds: float) -> DataFrame:
    """The leading parts that cover a duration, counted by the target, not the real, durations."""
    return parts.filter(F.col("idx") < F.ceil(F.lit(seconds) / F.col("target_duration")))


def progress(parts: DataFrame, key: str, size: str) -> DataFrame:
    """Adds running totals of bytes and parts."""
    w = Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumns({"bytes_done": F.sum(size).over(w), "parts_done": F.count("*").over(w)})


def newly_seen(polls: DataFrame, key: str, order: list[str], sequence: str = "sequence") -> DataFrame:
    """Rows whose sequence is above all before it, counted from 0: late, repeated and zero sequences are dropped."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return polls.withColumn("_top", F.coalesce(F.max(sequence).over(w), F.lit(0))).filter(F.col(sequence) > F.greatest(F.lit(0), F.col("_top"))).drop("_top")


def until_stopped(polls: DataFrame, key: str, poll: str, at: str, is_live: str, seconds: float | None = None) -> DataFrame:
    """Rows of the polls that are made before a followed playlist stops: the first that ends it is the last, and none begins at or
    after ``seconds`` since the start (column at). All rows of a poll share its time and state; equal polls stand or fall together."""
    before = Window.partitionBy(key).orderBy(poll).rangeBetween(Window.unboundedPreceding, -1)
    kept = polls.withColumn("_ended", F.coalesce(F.max(~F.col(is_live)).over(before), F.lit(False))).filter("not _ended").drop("_ended")
    return kept if seconds is None else kept.filter(F.col(at) < seconds)
