"""The data source, the sink, timers, progress, dispatch, windows and sessions, against what batches give."""

import os
import time

import pytest
from pyspark.sql import functions as F

from weftline.functions import routing
from weftline.operators import manifests
from weftline.plans import manifests as plans
from weftline.plans import registry
from weftline.sinks import files
from weftline.sources import captures
from weftline.streaming import live

MASTER = "#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=1280000,RESOLUTION=640x360\nlow.m3u8\n#EXT-X-STREAM-INF:BANDWIDTH=2560000\nhigh.m3u8\n"
MEDIA = "#EXTM3U\n#EXT-X-TARGETDURATION:6\n#EXT-X-MEDIA-SEQUENCE:{n}\n#EXTINF:5.5,\na{n}.ts\n#EXTINF:6,\nb{n}.ts\n"


def put(folder, name, text, at):
    (folder / name).write_text(text)
    os.utime(folder / name, (at, at))


def test_captures(spark, tmp_path):
    captures.register(spark)
    assert spark.read.format("weft_captures").load(str(tmp_path)).count() == 0
    put(tmp_path, "list.txt", "https://a\n\n # note\n https://b \r\nhttps://c", 10)
    put(tmp_path, "master.m3u8", MASTER, 20)
    put(tmp_path, "live.m3u8", MEDIA.format(n=7), 30)
    put(tmp_path, "empty.m3u8", "", 31)
    put(tmp_path, "other.bin", "x", 32)
    put(tmp_path, ".hidden.txt", "https://no", 33)
    df = spark.read.format("weft_captures").option("bytes", 60).load(str(tmp_path))
    assert sorted((os.path.basename(r.file), r.kind) for r in df.collect()) == [("empty.m3u8", "urls"), ("list.txt", "urls"), ("live.m3u8", "segments"), ("master.m3u8", "variants")]
    assert [r.url for r in captures.urls(df).collect()] == ["https://a", "https://b", "https://c"]
    assert [(r.rank, r.bandwidth, r.height, os.path.basename(r.uri)) for r in captures.variants(df).orderBy("rank").collect()] == [(1, 2560000, 0, "high.m3u8"), (2, 1280000, 360, "low.m3u8")]
    assert [(r.sequence, r.duration, os.path.basename(r.uri)) for r in captures.segments(df).orderBy("idx").collect()] == [(7, 5.5, "a7.ts"), (8, 6.0, "b7.ts")]


def test_capture_stream_goes_on(spark, tmp_path):
    """A stopped stream goes on where it stopped; every file is read once."""
    captures.register(spark)
    folder, seen = tmp_path / "in", []
    folder.mkdir()

    def go():
        rows = lambda df, _: seen.extend((r.sequence, os.path.basename(r.file)) for r in captures.segments(df).collect())
        q = spark.readStream.format("weft_captures").load(str(folder)).writeStream.foreachBatch(rows).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    put(folder, "a.m3u8", MEDIA.format(n=1), 10)
    put(folder, "b.m3u8", MEDIA.format(n=5), 10)
    go()
    assert sorted(seen) == [(1, "a.m3u8"), (2, "a.m3u8"), (5, "b.m3u8"), (6, "b.m3u8")]
    seen.clear()
    go()
    assert seen == []
    put(folder, "c.m3u8", MEDIA.format(n=9), 11)
    go()
    assert sorted(seen) == [(9, "c.m3u8"), (10, "c.m3u8")]


def held(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file())


@pytest.mark.parametrize("query", ["subtitle_files", "analysis_reports"])
def test_files_read_back(spark, sf, tmp_path, query):
    files.register(spark)
    df = registry.QUERIES[query](spark, sf)
    text = next(c for c, t in df.dtypes if t == "string" and c not in ("speaker", "kind"))
    named = df.select(F.concat(F.format_string("%05d", F.row_number().over(__import__("pyspark").sql.Window.orderBy(*df.columns))), F.lit(".txt")).alias("name"), F.col(text).alias("text"))
    rows = {r.name: r.text or "" for r in named.collect()}
    named.repartition(3).write.format("weft_files").mode("append").save(str(tmp_path))
    assert held(tmp_path) == sorted(rows) and all((tmp_path / n).read_bytes().decode() == t for n, t in rows.items()) and len(rows) > 5


def test_failed_tasks_leave_no_file(spark, tmp_path):
    files.register(spark)
    put(tmp_path, "old.srt", "old", 5)
    rows = spark.range(40).repartition(4).selectExpr("concat('f', id, '.srt') as name", "if(id = 33, raise_error('lost'), cast(id as string)) as text")
    with pytest.raises(Exception, match="lost"):
        rows.write.format("weft_files").mode("append").save(str(tmp_path))
    assert held(tmp_path) == ["old.srt"]
    for name in ("../x", "a/b", "", None, "_x"):
        with pytest.raises(Exception, match="no name of a file"):
            spark.createDataFrame([("ok.srt", "1"), (name, "2")], "name string, text string").coalesce(1).write.format("weft_files").mode("append").save(str(tmp_path))
    twice = spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "3")], "name string, text string")
    with pytest.raises(Exception, match="two rows are named"):
        twice.repartition(3).write.format("weft_files").mode("append").save(str(tmp_path))
    assert held(tmp_path) == ["old.srt"]
    spark.createDataFrame([("new.srt", None)], "name string, text string").write.format("weft_files").mode("overwrite").save(str(tmp_path))
    assert held(tmp_path) == ["new.srt"] and (tmp_path / "new.srt").read_text() == ""


def test_files_of_a_stream(spark, tmp_path):
    files.register(spark)
    (tmp_path / "out").mkdir()
    spark.range(6).selectExpr("concat(id, '.md') as name", "cast(id * 2 as string) as text").repartition(3).write.parquet(str(tmp_path / "in"))
    q = spark.readStream.schema("name string, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).writeStream.format("weft_files").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {n: (tmp_path / "out" / n).read_text() for n in held(tmp_path / "out")} == {f"{i}.md": str(2 * i) for i in range(6)}


def test_silent_key_ends(spark, tmp_path):
    """A key that is not polled ends by its timer and begins again later; one that is followed for its time ends and stays so."""
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    live.use_rocksdb(spark)
    folder, schema = str(tmp_path / "in"), "key string, sequence long, poll long"
    try:
        add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        add([("k", 1, 0), ("k", 2, 0), ("k", 0, 0)])
        def start(name, **limits):
            df = live.follow_by_time(spark.readStream.schema(schema).parquet(folder), "key", **limits)
            return df.writeStream.format("memory").queryName(name).outputMode("append").trigger(processingTime="500 milliseconds").option("checkpointLocation", str(tmp_path / name)).start()

        def until(q, name, what, n):
            for _ in range(120):
                rows = [tuple(r) for r in spark.table(name).collect()]
                if sum(r[3] == what for r in rows) >= n:
                    return rows
                assert q.exception() is None, q.exception()
                time.sleep(0.5)
            raise AssertionError(rows)

        q, capped = start("timed", silence_ms=3000), start("capped", silence_ms=60_000, most_ms=3000)
        assert sorted(until(q, "timed", "silent", 1), key=repr) == [("k", 1, 0, None), ("k", 2, 0, None), ("k", None, None, "silent")]
        until(capped, "capped", "time", 1)
        add([("k", 2, 1), ("k", 9, 1)])  # its state is gone: 2 is new again
        assert sum(r in (("k", 2, 1, None), ("k", 9, 1, None)) for r in until(q, "timed", "silent", 2)) == 2
        assert sorted(map(tuple, spark.table("capped").collect()), key=repr) == [("k", 1, 0, None), ("k", 2, 0, None), ("k", None, None, "time")]
        q.stop()
        capped.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)


def test_progress_totals(spark, sf, tmp_path):
    """A run's totals, told batch by batch, are those that download_progress ends with."""
    parts = manifests.first_seconds(manifests.segments(plans.media(spark, sf), "s_suppkey"), 33.0).withColumn("size", (F.col("idx") * 100 + 7).cast("long"))
    parts.select("s_suppkey", "idx", "size").repartition(4).write.parquet(str(tmp_path / "in"))
    told, listener = [], None
    listener = live.Progress(lambda name, n_bytes, n_parts: told.append((name, n_bytes, n_parts)))
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("s_suppkey long, idx long, size long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = live.observed(stream, "size").writeStream.format("noop").queryName("run").option("checkpointLocation", str(tmp_path / "at")).start()
        q.processAllAvailable()
        q.stop()
        last = registry.QUERIES["download_progress"](spark, sf).groupBy("s_suppkey").agg(F.max("bytes_done").alias("b"), F.max("parts_done").alias("n")).agg(F.sum("b"), F.sum("n")).first()
        for _ in range(100):
            if told and told[-1][1:] == tuple(last):
                break
            time.sleep(0.2)
        assert told[-1] == ("run", *last) and len(told) == 4 and [x[2] for x in told] == sorted(x[2] for x in told)
    finally:
        spark.streams.removeListener(listener)


def run(stream, name, spark):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_windows_and_sessions_of_streams(spark, sf, tmp_path):
    """Streams give the windows and sessions that have closed, as batches count them."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("ts", "event_type", "user_id")
    last = events.agg(F.max("ts")).first()[0]
    events.coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    # Two late marks, so that the watermark moves behind all that is real.
    for k, days in enumerate((30, 60)):
        spark.createDataFrame([(last, "mark", -1)], events.schema).withColumn("ts", F.col("ts") + F.expr(f"interval {days} days")).coalesce(1).write.parquet(str(tmp_path / "in" / "bc"[k]))
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = run(live.windowed_counts(stream(), "ts", "event_type", "1 hour"), "hours", spark).filter("event_type <> 'mark'")
    want = live.windowed_counts(events, "ts", "event_type", "1 hour")
    assert want.count() > 10 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    got = run(live.sessions(stream(), "ts", "user_id", "2 hours"), "visits", spark).filter("user_id >= 0")
    want = live.sessions(events, "ts", "user_id", "2 hours")
    assert want.count() > 10 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_dispatch(spark):
    def shout(bodies):
        assert all(b.startswith("s") for b in bodies), "sees its own rows only"
        if "sbad" in bodies:
            raise RuntimeError("bad body")
        return [b.upper() for b in bodies]

    own = [routing.Handler("shout", ("text/shout",), batch=shout), routing.Handler("few", ("text/few",), batch=lambda b: []), routing.Handler("deep", ("text/deep",), batch=lambda b: [x * 2 for x in b]), routing.Handler("col", ("text/col",), column=lambda b, t: F.nullif(F.reverse(b), F.lit("")))]
    rows = [("s1", "text/shout"), ("sbad", "Text/Shout; q=1"), ("s2", "text/shout"), ("x", "text/few"), ("ab", "text/deep"), ("ab", "text/col"), ("", "text/col"), (None, "text/shout"), ("<html>", None), ("p", None)]
    got = spark.createDataFrame(rows, "b string, t string").coalesce(1).select(routing.dispatched(F.col("b"), F.col("t"), own).alias("d")).select("d.*").collect()
    assert [tuple(r) for r in got] == [("shout", "S1", None), ("shout", None, "RuntimeError: bad body"), ("shout", "S2", None), ("few", None, "ValueError: 0 texts of 1 bodies"), ("deep", "abab", None), ("col", "ba", None), ("col", None, "col: no result"), (None, None, None), ("html", None, None), ("plain", None, None)]
