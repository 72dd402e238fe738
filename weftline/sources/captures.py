"""Captured files (lists of urls, master and media playlists) as a data source, for batches and for streams.

``spark.read.format("weft_captures").load(folder)`` gives (file, modified, kind, body), a row for each file; the functions below
make urls, streams and parts of them by native operators. A folder may be in any store that Arrow's file systems open. Files are
dealt to tasks by size; bodies are read in the tasks.

A stream goes by (modified, file): an offset is the last pair that was read, so a query that is stopped and started from its
checkpoint goes on behind it. A file that comes later with an earlier time than the offset is not seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators import manifests, responses
from .stores import opened

SCHEMA = "file string, modified timestamp, kind string, body string"


class Files(InputPartition):
    def __init__(self, files: list[tuple[int, str]]) -> None:
        self.files = files  # modified, in nanoseconds, and path


def kind_of(body: str) -> str:
    if not body.lstrip("﻿ \r\n").startswith("#EXTM3U"):
        return "urls"
    return "variants" if "#EXT-X-STREAM-INF:" in body else "segments"


class _Folder:
    """options: path, pattern (of file names, a regular expression), bytes (that a task reads, about)."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.pattern = options.get("pattern", r".*\.(m3u8?|txt)")
        self.most = int(options.get("bytes", 64_000_000))

    def listed(self) -> list[tuple[int, str, int]]:
        """(modified, path, size) in order. Hidden files and those being written are left out."""
        from pyarrow.fs import FileSelector, FileType

        fs, path = opened(self.path)
        every = [x for x in fs.get_file_info(FileSelector(path, recursive=True)) if x.type == FileType.File and x.base_name[0] not in "._" and "/_" not in x.path[len(path) :]]
        return sorted((x.mtime_ns or 0, x.path, x.size or 0) for x in every if re.fullmatch(self.pattern, x.base_name))

    def dealt(self, files: list[tuple[int, str, int]]) -> list[Files]:
        parts, held, size = [], [], 0
        for modified, path, n in files:
            if held and size + n > self.most:
                parts.append(Files(held))
                held, size = [], 0
            held.append((modified, path))
            size += n
        return [*parts, Files(held)] if held else parts

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, _ = opened(self.path)
        for modified, path in partition.files:
            with fs.open_input_stream(path) as f:
                body = f.read().decode("utf-8", "replace")
            yield path, datetime.fromtimestamp(modified / 1e9, UTC), kind_of(body), body


class _Reader(_Folder, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self.dealt(self.listed()) or [Files([])]


class _StreamReader(_Folder, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"modified": -1, "file": ""}

    def latestOffset(self) -> dict:
        files = self.listed()
        return {"modified": files[-1][0], "file": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        after, upto = ((x["modified"], x["file"]) for x in (start, end))
        return self.dealt([x for x in self.listed() if after < x[:2] <= upto])

    def commit(self, end: dict) -> None:
        pass


class Captures(DataSource):
    @classmethod
    def name(cls) -> str:
        return "weft_captures"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Captures)


def urls(captures: DataFrame) -> DataFrame:
    """(file, url) of lists; empty lines and notes are left out."""
    lines = captures.filter("kind = 'urls'").select("file", F.explode(F.split("body", "\r\n?|\n")).alias("line"))
    return responses.urls_of(lines, "line").select("file", "url")


def variants(captures: DataFrame, base: str = "file") -> DataFrame:
    """The streams of master playlists, by file; addresses are resolved against column ``base``. A batch's rows (windows are ordered)."""
    return manifests.variants(captures.filter("kind = 'variants'"), "file", base, "body")


def segments(captures: DataFrame, base: str = "file") -> DataFrame:
    """The parts of media playlists, likewise."""
    return manifests.segments(captures.filter("kind = 'segments'"), "file", base, "body")
