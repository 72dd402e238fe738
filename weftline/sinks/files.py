"""A sink that writes one file for each row: subtitles, reports and results by name.

``df.select("name", "text").write.format("weft_files").mode("append").save(folder)`` writes each text to the file that the row
names. A task writes beside the folder's files; they get their names when all tasks have ended, and those of a failed task or job
go. A name that two rows have, or that leads out of the folder, is an error of the job. Streams write likewise, batch by batch;
a batch that is written again replaces its own files.

Null texts are empty files; a null or empty name is an error. ``overwrite`` removes the files that the folder has.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from ..sources.stores import opened

HELD = "_unfinished"


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class _Files:
    def __init__(self, path: str, overwrite: bool = False) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Written:
        fs, root = opened(self.path)
        folder, names = f"{root}/{HELD}/{self.job}/{uuid.uuid4().hex}", []
        fs.create_dir(folder, recursive=True)
        try:
            for row in rows:
                name = row["name"]
                if not name or name.startswith((".", "_")) or "/" in name or "\\" in name:
                    raise ValueError(f"no name of a file: {name!r}")
                if name in names[-1:]:
                    raise ValueError(f"two rows are named {name!r}")
                with fs.open_output_stream(f"{folder}/{name}") as f:
                    f.write((row["text"] or "").encode())
                names.append(name)
        except BaseException:
            fs.delete_dir(folder)
            raise
        return Written(folder, names)

    def settle(self, messages: list[Written | None]) -> None:
        """Gives the files their names."""
        from pyarrow.fs import FileSelector, FileType

        fs, root = opened(self.path)
        told = [m for m in messages if m]
        twice = [n for n, k in Counter(n for m in told for n in m.names).items() if k > 1]
        if twice:
            raise ValueError(f"two rows are named {min(twice)!r}")
        if self.overwrite:
            for x in fs.get_file_info(FileSelector(root)):
                if x.type == FileType.File:
                    fs.delete_file(x.path)
        for m in told:
            for n in m.names:
                fs.move(f"{m.folder}/{n}", f"{root}/{n}")
        self.clear()

    def clear(self) -> None:
        from pyarrow.fs import FileSelector, FileType

        fs, root = opened(self.path)
        held = f"{root}/{HELD}"
        if fs.get_file_info(f"{held}/{self.job}").type == FileType.Directory:
            fs.delete_dir(f"{held}/{self.job}")
        if fs.get_file_info(held).type == FileType.Directory and not fs.get_file_info(FileSelector(held)):
            fs.delete_dir(held)


class _Writer(_Files, DataSourceWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self.settle(messages)

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()


class _StreamWriter(_Files, DataSourceStreamWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.settle(messages)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.clear()


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return "weft_files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)

    def streamWriter(self, schema, overwrite: bool) -> _StreamWriter:
        return _StreamWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Files)
