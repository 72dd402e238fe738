"""Helpers shared by the corpus operators: the shared folder, written tables, word splitting."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regex of what separates words: space, tab, line feed, vertical tab, form feed, return.
WORD_SEPARATORS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir``. Where it is unset, a local session makes one; any other is refused,
    since its executors would each write to a disk of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_written: list[str] = []
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    _written.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more: whatever is made of them must have been written itself."""
    for df in tables:
        if path := _paths.pop(df, None):
            _written.remove(path)
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def clear_tables(spark: SparkSession) -> None:
    """Delete the tables written so far by this process. Results that still read them must have been saved before."""
    while _written:
        _delete(spark, _written.pop())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sample_rows(df: DataFrame, n: int) -> DataFrame:
    """At most n rows, those with the least hashes of all their columns. Rows beyond a bound that leaves half as many again go
    first, where they are read, so that no task gets more than about that from all others."""
    total = df.count()
    h = F.shiftrightunsigned(F.xxhash64(*df.columns), 1)
    if total > 2 * n:
        df = df.filter(h <= F.lit(int(2**63 * min(1.0, 1.5 * n / total)) - 1))
    return df.orderBy(h).limit(n)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, for use inside higher-order functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text, as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_SEPARATORS), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
