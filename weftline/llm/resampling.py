"""Target-distribution importance resampling by an Aho-Corasick dictionary.

Words are cut at every ASCII character that is no letter or digit; features are runs of 1 to ``runs`` consecutive words. Texts
are scanned in chunks of bounded size: the distinct words of a chunk, each between two delimiters, make an automaton whose
entries carry the word's CRC-32 and length. A scan emits these payloads in order, one for each word, since no delimited word lies
in another; payloads of neighbours are composed (the CRC of a joined text follows from the CRCs and lengths of its parts), so no
run is ever built as a string. A document becomes a sparse histogram of buckets, which is written once and read twice: for the
corpus' counts, and for the scores.

A document's score is the sum of its features' gains plus Gumbel noise from its id; the best are drawn. Ranks are global without
a global task: narrow rows are range-partitioned and sorted, and a row's rank is its place in its range plus the sizes of the
ranges before. What tasks share is a list of ``buckets`` gains, a parameter and not the corpus' size.

Defined results: a null or wordless text has no features and weight 0; a null id draws the noise of an empty one and ranks after
other ids of its score; repeated rows are rows of their own, with ranks beside each other; an empty table gives no rows, an empty
target still gives every bucket its smoothed gain; extra columns, whatever their names, do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import write_table

if TYPE_CHECKING:
    import numpy as np
    import pyarrow as pa


@dataclass(frozen=True)
class Draw:
    runs: int = 1  # words in the longest feature
    buckets: int = 10_000
    percent: int = 10  # of the documents that may be drawn
    least_words: int = 20  # of a document that may be drawn
    seed: int = 2024


#: A-Z in lower case, and a space for every ASCII character that is no letter or digit.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
CHUNK = 2_000_000  # bytes that share a dictionary


def _pieces(texts: list[bytes], most: int) -> Iterator[tuple[int, bytes]]:
    """(place, piece) of every text, with spaces at both ends; a piece ends between words, and is longer than ``most`` for a longer word only."""
    for i, text in enumerate(texts):
        plain, begin = text.translate(_PLAIN), 0
        while len(plain) - begin > most:
            end = plain.rfind(b" ", begin, begin + most)
            end = plain.find(b" ", begin + most) if end <= begin else end
            if end < 0:
                break
            yield i, b" " + plain[begin:end] + b" "
            begin = end
        yield i, b" " + plain[begin:] + b" "


def _scan(pieces: list[bytes]) -> list[np.ndarray]:
    """For each piece its words' payloads in order: the CRC in the lower, the length in the upper half of an integer."""
    import ahocorasick
    import numpy as np

    found = ahocorasick.Automaton()
    for w in set().union(*(p.split() for p in pieces)):
        found.add_word(f" {w.decode('latin-1')} ", zlib.crc32(w) | len(w) << 32)
    if not len(found):
        return [np.array([], np.int64) for _ in pieces]
    found.make_automaton()
    return [np.fromiter((payload for _, payload in found.iter(p.decode("latin-1"))), np.int64) for p in pieces]


def payloads(texts: list[bytes], chunk: int = CHUNK) -> Iterator[np.ndarray]:
    """The payloads of each text's words, in order."""
    import numpy as np

    def scanned() -> Iterator[tuple[int, np.ndarray]]:
        held, size = [], 0
        for i, piece in _pieces(texts, chunk):
            if held and size + len(piece) > chunk:
                yield from zip([k for k, _ in held], _scan([p for _, p in held]), strict=True)
                held, size = [], 0
            held.append((i, piece))
            size += len(piece)
        if held:
            yield from zip([k for k, _ in held], _scan([p for _, p in held]), strict=True)

    at, parts = 0, []
    for i, found in scanned():
        if i != at:
            yield np.concatenate(parts)
            at, parts = i, []
        parts.append(found)
    if parts:
        yield np.concatenate(parts)


def _operators(most: int) -> list[np.ndarray]:
    """For each power of two up to ``most`` a table of what appending so many zero bytes does to a CRC, by its four bytes."""
    import numpy as np

    def table(columns: list[int]) -> np.ndarray:
        """columns: the images of the 32 single bits."""
        out = np.zeros((4, 256), np.uint32)
        for k in range(4):
            for b in range(8):
                out[k, [v for v in range(256) if v >> b & 1]] ^= np.uint32(columns[8 * k + b])
        return out

    one = []
    for b in range(32):  # a zero byte: eight steps of the reflected polynomial
        c = 1 << b
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        one.append(c)
    tables = [table(one)]
    while 2 ** len(tables) <= most:
        bits = np.array([1 << b for b in range(32)], np.uint32)
        tables.append(table([int(x) for x in _apply(tables[-1], _apply(tables[-1], bits))]))
    return tables


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0, crc & 255] ^ table[1, crc >> 8 & 255] ^ table[2, crc >> 16 & 255] ^ table[3, crc >> 24]


def compose(first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs (uint32) of joined texts from those of their parts and the second parts' lengths."""
    import numpy as np

    out = first.astype(np.uint32)
    for k, table in enumerate(_operators(int(lengths.max())) if len(lengths) else []):
        here = (lengths >> k & 1).astype(bool)
        out[here] = _apply(table, out[here])
    return out ^ second.astype(np.uint32)


def features(words: np.ndarray, runs: int) -> np.ndarray:
    """The CRCs of all runs of 1 to ``runs`` consecutive words, joined by one space."""
    import numpy as np

    crc, length = (words & 0xFFFFFFFF).astype(np.uint32), words >> 32
    every, run = [crc], crc
    for k in range(1, min(runs, len(words))):
        spaced = compose(run[:-1], np.full(len(run) - 1, zlib.crc32(b" "), np.uint32), np.ones(len(run) - 1, np.int64))
        run = compose(spaced, crc[k:], length[k:])
        every.append(run)
    return np.concatenate(every)


def counted(docs: DataFrame, draw: Draw, text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, buckets, counts) of every text; the buckets are sorted and distinct."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for begin in range(0, whole.num_rows, 500):  # so that what is held beside a batch stays small
                batch = whole.slice(begin, 500)
                n_words, n_features, buckets, counts = [], [], [], []
                for words in payloads(batch.column("_text").to_pylist()):
                    found = features(words, draw.runs)
                    b, n = np.unique(found % draw.buckets, return_counts=True)
                    n_words.append(len(words))
                    n_features.append(len(found))
                    buckets.append(b.astype(np.int32))
                    counts.append(n.astype(np.int64))
                ends = pa.array(np.cumsum([0, *map(len, buckets)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (buckets, counts)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), *lists], ["doc_id", "n_words", "n_features", "buckets", "counts"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("_text"))
    return source.mapInArrow(rows, "doc_id long, n_words long, n_features long, buckets array<int>, counts array<long>")


def tally(histograms: DataFrame, draw: Draw) -> DataFrame:
    """(bucket, n) over all documents; each task adds up in dense slots first."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        slots = np.zeros(draw.buckets, np.int64)
        for batch in batches:
            np.add.at(slots, batch.column("buckets").flatten().to_numpy(), batch.column("counts").flatten().to_numpy())
        at = np.flatnonzero(slots)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(slots[at])], ["bucket", "n"])

    return histograms.select("buckets", "counts").mapInArrow(rows, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, draw: Draw) -> list[int]:
    """The gain of each bucket from the tallies of corpus and target."""
    spark = corpus.sparkSession
    every = spark.range(draw.buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    rows = both.select("bucket", "s", "t").collect()  # as many as there are buckets
    total_s, total_t = sum(r.s for r in rows), sum(r.t for r in rows)
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = (t + 1) * F.lit(float(total_s + draw.buckets)) / ((s + 1) * F.lit(float(total_t + draw.buckets)))
    found = spark.createDataFrame(rows, both.schema).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect()
    return [r.gain for r in sorted(found)]


def weighed(histograms: DataFrame, gain: list[int]) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the sum of the gains of a document's features."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        by_bucket = np.array(gain, np.int64)
        for batch in batches:
            lists = batch.column("buckets")
            value = np.concatenate([[0], np.cumsum(by_bucket[lists.flatten().to_numpy()] * batch.column("counts").flatten().to_numpy())])
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_words", "n_features")), pa.array((value[ends[1:]] - value[ends[:-1]]).astype(np.int64))], ["doc_id", "n_words", "n_features", "weight"])

    return histograms.mapInArrow(rows, "doc_id long, n_words long, n_features long, weight long")


def scored(weights: DataFrame, draw: Draw) -> DataFrame:
    """Adds ``score``: the weight and Gumbel noise from the id."""
    named = F.concat(F.lit(f"{draw.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    return weights.withColumn("score", F.col("weight") + noise)


def ranked(scores: DataFrame, draw: Draw) -> DataFrame:
    """Adds ``rank``: 1, 2, 3... of the drawn, by score downwards, then id; null for the rest."""
    may = (F.col("n_words") >= draw.least_words).alias("_may")
    order = [F.desc("_may"), F.desc("score"), F.asc_nulls_last("doc_id")]
    dealt = scores.withColumn("_may", may).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = write_table(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranges")  # the range above, the place below bit 33
    placed = placed.withColumns({"_range": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND(F.lit(2**33 - 1))})
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"), F.sum(F.col("_may").cast("long")).alias("_able"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n"))  # a row for each range
    before = before.withColumn("_drawn", F.sum("_able").over(Window.partitionBy()) * draw.percent)
    place = F.col("_before") + F.col("_place") + 1
    rank = F.when(F.col("_may") & (place <= F.expr("_drawn div 100")), place).cast("long")
    return placed.join(write_table(before, "range_sizes"), "_range").withColumn("rank", rank).drop("_may", "_at", "_range", "_place", "_n", "_able", "_before", "_drawn")


def resample(docs: DataFrame, target: DataFrame, draw: Draw = Draw()) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document. target: a table with a column text."""
    histograms = write_table(counted(docs, draw), "histograms")
    wanted = counted(target.select(F.lit(0).alias("doc_id"), "text"), draw)
    gain = gains(tally(histograms, draw), tally(wanted, draw), draw)
    return ranked(scored(weighed(histograms, gain), draw), draw)


def drawn(docs: DataFrame, scores: DataFrame) -> DataFrame:
    """The drawn documents with all their columns."""
    return docs.join(scores.filter("rank is not null").select("doc_id").distinct(), "doc_id", "left_semi")
