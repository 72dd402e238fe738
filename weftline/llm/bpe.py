"""Byte-level BPE by a global shuffle of distinct words.

Texts are split into pre-tokens in chunks of a few megabytes. A chunk emits each of its distinct pre-tokens once, dealt
to shards by a hash of the word, and for each text the positions' codes in the chunk's own list of words. A shard gets
the words of all chunks, encodes each distinct one once, and answers every chunk with the ids of its words; the answers
join the chunk's texts, which are put together by position. So what is shuffled follows the distinct words of chunks
and a compressed code for each position, never a row for each position, and a word that every text holds comes once for
each chunk. Words and codes travel packed: a chunk has a row for each shard, not for each word.

Shards follow the input's characters, so that a shard's dictionary stays small, and are at most ``Shards.most``, so that a chunk has no more
rows and bytes however large the input. Where a shard would get the words of more than ``Shards.part_chars`` characters, its chunks are dealt to several
tasks, each of which encodes a distinct word once: up to 10^12 characters every word is encoded once in all, beyond that once for each such part.

A chunk is named by a digest of its place in the input and of what it holds, so that copies, however many, are chunks of
their own. If the input's rows came in other order or partitions when they are read for the second time, the names would differ, and encoding stops with an error instead of mixing chunks up: pass a table at rest.

Decoding gathers from the token-byte table (as many rows as the vocabulary, sent to the tasks). Where ids and bytes are wanted, a chunk is decoded in the
task that puts it together. A task holds the texts of one chunk at a time, beside the batch that Spark sent.

Defined results: a null text is an empty one, with no ids; repeated rows each get their ids; very long texts are chunks
of their own; an empty table gives no rows; the columns named in ``keep`` are passed on, whatever their names.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType


@dataclass(frozen=True)
class Vocabulary:
    """A rank file's content (some 50,000 lines: a fixed bound) and the pattern of pre-tokens; read once, by the driver."""

    lines: bytes = field(repr=False)
    pattern: str

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls(f.read(), pattern)

    def ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in self.lines.splitlines() if x)}


@lru_cache(maxsize=2)
def _encoder(vocabulary: Vocabulary):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks(), special_tokens={})


PLAIN = 0x250  # code points below are Latin
KNOWN = 2_000_000  # words that a task keeps the ids of
PART = 1 << 16  # slices that are put together at once


@lru_cache(maxsize=2)
def _pieces(pattern: str):
    """A function from a text to its pre-tokens.

    Latin texts go through the standard library's matcher, several times faster, with the pattern's classes of letters,
    numbers and white space written out for those code points; all others go through ``regex``.
    """
    import regex

    full = regex.compile(pattern).findall

    def members(name: str) -> str:
        is_in = regex.compile(name).match
        return "".join(f"\\u{i:04x}" for i in range(PLAIN) if is_in(chr(i)))

    letters, numbers, spaces = members(r"\p{L}"), members(r"\p{N}"), members(r"\s")
    mixed = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]")
    plain = re.compile(mixed.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]")).findall
    top = chr(PLAIN)

    def find(text: str) -> list[str]:
        return plain(text) if not text or max(text) < top else full(text)

    return find


@lru_cache(maxsize=2)
def _byte_table(vocabulary: Vocabulary):
    """The tokens' bytes in one array, and each id's start and length in it."""
    import numpy as np

    ranks = vocabulary.ranks()
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    sizes = np.array([len(t) for t in tokens], dtype=np.int64)
    return np.frombuffer(b"".join(tokens), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes


def _pack(values) -> bytes:
    """Whole numbers below 2**32, byte by byte in planes, compressed."""
    import numpy as np
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.asarray(values, dtype="<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(packed: bytes):
    import numpy as np
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def _gather(flat, starts, sizes, which):
    """The slices of ``flat`` that ``which`` names, one after the other; put together in parts, so that a long text takes little more than its result."""
    import numpy as np

    parts = []
    for i in range(0, len(which), PART):
        at = which[i : i + PART]
        n = sizes[at]
        ends = np.cumsum(n)
        parts.append(flat[np.arange(int(ends[-1])) + np.repeat(starts[at] - (ends - n), n)])
    return parts[0] if len(parts) == 1 else np.concatenate([flat[:0], *parts])


def _chunks(batches: Iterator, size: int) -> Iterator[tuple]:
    """(batch, first row, last row, place, texts) for parts of Arrow batches that hold about ``size`` characters; the place is the
    part's number in its partition, and the partition's."""
    from pyspark import TaskContext

    task, n = TaskContext.get(), 0
    for batch in batches:
        begin, held, texts = 0, 0, []
        for i, x in enumerate(batch.column("_text")):  # one by one, since a batch may hold many chunks
            texts.append(x.as_py() or "")
            held += len(texts[-1])
            if held >= size or i == len(batch) - 1:
                yield batch, begin, i + 1, (task.partitionId() if task else 0, n), texts
                begin, held, n, texts = i + 1, 0, n + 1, []


def _coded(texts: list[str], place: tuple[int, int], pattern: str, keep: bool) -> tuple[bytes, dict[str, int], list]:
    """The chunk's name, its words by code in the order of their first place, and, if kept, the codes of each text's positions."""
    import numpy as np
    from xxhash import xxh3_128

    name, codes, placed, find = xxh3_128(b"%d %d " % place), {}, [], _pieces(pattern)
    for x in texts:
        raw = x.encode()
        name.update(len(raw).to_bytes(8, "little") + raw)
        pieces = find(x)
        for w in dict.fromkeys(pieces):
            codes.setdefault(w, len(codes))
        if keep:
            placed.append(np.fromiter(map(codes.__getitem__, pieces), np.uint32, len(pieces)))
    return name.digest(), codes, placed


def _word_rows(batches: Iterator, pattern: str, size: int, shards: int, parts: int = 1) -> Iterator:
    """(shard, chunk, codes, sizes, words) for the words that each chunk has for each shard; a chunk belongs to one part of all shards."""
    import pyarrow as pa
    import zstandard

    zip_words = zstandard.ZstdCompressor(level=3).compress
    for *_, place, texts in _chunks(batches, size):
        name, codes, _ = _coded(texts, place, pattern, False)
        dealt: dict[int, tuple[list, list]] = {}
        for w, c in codes.items():
            raw = w.encode()
            own = dealt.setdefault(zlib.crc32(raw) % shards, ([], []))
            own[0].append(c)
            own[1].append(raw)
        first = shards * (int.from_bytes(name[:4], "little") % parts)
        rows = [(first + i, name, _pack(c), _pack([len(x) for x in w]), zip_words(b"".join(w))) for i, (c, w) in dealt.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 5))], names=["shard", "chunk", "codes", "sizes", "words"])


def _answers(batches: Iterator, vocabulary: Vocabulary) -> Iterator:
    """(chunk, codes, sizes, ids) for each row of words; rows come sorted by shard, and a word is encoded once in its shard, unless that has
    more words than a task should keep."""
    import pyarrow as pa
    import zstandard

    encode_word, unzip = _encoder(vocabulary).encode_ordinary, zstandard.ZstdDecompressor().decompress
    last, known = None, {}
    for batch in batches:
        sizes_out, ids_out = [], []
        for shard, sizes, words in zip(*(batch.column(c).to_pylist() for c in ("shard", "sizes", "words")), strict=True):
            if shard != last or len(known) > KNOWN:
                last, known = shard, {}
            raw, at, flat, counts = unzip(words), 0, [], []
            for n in _unpack(sizes).tolist():
                w = raw[at : at + n]
                at += n
                ids = known.get(w)
                if ids is None:
                    ids = known[w] = encode_word(w.decode())
                flat += ids
                counts.append(len(ids))
            sizes_out.append(_pack(counts))
            ids_out.append(_pack(flat))
        yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("codes"), pa.array(sizes_out, pa.binary()), pa.array(ids_out, pa.binary())], names=["chunk", "codes", "sizes", "ids"])


def _position_rows(batches: Iterator, pattern: str, size: int) -> Iterator:
    """(chunk, row, codes): the codes of each text's positions."""
    import pyarrow as pa

    for batch, a, b, place, texts in _chunks(batches, size):
        name, _, placed = _coded(texts, place, pattern, True)
        yield pa.RecordBatch.from_arrays([pa.array([name] * (b - a), pa.binary()), batch.column("_row").slice(a, b - a), pa.array(map(_pack, placed), pa.binary())], names=["chunk", "_row", "codes"])


def _bytes_of(ids, vocabulary: Vocabulary) -> bytes:
    """What the ids stand for, from the token-byte table."""
    import numpy as np

    flat, starts, sizes = _byte_table(vocabulary)
    return _gather(flat, starts, sizes, np.asarray(ids)).tobytes()


def _together(left, right, vocabulary: Vocabulary | None = None):
    """A chunk's texts as ids: positions' codes looked up in what the shards answered. With a vocabulary, also the bytes that the ids stand for."""
    import numpy as np
    import pyarrow as pa

    codes = [_unpack(x) for x in right.column("codes").to_pylist()]
    counts = [_unpack(x) for x in right.column("sizes").to_pylist()]
    flat = [_unpack(x).astype(np.int32) for x in right.column("ids").to_pylist()]
    n = 1 + max((int(c.max()) for c in codes if len(c)), default=-1)
    starts, sizes, offset = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    for c, k, f in zip(codes, counts, flat, strict=True):
        k = k.astype(np.int64)
        starts[c], sizes[c] = offset + np.cumsum(k) - k, k
        offset += len(f)
    flat = np.concatenate(flat) if flat else np.array([], np.int32)
    parts, ends, decoded = [], [0], []
    for packed in left.column("codes"):
        at = _unpack(packed.as_py())
        if len(at) and at.max() >= n:
            raise RuntimeError("the input's rows changed between two reads; write it as a table first")
        parts.append(_gather(flat, starts, sizes, at))
        ends.append(ends[-1] + len(parts[-1]))
        if vocabulary:
            decoded.append(_bytes_of(parts[-1], vocabulary))
    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.array([], np.int32), pa.int32()))
    out = left.select(["_row"]).append_column("ids", ids)
    return out.append_column("bytes", pa.array(decoded, pa.binary())) if vocabulary else out


@dataclass(frozen=True)
class Shards:
    chars: int = 16_000_000  # of text for each shard, up to the most of them
    least: int = 64
    most: int = 1024  # and so the most rows of a chunk
    part_chars: int = 1_000_000_000  # of text, for each shard, that a task's words should stem from

    def counts(self, chars: int) -> tuple[int, int]:
        """How many shards, and how many parts of each."""
        n = min(self.most, max(self.least, -(-chars // self.chars)))
        return n, max(1, -(-chars // (n * self.part_chars)))


def _encoded(docs: DataFrame, vocabulary: Vocabulary, keep: list[str], text: str, chunk_chars: int, sharding: Shards, decoded: bool) -> DataFrame:
    """(_row, ids) for every row, _row holding the columns of ``keep``; if decoded, with the bytes that the ids stand for."""
    total = docs.agg(F.sum(F.length(F.col(text).cast("string")))).first()[0] or 0
    shards, parts = sharding.counts(total)
    pattern = vocabulary.pattern
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    row = F.struct(*[F.col(c) for c in keep]) if keep else F.struct(F.lit(0).alias("_none"))
    source = docs.select(row.alias("_row"), F.col(text).cast("string").alias("_text"))
    row_type = source.schema["_row"].dataType
    words = source.mapInArrow(lambda it: _word_rows(it, pattern, chunk_chars, shards, parts), "shard long, chunk binary, codes binary, sizes binary, words binary")
    told = words.repartition("shard").sortWithinPartitions("shard").mapInArrow(lambda it: _answers(it, held.value), "chunk binary, codes binary, sizes binary, ids binary")
    placed = source.mapInArrow(lambda it: _position_rows(it, pattern, chunk_chars), StructType([StructField("chunk", BinaryType()), StructField("_row", row_type), StructField("codes", BinaryType())]))
    result = [StructField("_row", row_type), StructField("ids", ArrayType(IntegerType())), *([StructField("bytes", BinaryType())] if decoded else [])]
    return placed.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(lambda left, right: _together(left, right, held.value if decoded else None), StructType(result))


def encode(docs: DataFrame, vocabulary: Vocabulary, keep: list[str], text: str = "text", chunk_chars: int = 4_000_000, sharding: Shards = Shards()) -> DataFrame:
    """The columns of ``keep`` and ``ids``: array<int>, for every row of a table at rest. The number of characters decides only how work is
    dealt; partitions are the session's."""
    return _encoded(docs, vocabulary, keep, text, chunk_chars, sharding, False).select(*[F.col(f"_row.`{c}`").alias(c) for c in keep], "ids")


def round_trip(docs: DataFrame, vocabulary: Vocabulary, keep: list[str], text: str = "text", chunk_chars: int = 4_000_000, sharding: Shards = Shards()) -> DataFrame:
    """As ``decode`` of ``encode``: the columns of ``keep``, ``ids``, and ``bytes``, decoded where a chunk's ids are put together, so that ids do
    not go to a second Python worker beside the first, in batches of many chunks."""
    return _encoded(docs, vocabulary, keep, text, chunk_chars, sharding, True).select(*[F.col(f"_row.`{c}`").alias(c) for c in keep], "ids", "bytes")


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", to: str = "bytes") -> DataFrame:
    """Adds the bytes that the ids stand for. Null ids give no bytes; an id outside the vocabulary is an error."""
    held = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("binary")
    def joined(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([b"" if x is None else _bytes_of(x, held.value) for x in batch], dtype=object)

    return encoded.withColumn(to, joined(F.col(ids)))


def digests(docs: DataFrame, vocabulary: Vocabulary, keep: list[str]) -> DataFrame:
    """Encodes and decodes every text: the columns of ``keep``, n_tokens, and digests of the ids and of the decoded bytes."""
    df = round_trip(docs, vocabulary, keep)
    return df.select(*keep, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


