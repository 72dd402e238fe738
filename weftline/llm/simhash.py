"""Near-duplicates by SimHash with a segment-popcount embedding.

A 64-bit fingerprint is cut into segments; its bit counts by segment are a point whose Manhattan distance from another
point is at most the Hamming distance of the fingerprints. Points within two are met on a grid: every point offers its
own cell and those one step down or up, so that two points at distance two or less share a cell. What shares a cell is
verified by the exact Hamming distance inside the join, and only true links leave it.

Equal fingerprints are one node from the start, so that thousands of copies cost one row. Defined results: a null,
empty or wordless text has fingerprint zero; a null doc_id gets a fingerprint and its node's component but names none;
an empty table gives no rows; extra columns are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ._shared import write_table
from .components import components

SEED = 42
PART = 1 << 14  # shingles whose bits are counted at once


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64 bits. A bit is set if it is in over half of the shingles' hashes; bytes split and lower-case as ASCII does."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, dtype=np.int64)
    for begin in range(0, n, PART):
        part = words[begin : begin + PART + shingle - 1]
        grams = zip(*(part[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
        hashes = np.array([xxh64_intdigest(b" ".join(g), SEED) for g in grams], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n).view(">i8")[0])


@F.pandas_udf(LongType())
def fingerprint_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([fingerprint(x) for x in texts], dtype="int64")


def segment_counts(fp: Column, segment_bits: int = 4) -> Column:
    """Bit counts of the segments of 2, 4 or 8 bits, each in its segment's place: the first steps of counting bits in parallel.

    Pairs are counted by their sum and carry, since their top count may reach the sign bit.
    """
    ones, twos, fours = F.lit(0x5555555555555555), F.lit(0x3333333333333333), F.lit(0x0F0F0F0F0F0F0F0F)
    a, b = fp.bitwiseAND(ones), F.shiftrightunsigned(fp, 1).bitwiseAND(ones)
    pairs = a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))
    if segment_bits == 2:
        return pairs
    counts = pairs.bitwiseAND(twos) + F.shiftrightunsigned(pairs, 2).bitwiseAND(twos)
    return counts if segment_bits == 4 else counts.bitwiseAND(fours) + F.shiftrightunsigned(counts, 4).bitwiseAND(fours)


def near_pairs(nodes: DataFrame, segment_bits: int = 4) -> DataFrame:
    """(u, v), u < v, of the nodes (node: long, fp: long, distinct) whose fingerprints differ in one or two bits.

    Cells of 4-bit segments tell some 2**32 random fingerprints apart, of 2-bit segments 2**48, for half as many offers again.
    """
    n, top = 64 // segment_bits, segment_bits
    steps = []
    for s in range(n):
        count = F.shiftrightunsigned("cell", s * segment_bits).bitwiseAND(F.lit((1 << segment_bits) - 1))
        for step, possible in ((-1, count > 0), (1, count < top)):
            # The segment's count is changed by its bits that differ, as a sum might pass the sign bit.
            moved = F.col("cell").bitwiseXOR(F.shiftleft(count.bitwiseXOR(count + step), s * segment_bits))
            steps.append(F.when(possible, F.struct(F.lit(step).alias("step"), F.lit(s).alias("seg"), moved.alias("at"))))
    own = F.struct(F.lit(0).alias("step"), F.lit(-1).alias("seg"), F.col("cell").alias("at"))
    points = nodes.withColumn("cell", segment_counts(F.col("fp"), segment_bits))
    offers = points.select("node", "fp", F.explode(F.array_compact(F.array(own, *steps))).alias("o"))
    offers = offers.select("node", "fp", F.col("o.step").alias("step"), F.col("o.seg").alias("seg"), F.col("o.at").alias("at"))
    a, b = offers.alias("a"), offers.alias("b")
    # By the steps of both: in the same cell; one below; one below each, in different segments; two below.
    meet = F.expr("(a.step = 0 and b.step <= 0) or (a.step = -1 and b.step = -1 and a.seg <> b.seg) or (a.step = 1 and b.step = -1)")
    near = F.expr("a.fp <> b.fp and bit_count(a.fp ^ b.fp) <= 2")
    # Spark sizes offers as the nodes they are made of and would broadcast them, up to 33 times its threshold and more in memory.
    met = a.join(b.hint("merge"), (F.col("a.at") == F.col("b.at")) & meet & near)
    return met.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()


ADDED = ["fingerprint", "component_id", "group", "text_hash"]
FEW_NODES = 1 << 28  # distinct fingerprints that cells of 4-bit segments tell apart well enough


def cluster(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Adds ``fingerprint`` (16 hexadecimal digits), ``component_id``, and ``group`` (the component's least fingerprint) and
    ``text_hash`` in place of the text, which passes through Python once. Columns of these names are replaced.

    Fingerprints are the nodes, not ids: an id may be repeated with other texts.
    """
    rest = [c for c in docs.columns if c != text and c not in ADDED]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row")
    prints = docs.select(row, F.col(f"`{doc_id}`").alias("id"), fingerprint_udf(F.col(f"`{text}`")).alias("fp"), F.xxhash64(f"`{text}`").alias("text_hash"))
    prints = write_table(prints, "fingerprints")
    nodes = write_table(prints.groupBy(F.col("fp").alias("node")).agg(F.min("id").alias("least")), "nodes")
    roots = components(near_pairs(nodes.select("node", F.col("node").alias("fp")), 4 if nodes.count() <= FEW_NODES else 2))
    grouped = nodes.join(roots, "node", "left").select(F.col("node").alias("fp"), F.coalesce("root", "node").alias("group"), "least")
    grouped = write_table(grouped, "groups")
    named = grouped.select("fp", "group").join(grouped.groupBy("group").agg(F.min("least").alias("component_id")), "group")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(named, "fp").select("_row.*", digits.alias("fingerprint"), "component_id", "group", "text_hash")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group: that whose id names the component, and of rows that repeat its id one.

    A group without any id keeps one row too. Rows that repeat an id and its text become one before they are shuffled; the texts are
    shuffled once, to meet the narrow list of who stays, which is dealt by the same key.
    """
    key = lambda doc_id, h: F.concat(F.coalesce(F.concat(F.lit("+"), doc_id), F.lit("-")), F.lit(":"), h)
    groups = cluster(docs.select("doc_id", "text"))
    first = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("s"))
    first = write_table(first.select(key(F.col("s.doc_id"), F.col("s.text_hash")).alias("_key")), "first")
    keyed = docs.select(F.struct(*docs.columns).alias("_doc"), key(F.col("doc_id"), F.xxhash64("text")).alias("_key"))
    return keyed.dropDuplicates(["_key"]).join(first, "_key", "left_semi").select("_doc.*")
