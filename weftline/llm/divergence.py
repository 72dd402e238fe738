"""Source divergence audit by a recount in minimal perfect hashes.

First pass: in how many documents of its language each term occurs; those in at least ``least`` are kept, exactly. Kept terms are
dealt to shards by hash, and each shard's terms get a minimal perfect hash: rounds of bit arrays, where a bit is set if one key
alone falls on it and the others go on to the next round. The number of set bits before a key's bit is its slot; at the slot the
key itself is stored.

Second pass: the shards are broadcast, as many at a time as ``Audit.held_bytes`` and ``held_keys`` allow (a larger vocabulary takes
several passes, each with the next shards; nothing is left out). Every term of a text is looked up and compared with the key
stored there, and the dense slots of its language and source are incremented; a task's slots are written out and cleared when they
take more than ``slots``. Counts of all tasks are added by key.

Sources of a language are compared in blocks: a unit is a shard and two blocks of ``block`` sources, and gives one sum for each
pair of sources, which is what the result holds anyway. Probabilities are whole numbers computed in decimals, so all is exact.

Defined results: null text, lang and source are read as ''; a group without terms has its smoothed probabilities; a language without
kept terms has pairs of value 0 and no terms; a language of one source has no pairs; repeated rows count each; an empty table gives
no rows; extra columns do not matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import write_table

if TYPE_CHECKING:
    import numpy as np
    import pandas as pd
    import pyarrow as pa


@dataclass(frozen=True)
class Audit:
    least: int = 30  # documents of a kept term's language
    smoothing: int = 5
    scale: int = 1_000_000_000
    top: int = 50  # terms of each group
    shard_keys: int = 512
    block: int = 256  # sources
    held_bytes: int = 32_000_000  # of stored keys and bits that are broadcast at once
    held_keys: int = 2_000_000
    slots: int = 4_000_000  # that a task holds


#: A-Z in lower case, and a space for every other ASCII character that is no letter.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_ROUNDS = 40  # keys that collide in all of them (equal hashes) are listed beside the bits
_ENTRIES = 200_000  # of a task's counts before they are written out


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def _bare(docs: DataFrame, text: str = "text") -> DataFrame:
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(named("lang").alias("lang"), named("source").alias("source"), named(text).cast("binary").alias("text"))


def frequencies(bare: DataFrame) -> DataFrame:
    """(lang, term, n): documents of the language that hold the term."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            langs, found = zip(*held, strict=True) if held else ((), ())
            batch = pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], ["lang", "term", "n"])
            held.clear()
            return batch

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                held.update((lang, t) for t in set(terms(text.as_py())))
                if len(held) > _ENTRIES:
                    yield out()
        yield out()

    return bare.select("lang", "text").mapInArrow(rows, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))


# --- minimal perfect hashes -----------------------------------------------------------------------------------------


def _hashes(keys: list[bytes]) -> np.ndarray:
    """As Spark's xxhash64 of the strings."""
    import numpy as np
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(k, 42) for k in keys), np.uint64, len(keys))


def _places(h: np.ndarray, level: int, sizes: np.ndarray | int) -> np.ndarray:
    import numpy as np

    with np.errstate(over="ignore"):
        x = h + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return ((x ^ x >> np.uint64(31)) % np.asarray(sizes).astype(np.uint64)).astype(np.int64)


def build(keys: list[bytes], rounds: int = _ROUNDS) -> tuple[list[int], np.ndarray, list[bytes]]:
    """(sizes of the rounds, their bits one after the other, keys in the order of their slots; those without a bit come last)."""
    import numpy as np

    h, left = _hashes(keys), np.arange(len(keys))
    sizes, bits, order = [], [], []
    for level in range(rounds):
        if not len(left):
            break
        size = max(8, 2 * len(left))
        at = _places(h[left], level, size)
        alone = np.bincount(at, minlength=size) == 1
        own = alone[at]
        sizes.append(size)
        bits.append(alone)
        order.append(left[own][np.argsort(at[own])])
        left = left[~own]
    order = np.concatenate([*order, left]).astype(int) if len(keys) else []
    return sizes, np.concatenate(bits) if bits else np.array([], bool), [keys[i] for i in order]


def shards(kept: DataFrame, sizes: DataFrame, audit: Audit) -> DataFrame:
    """(lang, shard, n_shards, sizes, bits, keys): a row for each shard that has keys; a key's place is its slot."""

    def one(key: tuple, table: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow as pa

        size, bits, keys = build(sorted(table.column("term").cast(pa.binary()).to_pylist()))
        row = {"lang": [key[0].as_py()], "shard": [key[1].as_py()], "n_shards": [table.column("n_shards")[0].as_py()], "sizes": [size], "bits": [np.packbits(bits).tobytes()], "keys": [[k.decode() for k in keys]]}
        return pa.table(row, schema=pa.schema([("lang", pa.string()), ("shard", pa.int64()), ("n_shards", pa.int64()), ("sizes", pa.list_(pa.int32())), ("bits", pa.binary()), ("keys", pa.list_(pa.string()))]))

    dealt = kept.join(sizes.select("lang", "n_shards"), "lang").select("lang", F.expr("pmod(xxhash64(term), n_shards)").alias("shard"), "n_shards", "term")
    return dealt.groupBy("lang", "shard").applyInArrow(one, "lang string, shard long, n_shards long, sizes array<int>, bits binary, keys array<string>")


@dataclass
class Held:
    """Shards of several languages as flat arrays, for looking up many keys at once."""

    where: dict[str, np.ndarray]  # of a language: each shard's row in the arrays; -1 for a shard not held
    named: list[tuple[str, int]]  # language and shard of each row
    first: np.ndarray  # a row's first key
    sizes: np.ndarray  # by row and round; 0 where there is none
    starts: np.ndarray  # of the rounds' bits
    bits: np.ndarray
    before: np.ndarray  # set bits before each bit
    keys: pa.Array
    rest: dict[tuple[int, bytes], int] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list) -> Held:
        import numpy as np
        import pyarrow as pa

        where: dict[str, np.ndarray] = {}
        for i, r in enumerate(rows):
            if r.lang not in where:
                where[r.lang] = np.full(r.n_shards, -1)
            where[r.lang][r.shard] = i
        most = max((len(r.sizes) for r in rows), default=1)
        sizes, starts, first = np.zeros((len(rows), most), np.int64), np.zeros((len(rows), most), np.int64), np.zeros(len(rows) + 1, np.int64)
        bits, before, n_bits, rest = [], [], 0, {}
        for i, r in enumerate(rows):
            own = np.unpackbits(np.frombuffer(r.bits, np.uint8), count=sum(r.sizes)).astype(bool)
            sizes[i, : len(r.sizes)] = r.sizes
            starts[i, : len(r.sizes)] = n_bits + np.cumsum([0, *r.sizes[:-1]])
            before.append(first[i] + np.cumsum(own) - own)
            bits.append(own)
            n_bits += len(own)
            first[i + 1] = first[i] + len(r.keys)
            rest |= {(i, r.keys[k].encode()): int(first[i]) + k for k in range(int(own.sum()), len(r.keys))}
        joined = lambda x, kind: np.concatenate(x) if x else np.array([], kind)
        keys = pa.array([k.encode() for r in rows for k in r.keys], pa.binary())
        return cls(where, [(r.lang, r.shard) for r in rows], first, sizes, starts, joined(bits, bool), joined(before, np.int64), keys, rest)

    def find(self, lang: str, words: list[bytes]) -> np.ndarray:
        """The places of the words among the held keys; -1 for a word that is none of them, by comparison with the stored key."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        out = np.full(len(words), -1, np.int64)
        if lang not in self.where or not words:
            return out
        h = _hashes(words)
        row = self.where[lang][h.view(np.int64) % len(self.where[lang])]
        left = np.flatnonzero(row >= 0)
        for level in range(self.sizes.shape[1]):
            left = left[self.sizes[row[left], level] > 0]
            if not len(left):
                break
            at = self.starts[row[left], level] + _places(h[left], level, self.sizes[row[left], level])
            hit = self.bits[at]
            out[left[hit]] = self.before[at[hit]]
            left = left[~hit]
        same = np.asarray(pc.equal(self.keys.take(pa.array(np.maximum(out, 0))), pa.array(words, pa.binary())).to_numpy(zero_copy_only=False), bool)
        out[~same] = -1
        for i in np.flatnonzero((out < 0) & (row >= 0)) if self.rest else []:
            out[i] = self.rest.get((int(row[i]), words[i]), -1)
        return out


def recount(bare: DataFrame, held: Held, audit: Audit) -> DataFrame:
    """(lang, source, shard, slot, n): occurrences of held keys, added up by task."""
    shared = bare.sparkSession.sparkContext.broadcast(held)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        h = shared.value
        spans: dict[str, tuple[int, int]] = {}  # of each language's keys; its rows stand together
        for i, (lang, _) in enumerate(h.named):
            a, b = spans.get(lang, (len(h.keys), 0))
            spans[lang] = (min(a, int(h.first[i])), max(b, int(h.first[i + 1])))
        dense: dict[tuple[str, str], np.ndarray] = {}
        used = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), slots in dense.items():
                at = np.flatnonzero(slots)
                place = at + spans[lang][0]
                row = np.searchsorted(h.first, place, "right") - 1
                shard = np.array([h.named[i][1] for i in row], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([source] * len(at), pa.string()), pa.array(shard), pa.array(place - h.first[row]), pa.array(slots[at])], ["lang", "source", "shard", "slot", "n"])
            dense.clear()

        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                batch = whole.slice(begin, 500)
                found: dict[tuple[str, str], Counter] = {}
                for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
                    if lang in spans:
                        found.setdefault((lang, source), Counter()).update(terms(text.as_py()))
                for (lang, source), n in found.items():
                    a, b = spans[lang]
                    if (lang, source) not in dense:
                        if used + b - a > audit.slots and dense:
                            yield from out()
                            used = 0
                        dense[lang, source] = np.zeros(b - a, np.int64)
                        used += b - a
                    place = h.find(lang, list(n))
                    here = place >= 0
                    dense[lang, source][place[here] - a] += np.fromiter(n.values(), np.int64, len(n))[here]
        yield from out()

    return bare.mapInArrow(rows, "lang string, source string, shard long, slot long, n long")


def counts(bare: DataFrame, table: DataFrame, audit: Audit) -> DataFrame:
    """A written table (lang, source, shard, slot, n) over all shards of the table, a pass over the corpus for each load that may be broadcast."""
    weight = F.octet_length("bits") + F.aggregate("keys", F.lit(0).cast("long"), lambda a, k: a + F.octet_length(k) + 8)
    narrow = table.select("lang", "shard", weight.alias("bytes"), F.size("keys").cast("long").alias("keys")).orderBy("lang", "shard").toLocalIterator()
    loads, size, keys = [[]], 0, 0
    for r in narrow:
        if loads[-1] and (size + r.bytes > audit.held_bytes or keys + r.keys > audit.held_keys):
            loads.append([])
            size = keys = 0
        loads[-1] = [loads[-1][0] if loads[-1] else (r.lang, r.shard), (r.lang, r.shard)]
        size, keys = size + r.bytes, keys + r.keys
    parts = []
    for ends in filter(None, loads):
        (l1, s1), (l2, s2) = ends
        key = F.struct("lang", "shard")
        rows = table.filter((key >= F.struct(F.lit(l1), F.lit(s1).cast("long"))) & (key <= F.struct(F.lit(l2), F.lit(s2).cast("long")))).orderBy("lang", "shard").collect()
        parts.append(recount(bare, Held.of(rows), audit))
    out = parts[0] if parts else recount(bare.limit(0), Held.of([]), audit)
    for p in parts[1:]:
        out = out.unionByName(p)
    return write_table(out.groupBy("lang", "source", "shard", "slot").agg(F.sum("n").alias("n")), "counts")


# --- comparison -----------------------------------------------------------------------------------------------------


def _p(n: Column, total: Column, kept: Column, audit: Audit) -> Column:
    """1 + floor(scale * (n + smoothing) / (total + smoothing * kept)), exactly; null if nothing is kept."""
    above = (n + audit.smoothing).cast("decimal(20,0)") * F.lit(audit.scale).cast("decimal(11,0)")
    below = (total + kept * audit.smoothing).cast("decimal(20,0)")
    return F.call_function("div", above, F.when(kept > 0, below)) + 1


def pairs(cells: DataFrame, groups: DataFrame, sizes: DataFrame, audit: Audit) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language, both ways. cells: lang, source, shard, slot, p; groups: lang, source, at, p0."""
    blocks = F.expr(f"at div {audit.block}")
    g = groups.withColumn("block", blocks)
    n_blocks = g.groupBy("lang").agg((F.max("block") + 1).alias("n_blocks"))
    marks = g.join(sizes, "lang").select("lang", "shard", "block", "at", F.lit(None).cast("long").alias("slot"), F.col("p0").alias("p"), "n_keys")
    held = cells.join(g.select("lang", "source", "at", "block"), ["lang", "source"]).select("lang", "shard", "block", "at", "slot", "p", F.lit(None).cast("long").alias("n_keys"))
    every = marks.unionByName(held).join(n_blocks, "lang")
    sent = every.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    unit = sent.select("lang", "shard", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"), "at", "slot", "p", "n_keys")

    def differ(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np
        import pandas as pd

        lang, _, i, j = key
        own = rows[rows["slot"].isna()].sort_values("at")
        at, n = own["at"].to_numpy(np.int64), int(own["n_keys"].iloc[0])
        p = np.repeat(own["p"].fillna(0).to_numpy(np.int64)[:, None], n, axis=1)
        seen = rows[rows["slot"].notna()]
        p[np.searchsorted(at, seen["at"].to_numpy(np.int64)), seen["slot"].to_numpy(np.int64)] = seen["p"].to_numpy(np.int64)
        left, right = np.flatnonzero(at // audit.block == i), np.flatnonzero(at // audit.block == j)
        out = []
        for a in left:
            b = right[right > a]
            out.append(pd.DataFrame({"a": at[a], "b": at[b], "value": np.abs(p[b] - p[a]).sum(axis=1)}))
        found = pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "value": []})
        return found.astype("int64").assign(lang=lang)[["lang", "a", "b", "value"]]

    sums = unit.groupBy("lang", "shard", "i", "j").applyInPandas(differ, "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("lang", "value", "e.x", "e.y")
    name = lambda k, to: groups.select("lang", F.col("at").alias(k), F.col("source").alias(to))
    return both.join(name("x", "source"), ["lang", "x"]).join(name("y", "item"), ["lang", "y"]).select("lang", "source", "item", "value")


def report(docs: DataFrame, audit: Audit = Audit()) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group: its distance to each other source, and the terms it has more often than its language."""
    bare = _bare(docs)
    kept = write_table(frequencies(bare).filter(F.col("n") >= audit.least), "kept_terms")
    present = write_table(bare.groupBy("lang", "source").agg(F.count("*").alias("n_docs")), "groups")
    n_kept = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    langs = present.select("lang").distinct().join(n_kept, "lang", "left").na.fill(0, ["kept"])
    langs = write_table(langs.withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("kept") / audit.shard_keys)).cast("long")), "languages")
    table = write_table(shards(kept, langs, audit), "shards")
    found = counts(bare, table, audit)

    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_name = Window.partitionBy("lang").orderBy("source")
    groups = present.join(totals, ["lang", "source"], "left").na.fill(0, ["total"]).join(langs, "lang")
    groups = groups.withColumn("at", F.row_number().over(by_name).cast("long") - 1).withColumn("p0", _p(F.lit(0).cast("long"), F.col("total"), F.col("kept"), audit))
    groups = write_table(groups.select("lang", "source", "at", "total", "kept", "p0"), "group_totals")
    cells = found.join(groups.select("lang", "source", "total", "kept"), ["lang", "source"]).withColumn("p", _p(F.col("n"), F.col("total"), F.col("kept"), audit))

    n_keys = langs.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_shards") - 1)).alias("shard")).join(table.select("lang", "shard", F.size("keys").cast("long").alias("n_keys")), ["lang", "shard"], "left").na.fill(0, ["n_keys"])
    apart = pairs(cells, groups, n_keys, audit).withColumn("part", F.lit("pair"))

    lang_total = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.first("kept").alias("kept"))
    q = found.groupBy("lang", "shard", "slot").agg(F.sum("n").alias("n")).join(lang_total, "lang").select("lang", "shard", "slot", _p(F.col("n"), F.col("total"), F.col("kept"), audit).alias("q"))
    named = table.select("lang", "shard", F.posexplode("keys").alias("slot", "item")).withColumn("slot", F.col("slot").cast("long"))
    more = cells.join(q.join(named, ["lang", "shard", "slot"]), ["lang", "shard", "slot"]).filter("p > q").select("lang", "source", "item", (F.col("p") - F.col("q")).alias("value"), F.lit("term").alias("part"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    apart, more = apart.withColumn("rank", rank), more.withColumn("rank", rank).filter(F.col("rank") <= audit.top)
    return apart.unionByName(more).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
