"""Near-duplicate vectors by Euclidean p-stable hashing.

Vectors are normalised and hashed in several tables: each table concatenates quantised random projections. Vectors
that share a bucket in some table are compared by exact cosine in double precision. Hashes per table grow with the
logarithm of the number of vectors, so that a bucket holds about as many unlike vectors at every size, and the number
of tables follows from the wanted recall at the threshold itself (pairs nearer than that are found more surely).

Equal vectors are one class from the start. A bucket with many classes is split in blocks, each pair of blocks being a
unit of its own, so no task holds more than two blocks. Units first see sketches, the signs of random projections, which differ in few bits
for near vectors; a vector itself is sent only to those units where some sketch is near enough to its own. A unit emits for each class the weight of its links and one
link to its component's root, never the pairs; a pair met in several tables counts in the first only.

Defined results: null, zero, and non-finite vectors and those with null components link with nothing; vectors of
different lengths do not link; repeated rows are vectors of their own; a null vec_id names no component; an empty table
gives no rows; extra columns are passed on. Classes are named by a 64-bit hash of the vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import write_table
from .components import components


@dataclass(frozen=True)
class PStable:
    cosine: float = 0.9
    width: float = 2.0  # of a quantisation step
    miss: float = 0.02  # chance that a pair at the threshold shares no bucket
    unlike: int = 512  # orthogonal vectors to expect in a bucket: more of them, fewer tables
    block: int = 1024  # classes that a unit compares with as many others
    bits: int = 256  # of a sketch
    unseen: float = 1e-9  # chance that the sketches of a pair at the threshold differ too much
    seed: int = 23

    def meets(self, distance: float) -> float:
        """The chance that one quantised projection is equal for vectors so far apart."""
        r = self.width / distance
        return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))

    def shape(self, n: int) -> tuple[int, int]:
        """(hashes of a table, tables) for n vectors."""
        k = max(4, math.ceil(math.log(max(2.0, n / self.unlike)) / -math.log(self.meets(math.sqrt(2)))))
        p = self.meets(math.sqrt(2 - 2 * self.cosine)) ** k
        return k, max(1, math.ceil(math.log(self.miss) / math.log1p(-p)))

    def differing(self) -> int:
        """The most bits in which sketches of a pair may differ: each does with the chance angle / pi."""
        p, left, k = math.acos(self.cosine) / math.pi, 1.0, -1
        while left > self.unseen and k < self.bits:
            k += 1
            left -= math.comb(self.bits, k) * p**k * (1 - p) ** (self.bits - k)
        return k


GRID = 2.0**20  # vectors and projections are rounded to this for hashing, so that sums are exact and every task finds the same buckets


class _Hasher:
    """Buckets of unit vectors, as 32-bit hashes; a length has projections of its own."""

    def __init__(self, shape: tuple[int, int], config: PStable) -> None:
        (self.k, self.tables), self.width, self.seed = shape, config.width, config.seed
        self.cache: dict[int, tuple] = {}

    def __call__(self, x):
        import numpy as np

        d, k, tables = x.shape[1], self.k, self.tables
        if d not in self.cache:
            r = np.random.default_rng([self.seed, d])
            a = np.rint(r.standard_normal((d, tables * k)) * GRID) / GRID
            self.cache[d] = a, r.uniform(0, self.width, tables * k), r.integers(1, 2**63, (tables, k), dtype=np.uint64) | np.uint64(1)
        a, b, mixers = self.cache[d]
        q = np.floor((np.rint(x * GRID) / GRID @ a + b) / self.width).astype(np.int64).astype(np.uint64).reshape(-1, tables, k)
        h = (q * mixers).sum(axis=2, dtype=np.uint64)
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32).view(np.int32)


class _Sketcher:
    """Signs of random projections, as packed bits; a length has projections of its own."""

    def __init__(self, config: PStable) -> None:
        self.bits, self.seed, self.cache = config.bits, config.seed, {}

    def __call__(self, x):
        import numpy as np

        d = x.shape[1]
        if d not in self.cache:
            self.cache[d] = np.random.default_rng([self.seed, d, 1]).standard_normal((d, self.bits))
        return np.packbits(x @ self.cache[d] > 0, axis=1)


def _unit_length(x):
    """Divided by the largest component first: squares of tiny or huge components neither vanish nor overflow."""
    import numpy as np

    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _signatures(batches: Iterator, shape: tuple[int, int], config: PStable) -> Iterator:
    """The sketch and the buckets of all tables for each class."""
    import numpy as np
    import pyarrow as pa

    hasher, sketcher, tables = _Hasher(shape, config), _Sketcher(config), shape[1]
    for batch in batches:
        vectors = batch.column("e")
        sizes = np.diff(vectors.offsets.to_numpy())
        flat, starts = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64), vectors.offsets.to_numpy()[:-1]
        out, sketches = np.empty((len(sizes), tables), dtype=np.int32), np.empty((len(sizes), -(-config.bits // 8)), dtype=np.uint8)
        for d in np.unique(sizes):
            own = np.flatnonzero(sizes == d)
            for part in np.array_split(own, max(1, len(own) // 1024)):
                x = _unit_length(flat[starts[part][:, None] + np.arange(d)])
                out[part], sketches[part] = hasher(x), sketcher(x)
        buckets = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * tables, pa.int32()), pa.array(out.ravel(), pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array([x.tobytes() for x in sketches], pa.binary()), buckets], names=["h", "sketch", "sig"])


def _roots(n: int, i, j):
    """The least index reachable by the links i-j, for each of n."""
    import numpy as np

    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _unit(rows: dict, cosine: float, hasher: _Hasher) -> tuple | None:
    """The links of a unit: (class, weight of its links, root) of the classes that have some."""
    import numpy as np

    i, j, table = rows["i"][0], rows["j"][0], rows["t"][0]
    e, block = rows["e"], rows["block"]
    sizes = np.array([len(v) for v in e])
    top = sizes.max()  # lengths differ only by a chance collision of hashes
    x = _unit_length(np.stack(e if sizes.min() == top else [np.pad(np.asarray(v, np.float64), (0, top - len(v))) for v in e]).astype(np.float64))
    left = np.flatnonzero(block == i)
    right = left if i == j else np.flatnonzero(block == j)
    if len(left) == 0 or len(right) == 0:
        return None
    a, b = np.nonzero(x[left] @ x[right].T >= cosine)
    a, b = left[a], right[b]
    if i == j:
        a, b = a[a < b], b[a < b]
    alike = sizes[a] == sizes[b]
    a, b = a[alike], b[alike]
    if len(a) and table:
        # Counted where they met first: the buckets of earlier tables are computed anew rather than sent along.
        some, sig = np.unique(np.concatenate([a, b])), np.zeros((len(e), table), dtype=np.int32)
        for d in np.unique(sizes[some]):
            own = some[sizes[some] == d]
            sig[own] = hasher(x[own, :d])[:, :table]
        for t in range(table):
            fresh = sig[a, t] != sig[b, t]
            a, b = a[fresh], b[fresh]
    if not len(a):
        return None
    n = rows["n"]
    weight = np.bincount(a, n[b], len(n)) + np.bincount(b, n[a], len(n))
    # The least class hash names the root, so that other units agree.
    order = np.argsort(rows["h"], kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    root = order[_roots(len(n), rank[a], rank[b])][rank]
    some = np.flatnonzero(weight)
    return rows["h"][some], weight[some].astype(np.int64), rows["h"][root[some]]


UNIT = ["t", "b", "i", "j"]


def _units(batches: Iterator, columns: list[str]) -> Iterator[dict]:
    """The rows of each unit with two and more, from rows sorted by unit; a unit may go on in the next batch."""
    import numpy as np

    def whole(parts: list[dict]) -> Iterator[dict]:
        if sum(len(p["h"]) for p in parts) > 1:
            yield {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}

    last, held = None, []
    for batch in batches:
        cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in [*UNIT, *columns]}
        keys = np.stack([cols[c] for c in UNIT], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            key = tuple(keys[lo])
            if key != last:
                yield from whole(held)
                last, held = key, []
            held.append({c: v[lo:hi] for c, v in cols.items()})
    yield from whole(held)


def _batches(found: Iterator[tuple], names: list[str], types: list) -> Iterator:
    """Arrow batches of some ten thousand rows from tuples of arrays."""
    import numpy as np
    import pyarrow as pa

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(zip(*parts, strict=True), types, strict=True)], names=names)

    parts: list[tuple] = []
    for x in found:
        parts.append(x)
        if sum(len(p[0]) for p in parts) > 10_000:
            yield batch()
            parts = []
    if parts:
        yield batch()


def _near(rows: dict, config: PStable, most: int) -> tuple | None:
    """The rows of a unit whose sketch is near that of a row they are to be compared with."""
    import numpy as np

    i, j, block = rows["i"][0], rows["j"][0], rows["block"]
    signs = np.unpackbits(np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(block), -1), axis=1)[:, : config.bits].astype(np.float32) * 2 - 1
    left = np.flatnonzero(block == i)
    right = left if i == j else np.flatnonzero(block == j)
    if not len(left) or not len(right):
        return None
    near = signs[left] @ signs[right].T >= config.bits - 2 * most  # equal signs less unlike ones
    if i == j:
        np.fill_diagonal(near, False)
    some = np.union1d(left[near.any(axis=1)], right[near.any(axis=0)])
    return tuple(rows[c][some] for c in ("h", *UNIT, "block")) if len(some) else None


def _sift(batches: Iterator, config: PStable) -> Iterator:
    """Which classes of sorted units need their vectors there."""
    import pyarrow as pa

    most = config.differing()
    found = filter(None, (_near(rows, config, most) for rows in _units(batches, ["block", "h", "sketch"])))
    yield from _batches(found, ["h", *UNIT, "block"], [pa.int64(), *[pa.int32()] * 5])


def _compare(batches: Iterator, shape: tuple[int, int], config: PStable) -> Iterator:
    """The links of sorted units."""
    import pyarrow as pa

    hasher = _Hasher(shape, config)
    found = filter(None, (_unit(rows, config.cosine, hasher) for rows in _units(batches, ["block", "h", "n", "e"])))
    yield from _batches(found, ["h", "links", "root"], [pa.int64()] * 3)


def link(vectors: DataFrame, config: PStable = PStable(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Adds n_links, component_id and kept to every row, in place of the vector."""
    e = F.col(f"`{embedding}`")
    numbers = F.transform(e, lambda x: x + F.lit(0).cast("float"))  # no negative zeros, which would hash apart
    usable = F.coalesce(e.isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    rest = [c for c in vectors.columns if c not in (embedding, "n_links", "component_id", "kept")]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row")
    every = vectors.select(row, F.col(f"`{vec_id}`").alias("id"), F.when(usable, F.xxhash64(numbers)).alias("h"), F.when(usable, numbers).alias("e"))
    rows = every.filter("h is not null")
    classes = write_table(rows.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.first("e").alias("e")), "classes")
    shape = config.shape(classes.count())
    hashed = classes.select("h", "e").mapInArrow(lambda it: _signatures(it, shape, config), "h long, sketch binary, sig array<int>")
    placed = write_table(hashed, "hashed").select("h", "sketch", F.posexplode("sig").alias("t", "b"))
    crowded = placed.groupBy("t", "b").agg(F.count("*").alias("m")).filter(F.col("m") > 1)
    crowded = write_table(crowded.withColumn("blocks", F.ceil(F.col("m") / config.block).cast("int")).drop("m"), "crowded")
    # Who meets where is found by sketches; vectors come once for each unit in which their class is near another.
    met = placed.join(crowded, ["t", "b"]).withColumn("block", F.pmod(F.hash("h"), F.col("blocks")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = met.select("h", "sketch", "t", "b", F.least("block", "other").cast("int").alias("i"), F.greatest("block", "other").cast("int").alias("j"), F.col("block").cast("int").alias("block"))
    by_unit = lambda df: df.repartition(*UNIT).sortWithinPartitions(*UNIT)
    near = write_table(by_unit(units).mapInArrow(lambda it: _sift(it, config), "h long, t int, b int, i int, j int, block int"), "near")
    found = by_unit(near.join(classes.select("h", "n", "e"), "h"))
    found = write_table(found.mapInArrow(lambda it: _compare(it, shape, config), "h long, links long, root long"), "found")
    roots = components(found.select(F.col("h").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("h").agg(F.sum("links").alias("links"))
    grouped = classes.select("h", "n", "least").join(links, "h", "left").join(roots.withColumnRenamed("node", "h"), "h", "left")
    grouped = write_table(grouped.select("h", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "h").alias("root")), "grouped")
    named = grouped.join(grouped.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    named = named.select("h", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    linked = rows.select("row", "id", "h").join(named, "h").select("row", "id", "n_links", "component_id")
    alone = every.filter("h is null").select("row", "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return linked.unionByName(alone).select("row.*", "n_links", "component_id", kept.alias("kept"))
