"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosines, components.

A vector's signs at a pool of random hyperplanes are its sketch. Each table takes a few of these signs as
the number of a bucket; vectors meet in the buckets they share. What travels to the tables is the sketch
alone, some tens of bytes: how many signs two vectors differ in tells which can be as close as asked for.
Vectors themselves go only where they have such a partner, and there cosines are computed exactly. The number of
signs follows the number of vectors, that buckets stay small, and the number of tables follows from it, so
that a pair right at the threshold is met with probability RECALL at every size, and a closer one more surely.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import cut, stored
from .components import components

COSINE, RECALL = 0.9, 0.995
#: Vectors a bucket should hold on average, and vectors of one side of a block at most, about.
BUCKET, BLOCK = 128, 2048
SEED = 20240229
#: Hyperplanes that a sketch may have, and pairs at the threshold that its distance may miss (a part of what RECALL allows).
POOLS, MISSED = (128, 256, 512), 2e-4


@dataclass(frozen=True)
class Plan:
    """pool signs in a sketch; `bits` of them name a bucket in each table; partners differ in `most` signs at most."""

    pool: int
    bits: int
    tables: int
    most: int

    @property
    def words(self) -> int:
        return self.pool // 64

    def picks(self) -> np.ndarray:
        """(table, bit) numbers of signs."""
        rng = np.random.default_rng([SEED, self.pool, self.bits])
        return np.array([rng.choice(self.pool, self.bits, replace=False) for _ in range(self.tables)])

    def masks(self) -> np.ndarray:
        """(table, word) the same as bit masks of a sketch."""
        flags = np.zeros((self.tables, self.pool), np.uint8)
        np.put_along_axis(flags, self.picks(), 1, axis=1)
        return np.packbits(flags, axis=1, bitorder="little").view(np.uint64)


def plan(count: int, cosine: float = COSINE, recall: float = RECALL) -> Plan:
    """What so many vectors need, of the pools the one that sends the fewest bytes.

    At the threshold the differing signs are binomial, and of tables that share a pool no sign is independent; so
    the chance that no table brings a pair together is summed over the number of differing signs.
    """
    share = math.acos(cosine) / math.pi
    bits = min(24, max(4, round(math.log2(max(count, 1) / BUCKET))))
    best = None
    for pool in POOLS:
        chance = [math.comb(pool, h) * share**h * (1 - share) ** (pool - h) for h in range(pool + 1)]
        most = next(h for h in range(pool + 1) if sum(chance[h + 1 :]) <= MISSED)
        meet = [math.comb(pool - h, bits) / math.comb(pool, bits) for h in range(most + 1)]
        lost = lambda tables: 1 - sum(c * (1 - (1 - p) ** tables) for c, p in zip(chance, meet, strict=False))  # noqa: B023, E731
        tables = 1
        while lost(tables) > 1 - recall:
            tables += 1 + tables // 64
        if best is None or tables * (24 + pool // 8) < best[0]:
            best = (tables * (24 + pool // 8), Plan(pool, bits, tables, most))
    return best[1]


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision, safe against overflow."""
    rows = raw.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def sketches(rows: np.ndarray, pool: int, seed: int = SEED) -> np.ndarray:
    """(vector, sign) truth values; the hyperplanes hang on the seed and the dimension."""
    return rows @ np.random.default_rng([seed, rows.shape[1]]).standard_normal((rows.shape[1], pool)) > 0


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """In how many signs each two sketches differ."""
    out = np.zeros((len(left), len(right)), np.uint16)
    for word in range(left.shape[1]):
        out += np.bitwise_count(left[:, word][:, None] ^ right[:, word][None, :])
    return out


def linked(left: np.ndarray, right: np.ndarray, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit rows at cosine or more; within one block each pair once."""
    products = left @ right.T
    a, b = np.nonzero(products >= cosine - 1e-9)
    if same:
        a, b = a[a < b], b[a < b]
    close = np.flatnonzero(products[a, b] < cosine + 1e-9)
    if len(close):  # the matrix product rounds otherwise than a plain sum does
        sure = np.ones(len(a), bool)
        for i in close.tolist():
            sure[i] = math.fsum((left[a[i]] * right[b[i]]).tolist()) >= cosine
        a, b = a[sure], b[sure]
    return a, b


def hang(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each index reaches by the pairs."""
    label = np.arange(count)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def met_first(a: np.ndarray, b: np.ndarray, masks: np.ndarray, table: int) -> np.ndarray:
    """Whether pairs of sketches share no bucket in a table before this one."""
    apart = a ^ b
    fresh = np.ones(len(a), bool)
    for mask in masks[:table]:
        fresh &= (apart & mask).any(axis=1)
    return fresh


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, pa.Array | np.ndarray]]:
    """The rows of each value of the keys, as columns; rows come sorted by them, and one value's rows are held at a time."""
    rest: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        own = np.column_stack([rows[k].to_numpy() for k in keys])
        begin = np.flatnonzero(np.append(True, (own[1:] != own[:-1]).any(axis=1))) if len(own) else np.zeros(0, np.int64)
        rows = rows.combine_chunks()
        columns = {c: rows[c].to_numpy() if pa.types.is_integer(rows[c].type) else rows[c] for c in rows.column_names}
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            yield {c: v[a:b] if isinstance(v, np.ndarray) else v.slice(a, b - a) for c, v in columns.items()}
        rest = rows.slice(int(begin[-1])) if len(begin) else rows
    if rest is not None and rest.num_rows:
        yield {c: rest[c].to_numpy() if pa.types.is_integer(rest[c].type) else rest[c] for c in rest.column_names}


def vector_links(docs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Links join vectors of one dimension whose cosine is `cosine` or more. Equal vectors form one
    class first, so a large group of copies is compared once. Null, empty and all-zero vectors and
    those with null or non-finite components link with nothing: n_links 0, their own component.
    A bucket of over BLOCK classes is cut into blocks that are compared in pairs by different tasks,
    none left out. Tasks return a count and one edge a vector, not the pairs they find, and a pair
    counts only in the first table that both share. A null vec_id is never a component's name
    unless the component has no other.
    """
    spark = docs.sparkSession
    ship(spark)
    element = docs.schema[vector_col].dataType.elementType.simpleString()
    kind, wide = ("float", "<f4") if element == "float" else ("double", "<f8")
    name = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))

    def keyed(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column("v")
                values, at = lists.values.to_numpy(zero_copy_only=False).astype(wide) + 0.0, lists.offsets.to_numpy()
                good = np.append(np.cumsum(~np.isfinite(values)), 0), np.append(np.cumsum(values != 0), 0)
                told: list[bytes | None] = []
                for i, here in enumerate(lists.is_valid().to_pylist()):
                    a, b = int(at[i]), int(at[i + 1])
                    fine = here and b > a and good[0][b - 1] == good[0][a - 1] * (a > 0) and good[1][b - 1] > good[1][a - 1] * (a > 0)
                    told.append(values[a:b].tobytes() if fine else None)
                digests = pa.array([t and hashlib.sha256(t).digest()[:16] for t in told], pa.binary())
                out = [batch.column("vec_id"), digests, *([pa.array(told, pa.binary())] if whole else [])]
                yield pa.RecordBatch.from_arrays(out, names=["vec_id", "digest", *(["raw"] if whole else [])])

        return run

    # A class is told by 128 bits of a cryptographic digest; vectors aren't sorted or joined by their components.
    known = rows.mapInArrow(keyed(True), f"vec_id {name}, digest binary, raw binary").where(F.col("raw").isNotNull())
    classes = known.groupBy("digest").agg(F.min("vec_id").alias("first"), F.count("*").alias("many"), F.max("raw").alias("raw"))
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()))
    told = plan(classes.count(), cosine, recall)
    words, masks = [f"s{i}" for i in range(told.words)], told.masks()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector's sketch, once for each table; the key is table and bucket, the dimension stands beside it."""
        picks, powers = told.picks(), 1 << np.arange(told.bits)
        for batch in batches:
            raws, cls = batch.column("raw").to_pylist(), batch.column("cls").to_numpy()
            sizes = np.array([len(r) for r in raws], np.int64)
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                signs = sketches(unit(np.frombuffer(b"".join(raws[i] for i in own.tolist()), wide).reshape(len(own), -1)), told.pool)
                sketch = np.packbits(signs, axis=1, bitorder="little").view(np.int64)
                for table in range(told.tables):
                    key = (signs[:, picks[table]] @ powers) + (table << 32)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(own), size, np.int32)), pa.array(cls[own]), *(pa.array(np.ascontiguousarray(sketch[:, w])) for w in range(told.words))], names=["key", "size", "cls", *words])

    sketch_kind = ", ".join(f"{w} long" for w in words)
    placed = classes.select("cls", "raw").mapInArrow(place, f"key long, size int, cls long, {sketch_kind}")
    counted = placed.groupBy("size", "key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    # Few buckets are full; written, their table has a size that the join goes by.
    placed = placed.join(stored(counted), ["size", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("cls", "key"), F.col("blocks"))).otherwise(0).cast("int")
    placed = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit_of = ["size", "key", "i", "j"]
    placed = placed.select("size", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", *words)
    placed = placed.repartition(*unit_of).sortWithinPartitions(*unit_of)

    def sides(group: dict) -> tuple[np.ndarray, np.ndarray, bool]:
        first, second = int(group["i"][0]), int(group["j"][0])
        left = np.flatnonzero(group["own"] == first)
        return left, left if first == second else np.flatnonzero(group["own"] == second), first == second

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members of a bucket that have a partner there which they haven't met in an earlier table."""
        found: list[tuple] = []
        for group in runs_of(batches, unit_of):
            if len(group["cls"]) < 2:
                continue
            left, right, same = sides(group)
            sketch = np.column_stack([group[w] for w in words]).view(np.uint64)
            near = distances(sketch[left], sketch[right]) <= told.most
            a, b = np.nonzero(np.triu(near, 1) if same else near)
            fresh = met_first(sketch[left[a]], sketch[right[b]], masks, int(group["key"][0] >> 32))
            some = np.unique(np.concatenate([left[a[fresh]], right[b[fresh]]]))
            if len(some):
                found.append(tuple(group[c][some] for c in (*unit_of, "own", "cls", *words)))
            if sum(len(f[0]) for f in found) >= BLOCK:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=[*unit_of, "own", "cls", *words])
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=[*unit_of, "own", "cls", *words])

    hoped = placed.mapInArrow(partners, f"size int, key long, i int, j int, own int, cls long, {sketch_kind}")
    hoped = hoped.join(classes.select("cls", "many", "raw"), "cls").repartition(*unit_of).sortWithinPartitions(*unit_of)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links among the vectors of a bucket, each pair in its first table: counts, and an edge a vector."""
        for group in runs_of(batches, unit_of):
            left, right, same = sides(group)
            vectors = unit(np.frombuffer(b"".join(group["raw"].to_pylist()), wide).reshape(len(group["cls"]), -1))
            sketch = np.column_stack([group[w] for w in words]).view(np.uint64)
            a, b = linked(vectors[left], vectors[right], same, cosine)
            a, b = left[a], right[b]
            fresh = met_first(sketch[a], sketch[b], masks, int(group["key"][0] >> 32))
            a, b = a[fresh], b[fresh]
            if len(a):
                cls, many = group["cls"], group["many"]
                counts = np.bincount(a, many[b], len(cls)) + np.bincount(b, many[a], len(cls))
                root, at = hang(len(cls), a, b), np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(cls[at]), pa.array(counts[at].astype(np.int64)), pa.array(cls[root[at]])], names=["cls", "links", "root"])

    found = cut(hoped.mapInArrow(compare, "cls long, links long, root long"))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(found, "cls", "root")
    named = classes.select("cls", "digest", "first", "many").join(links, "cls", "left").join(roots, F.col("cls") == F.col("node"), "left")
    named = named.select("digest", "first", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("root", "cls").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select(F.col("digest").alias("d"), "n_links", "component_id")
    own = rows.mapInArrow(keyed(False), f"vec_id {name}, digest binary")
    out = own.join(named, F.col("digest") == F.col("d"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("d").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
