"""MinHash document fingerprints: universal hash permutations over word shingles, in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .common import CHUNK, partitions, pieces, stored, text_buffer
from .components import components

#: Words of a shingle, permutations, and bits kept of each minimum.
SHINGLE, PERMUTATIONS, BITS = 5, 128, 16
SEED = 77003
#: Bytes of text in a range of ids, about; nodes that every task may be told of.
RANGE, FEW = 32 << 20, 1 << 20
#: Near duplicates share SIMILARITY of their shingles; BANDS bands of ROWS minima meet such a pair but once in 20,000 times.
SIMILARITY, BANDS, ROWS = 0.8, 25, 5
#: Words hashed, and shingles permuted, at once; a longer word than LONG goes through BLAKE2.
_WORDS, _SHINGLES, LONG = 1 << 17, 1 << 14, 1 << 16

_RNG = np.random.default_rng(SEED)
_MULTIPLY = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64)
_PLACE = _RNG.integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.cumprod(np.full(LONG, 0x9E3779B97F4A7C15, np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers, spread."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of other than U+0020 and U+0009 to U+000D), and where each text's begin."""
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    begins[first] = inside[first]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:]
    last = bounds[1:][bounds[:-1] < bounds[1:]] - 1
    finishes[last] = inside[last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    out = np.empty(len(starts), np.uint64)
    lengths = ends - starts
    for at in range(0, len(starts), _WORDS):
        own, size = starts[at : at + _WORDS], lengths[at : at + _WORDS]
        short = np.minimum(size, LONG)
        offset = np.cumsum(short) - short
        place = np.arange(int(short.sum())) - np.repeat(offset, short)
        values = (data[np.repeat(own, short) + place].astype(np.uint64) + np.uint64(1)) * _POWERS[place]
        out[at : at + _WORDS] = np.add.reduceat(values, offset) if len(values) else 0
        for i in np.flatnonzero(size > LONG).tolist():
            digest = hashlib.blake2b(data[own[i] : own[i] + size[i]].tobytes(), digest_size=8).digest()
            out[at + i] = np.frombuffer(digest, np.uint64)[0]
    return mixed(out), np.searchsorted(starts, bounds)


def shingle_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of SHINGLE words, and where each text's begin.

    A text of fewer words has one, the whole sequence; one without words has none.
    """
    words, at = word_hashes(data, bounds)
    many = np.diff(at)
    counts = np.where(many > 0, np.maximum(many - SHINGLE + 1, 1), 0)
    begins = np.concatenate([[0], np.cumsum(counts)])
    start = np.arange(begins[-1]) - np.repeat(begins[:-1] - at[:-1], counts)
    stop = np.repeat(at[1:], counts)
    padded = np.concatenate([words, np.zeros(SHINGLE, np.uint64)])
    total = np.zeros(len(start), np.uint64)
    for k in range(SHINGLE):
        total += np.where(start + k < stop, padded[start + k], np.uint64(0)) * _PLACE[k]
    return mixed(total), begins


def signatures(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(text, permutation) minima, BITS of a hash of each; all ones where a text has no words.

    Minima of long texts are small numbers, so their own top bits would say little.
    """
    shingles, begins = shingle_hashes(data, bounds)
    least = np.full((len(bounds) - 1, PERMUTATIONS), 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), _SHINGLES):
        part = shingles[at : at + _SHINGLES]
        first = int(np.searchsorted(begins, at, side="right")) - 1
        last = int(np.searchsorted(begins, at + len(part), side="left"))
        texts = np.arange(first, last)
        texts = texts[begins[texts] < begins[texts + 1]]
        edges = np.maximum(begins[texts] - at, 0)
        scratch = np.empty_like(part)
        block = np.empty((len(texts), PERMUTATIONS), np.uint64)
        for k in range(PERMUTATIONS):
            np.multiply(part, _MULTIPLY[k], out=scratch)
            np.add(scratch, _ADD[k], out=scratch)
            np.minimum.reduceat(scratch, edges, out=block[:, k])
        least[texts] = np.minimum(least[texts], block)
    kept = (mixed(least) >> np.uint64(64 - BITS)).astype(np.uint16)
    kept[begins[1:] == begins[:-1]] = 2**BITS - 1
    return kept


def of_texts(texts: list[bytes]) -> np.ndarray:
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return signatures(np.frombuffer(b"".join(texts), np.uint8), bounds)


def written(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def edit(text: str, following: str) -> str:
    """The last half of a text's code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _squeezed(text: Column) -> Column:
    """A text's bytes compressed, behind their number: half of what the shuffle's own compression leaves."""

    def run(texts: pa.Array) -> pa.Array:
        codec = pa.Codec("zstd", compression_level=3)
        return pa.array([len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True) for t in texts.cast(pa.binary()).to_pylist()], pa.binary())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "binary")(text)


def _loosened(body: bytes) -> bytes:
    return pa.decompress(body[8:], int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True)


def _in_order(docs: DataFrame, id_col: str, text_col: str, classes: DataFrame | None = None) -> DataFrame:
    """Texts by ranges of doc_id, each range sorted and followed by the first text of the next.

    The ends of ranges are quantiles that exist as ids, so each is the first of its range; that one
    document is sent to the range before as well (guest), the very first to the last. There are as many
    ranges as shuffle partitions, and more where these would hold over RANGE bytes. Only one id a
    range comes to the driver. Rows without an id precede all others. Ids must be whole numbers.
    """
    if not isinstance(docs.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        raise TypeError(f"{id_col} must hold whole numbers, not {docs.schema[id_col].dataType.simpleString()}")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    low, nulls, size = rows.agg(F.min("doc_id"), F.count_if(F.col("doc_id").isNull()), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    wanted = max(partitions(docs.sparkSession), -(-size // RANGE))
    shares = [k / wanted for k in range(1, wanted)] or [0.5]
    ends = rows.agg(F.percentile_approx("doc_id", shares, 100 * wanted)).first()[0]
    ends = sorted({e for e in ends or [] if e > low or nulls})

    @F.pandas_udf("boolean")
    def leading(ids: pd.Series) -> pd.Series:
        return ids.isin(ends)

    @F.pandas_udf("int")
    def number(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), np.int32)
        out[known] = np.searchsorted(np.array(ends, np.int64), ids[known].to_numpy(np.int64), side="right")
        return pd.Series(out)

    rows = rows.withColumn("range", number("doc_id"))
    very_first = F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(low)
    leads = very_first | leading("doc_id")
    before = F.when(F.col("range") > 0, F.col("range") - 1).otherwise(F.lit(len(ends)))
    twice = F.array(F.struct("range", F.lit(0).alias("guest")), F.struct(before.alias("range"), F.lit(1).alias("guest")))
    once = F.array(F.struct("range", F.lit(0).alias("guest")))
    rows = rows.select("doc_id", F.xxhash64("text").alias("tie"), _squeezed(F.col("text")).alias("body"), "range", leads.alias("leads"))
    rows = rows.select("doc_id", "tie", "body", F.explode(F.when(F.col("leads"), twice).otherwise(once)).alias("to")).select("doc_id", "tie", "body", "to.*")
    if classes is not None:  # a class goes before the texts of its range
        told = classes.select("doc_id", F.lit(0).cast("long").alias("tie"), F.lit(None).cast("binary").alias("body"), number("doc_id").alias("range"), F.lit(-1).alias("guest"), F.unhex("digest").alias("digest"), "class_id").distinct()
        rows = rows.unionByName(told, allowMissingColumns=True)
    return rows.repartitionById(len(ends) + 1, "range").sortWithinPartitions("range", "guest", "doc_id", "tie")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: DataFrame | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, and class_id if near_duplicates() of the same documents is given. Null texts are empty;
    texts without words have a fingerprint of ones, alike to each other only. Documents of one id follow each other
    by a hash of the text. A lone document is followed by itself. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    ordered = _in_order(docs, id_col, text_col, classes)
    classed = classes is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # (range, doc_id, text, signature): its follower isn't here yet
        number, known = None, {}  # classes of the texts of this range
        for batch in pieces(batches, "body", CHUNK // 4):
            columns = [batch.column(c).to_pylist() for c in ("range", "guest", "doc_id", "body", *(("digest", "class_id") if classed else ()))]
            rows = list(zip(*columns, strict=True))
            raws = [_loosened(r[3]) for r in rows if r[1] >= 0]
            own = iter(zip(raws, of_texts(raws), strict=True))
            pairs = []
            for row in rows:
                if row[0] != number:
                    number, known = row[0], {}
                if row[1] < 0:
                    known[row[4]] = row[5]
                    continue
                raw, signature = next(own)
                here = (row[0], row[2], raw.decode(), signature)
                if waiting and waiting[0] == here[0]:
                    pairs.append((waiting, here, known[hashlib.md5(waiting[2].encode()).digest()] if classed else None))
                waiting = None if row[1] else here
            if pairs:
                edited = [edit(a[2], b[2]).encode() for a, b, _ in pairs]
                changed = of_texts(edited)
                out = [
                    pa.array([a[1] for a, _, _ in pairs], batch.schema.field("doc_id").type),
                    pa.array([len(a[2]) for a, _, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                    pa.array([written(a[3]) for a, _, _ in pairs]),
                    pa.array([written(c) for c in changed]),
                    pa.array([float((a[3] == c).mean()) for (a, _, _), c in zip(pairs, changed, strict=True)]),
                    pa.array([float((a[3] == b[3]).mean()) for a, b, _ in pairs]),
                    *([pa.array([c for _, _, c in pairs], batch.schema.field("doc_id").type)] if classed else []),
                ]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", *(["class_id"] if classed else [])])

    kind = ordered.schema["doc_id"].dataType.simpleString()
    return ordered.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double{f', class_id {kind}' if classed else ''}")


def banded(signature: np.ndarray) -> np.ndarray:
    """(text, band) hashes of ROWS minima each."""
    rows = signature[:, : BANDS * ROWS].reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    return mixed((rows * _PLACE[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def jaccard(left: bytes, right: bytes) -> float:
    """The share of shingles that two texts have in common; two texts without any are alike."""
    sets = []
    for text in (left, right):
        hashes, _ = shingle_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        sets.append(np.unique(hashes))
    both = len(np.intersect1d(*sets, assume_unique=True))
    return both / (len(sets[0]) + len(sets[1]) - both) if len(sets[0]) + len(sets[1]) else 1.0


def _texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, body) of the nodes wanted, from rows of (key, text).

    Few nodes, FEW at most, are told to every task as numbers of 8 bytes, and other rows' texts go nowhere. More are
    joined. A key that only shares its first 8 bytes with a wanted one falls out in the join that follows either way.
    """
    count = wanted.count()
    if count <= FEW:
        first = lambda keys: np.frombuffer(b"".join(k[:8] for k in keys), np.int64)
        known = np.sort(first([r["key"] for r in wanted.select("key").toLocalIterator()]))
        shared = rows.sparkSession.sparkContext.broadcast(known)

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = first(batch.column("key").to_pylist())
                at = np.minimum(np.searchsorted(shared.value, own), max(0, len(shared.value) - 1))
                yield batch.filter(pa.array(shared.value[at] == own if len(shared.value) else np.zeros(len(own), bool)))

        rows = rows.mapInArrow(keep, "key binary, text string")
    found = rows.select("key", _squeezed(F.col("text")).alias("body")).groupBy("key").agg(F.max("body").alias("body"))
    return found.join(wanted, "key").select("node", "body")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose texts are as alike as that."""

    @F.pandas_udf("double")
    def likeness(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([jaccard(_loosened(x), _loosened(y)) for x, y in zip(left, right, strict=True)])

    one = texts.select(F.col("node").alias("a"), F.col("body").alias("x"))
    two = texts.select(F.col("node").alias("b"), F.col("body").alias("y"))
    return pairs.join(one, "a").join(two, "b").where(likeness("x", "y") >= similarity).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, digest, class_id): classes of texts linked by Jaccard similarity of word shingles; digest is the text's MD5.

    Equal texts are one node. Nodes that share a band meet; each is compared with the least node of its bucket,
    and what that links is merged. Only where a bucket then still holds several classes are members of different
    classes compared with each other, so a large group of near copies costs one comparison a member and no link is
    lost. Similarities are exact, from the texts; only texts that share a band with another one travel. class_id
    is the least id in the class, null if none of its rows has one. Null texts are empty.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            hashes = banded(signatures(*text_buffer(batch.column("text"))))
            lists = pa.ListArray.from_arrays(np.arange(len(hashes) + 1, dtype=np.int32) * BANDS, hashes.reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), lists], names=["doc_id", "key", "bands"])

    signed = rows.mapInArrow(run, f"doc_id {kind}, key binary, bands array<bigint>")
    nodes = signed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()))
    placed = nodes.select("node", F.explode("bands").alias("h"))
    buckets = stored(placed.groupBy("h").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n"))
    members = stored(placed.join(buckets, "h"))
    wanted = stored(members.select("node").distinct().join(nodes.select("node", "key"), "node"))
    texts = stored(_texts_of(rows.select("key", "text"), wanted))
    star = members.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    first = stored(_verified(star, texts, similarity))
    roots = components(first).withColumnRenamed("node", "__node")
    classed = members.join(roots, F.col("node") == F.col("__node"), "left").select("h", "node", "lead", F.coalesce("root", "node").alias("root"))
    split = classed.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("h")
    rest = stored(classed.join(split, "h").where("node <> lead"))
    one, two = (rest.select("h", F.col("node").alias(n), F.col("root").alias(f"root_{n}")) for n in ("a", "b"))
    cross = one.join(two, "h").where("root_a < root_b").select("a", "b").distinct()
    final = components(stored(first.unionByName(_verified(cross, texts, similarity)))).withColumnRenamed("node", "__node")
    named = nodes.select("key", "node", "rep").join(final, F.col("node") == F.col("__node"), "left").select("key", "rep", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("class_id"))
    named = named.join(least, "root").select("key", "class_id")
    return rows.select("doc_id", "key").join(named, "key").select("doc_id", F.lower(F.hex("key")).alias("digest"), "class_id")
