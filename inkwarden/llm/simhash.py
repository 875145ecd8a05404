"""SimHash near-dedup: 64-bit fingerprints, linked through the anchors of a covering code.

Anchors: a fingerprint is two blocks of 32 bits. If two fingerprints differ in at most 3 bits,
one block differs in at most 1. In a block, 31 bits are covered by the perfect Hamming code
(every word is within 1 of exactly one codeword) and the last bit stands for itself, so each
block has one home anchor within the covering radius 1, and whoever links with it through this
block is within 1 + 1 of that anchor. Each fingerprint is therefore kept at its home anchors
and sent to all anchors within distance 2, and compared there: no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import SPACES, cut, partitions, unused
from .components import components

#: Words of a shingle, and bits that linked fingerprints may differ in.
SHINGLE, THRESHOLD = 3, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hashes whose bits are counted at once.
_ROWS = 1 << 16


def _fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes, as a signed 64-bit number; none give zero."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _ROWS):
        part = np.ascontiguousarray(hashes[at : at + _ROWS]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def _digest(text: Column) -> Column:
    """128 bits of a text; a null one is empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, digest: bool = False) -> DataFrame:
    """(doc_id, fp): fp is the SimHash of a text's word shingles as a signed long; also a digest of the text if asked for.

    Texts with fewer words than a shingle have one, the whole sequence; null, empty and blank
    texts have none and fp 0. Repeated rows stay. The shingles' XXH64 come from the JVM.
    """
    ship(docs.sparkSession)
    words = F.array_remove(F.split(F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER), SPACES), "")
    rows = docs.select(F.col(id_col).alias("doc_id"), words.alias("w"), *([_digest(F.col(text_col)).alias("digest")] if digest else []))
    many = F.size("w") - (shingle - 1)
    hashed = F.when(many >= 1, F.transform(F.sequence(F.lit(1), F.greatest(many, F.lit(1))), lambda i: F.xxhash64(F.concat_ws(" ", *(F.get(F.col("w"), i + (k - 1)) for k in range(shingle))))))
    hashed = hashed.when(F.size("w") > 0, F.array(F.xxhash64(F.concat_ws(" ", "w")))).otherwise(F.expr("array()").cast("array<bigint>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("h")
            values, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            fps = [_fingerprint(values[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            kept = [batch.column(c) for c in ("doc_id", "digest") if c == "doc_id" or digest]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(fps, pa.int64())], names=["doc_id", *(["digest"] if digest else []), "fp"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.withColumn("h", hashed).drop("w").mapInArrow(run, f"doc_id {kind}, {'digest binary, ' if digest else ''}fp long")


def _anchors(block: Column, number: int) -> tuple[Column, Column]:
    """(home anchor, all anchors within distance 2) of a block of 32 bits."""
    word, free = block.bitwiseAND(F.lit(0x7FFFFFFF)), block.bitwiseAND(F.lit(0x80000000))
    syndrome = F.lit(0).cast("int")
    for k in range(5):
        mask = sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1)
        syndrome = syndrome + F.shiftleft(F.bit_count(word.bitwiseAND(F.lit(mask))) % 2, k)

    def flip(value: Column, position: Column) -> Column:
        return value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), (position - 1).cast("int")))

    home = F.when(syndrome == 0, word).otherwise(flip(word, F.greatest(syndrome, F.lit(1))))
    named = lambda c, f: c.bitwiseOR(f).bitwiseOR(F.lit(number << 32))
    pairs = F.filter(F.sequence(F.lit(1), F.lit(31)), lambda i: (syndrome != 0) & (i != syndrome) & (i < i.bitwiseXOR(syndrome)))
    others = F.transform(pairs, lambda i: named(flip(flip(word, i), i.bitwiseXOR(syndrome)), free))
    return named(home, free), F.concat(F.array(named(home, free), named(home, free.bitwiseXOR(F.lit(0x80000000)))), others)


def links(fps: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of different fingerprints within THRESHOLD bits, some more than once.

    fps has one row per different fingerprint (column fp).
    """
    parts = [_anchors(F.shiftrightunsigned("fp", 32), 0), _anchors(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), 1)]
    homes = fps.select(F.col("fp").alias("a"), F.explode(F.array(*(h for h, _ in parts))).alias("anchor"))
    visits = fps.select(F.col("fp").alias("b"), F.explode(F.concat(*(v for _, v in parts))).alias("at"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= THRESHOLD
    # Spark takes a table for no larger than before its anchors were listed; a broadcast by that size fills the driver.
    return homes.join(visits.hint("merge"), (F.col("anchor") == F.col("at")) & (F.col("a") < F.col("b")) & near).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, digest: bool = False) -> DataFrame:
    """(doc_id, fp, component_id): fingerprints linked at THRESHOLD or fewer differing bits; also a digest of the text if asked for.

    component_id is the least doc_id that links reach, the document's own included. Equal
    fingerprints (exact copies, all empty texts) are one node, so a large group of copies costs
    one comparison; a null doc_id is kept and never named as a component, unless all ids in
    the component are null.
    """
    own = cut(fingerprints(docs, id_col, text_col, shingle, digest))
    nodes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    # Nodes are small and come in few pieces, but each has some thirty anchors.
    roots = components(links(nodes.select("fp").repartition(partitions(docs.sparkSession), "fp")))
    # Below its threshold Spark would broadcast whole columns of the table: each join here merges.
    placed = nodes.join(roots.hint("merge"), nodes["fp"] == roots["node"], "left").select(F.col("fp").alias("node"), F.coalesce("root", "fp").alias("root"), "first")
    # The key as an aggregate is dealt out anew, and a large component's rows can be split.
    least = placed.groupBy("root").agg(F.max("root").alias("top"), F.min("first").alias("component_id")).drop("root")
    named = placed.join(least.hint("merge"), F.col("root") == F.col("top")).select("node", "component_id")
    return own.join(named.hint("merge"), F.col("fp") == F.col("node")).select("doc_id", *(["digest"] if digest else []), "fp", "component_id")


def shown(fp: Column) -> Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose doc_id is its component's; all columns stay.

    Judged by id and text together: a row leaves if its text's component has a smaller id, whatever other
    rows of its id hold. Rows of one id in one component all stay, as do rows without an id.
    """
    found = near_duplicates(docs, id_col, text_col, digest=True)
    gone, text = unused("__gone", docs.columns), unused("__digest", docs.columns)
    losers = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(gone), F.col("digest").alias(text)).distinct()
    return docs.join(losers, (F.col(id_col) == F.col(gone)) & (_digest(F.col(text_col)) == F.col(text)), "left_anti")
