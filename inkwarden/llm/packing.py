"""Best-fit packing into bins of several permitted lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import cut

#: Permitted lengths of a training sequence.
CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Documents that are packed together, on average.
SHARD = 8192
#: Cost of a bin of c tokens: c + STEP + c * c / REACH, for a step's fixed cost and for attention.
STEP, REACH = 64.0, 16384.0


def cost(capacity: int) -> float:
    """What a bin of so many tokens costs: its tokens, a step's fixed part, and attention."""
    return capacity + STEP + capacity * capacity / REACH


def best_fit(sizes: np.ndarray, capacities: tuple[int, ...] = CAPACITIES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, position in it) of each piece, and the capacity of each bin.

    Pieces come in order of falling size. A piece goes to the open bin it leaves the least
    room in, the oldest of equals; where it fits in none, the permitted length that costs
    least for each token it can hold (this piece and all that are still to come) is opened.
    In the end every bin shrinks to the least permitted length that holds its contents.
    """
    capacities = tuple(sorted(capacities))
    costs = [cost(c) for c in capacities]
    bins, positions = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    used: list[int] = []
    opened: list[int] = []
    by_room: dict[int, list[int]] = {}
    rooms, rest = 0, int(sizes.sum())  # rooms: bit r is set if a bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            own = by_room[room]
            b = own.pop(0)
            if not own:
                rooms &= ~(1 << room)
        else:
            ok = [k for k, c in enumerate(capacities) if c >= size]
            k = min(ok, key=lambda k: (costs[k] / max(1, min(capacities[k], rest)), k))
            b, room = len(used), capacities[k]
            used.append(0)
            opened.append(room)
        bins[i], positions[i] = b, used[b]
        used[b] += size
        by_room.setdefault(room - size, []).append(b)
        rooms |= 1 << (room - size)
        rest -= size
    final = np.array([next(c for c in capacities if c >= u) for u in used], np.int64)
    return bins, positions, final


def pack(docs: DataFrame, size: Column, id_col: str = "doc_id", capacities: tuple[int, ...] = CAPACITIES, shard: int = SHARD) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, bin_id, position, capacity.

    A document longer than the largest permitted length is cut into pieces of that length and
    one rest; others are one piece. A document without tokens is one piece of length 0.
    Documents are dealt by a hash of id, size and number among their equals to shards of about `shard`
    documents, and each shard is packed alone, so memory doesn't grow with the table and the same rows give the
    same bins however the input is split. Rows of one id and size can't be told apart and are packed as often as
    they come. An empty table gives no rows. bin_id is shard * 2**32 + number of the bin.
    """
    ship(docs.sparkSession)
    most = max(capacities)
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    own = cut(own.groupBy("doc_id", "size").agg(F.count("*").alias("many")))
    shards = max(1, -(-(own.agg(F.sum("many")).first()[0] or 0) // shard))
    many = F.greatest(F.lit(1), F.ceil(F.col("size") / most)).cast("int")
    # A row that is repeated without end becomes runs of a thousand first, so no array is long.
    runs = own.withColumn("run", F.explode(F.sequence(F.lit(0), (F.col("many") - 1).cast("long"), F.lit(1000))))
    rows = runs.withColumn("row", F.explode(F.sequence(F.col("run"), F.least(F.col("many") - 1, F.col("run") + 999))))
    parts = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "size", "row"), F.lit(shards)))
    parts = parts.withColumn("piece", F.explode(F.sequence(F.lit(0), many - 1)))
    parts = parts.withColumn("start", F.col("piece").cast("long") * most)
    parts = parts.withColumn("length", F.least(F.lit(most), F.col("size") - F.col("start")))
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).sort_by([("doc_id", "ascending"), ("size", "ascending"), ("row", "ascending"), ("piece", "ascending")])
        bins, positions, final = best_fit(rows["length"].to_numpy(), capacities)
        number = rows["shard"].to_numpy() * 2**32 + bins
        out = [*(rows[c] for c in ("doc_id", "piece", "start", "length")), pa.array(number), pa.array(positions), pa.array(final[bins])]
        yield from pa.table(out, names=["doc_id", "piece", "start", "length", "bin_id", "position", "capacity"]).to_batches()

    return parts.groupBy("shard").applyInArrow(run, f"doc_id {kind}, piece int, start long, length long, bin_id long, position long, capacity long")
