"""Suffix-array dedup of byte strings that also start in an earlier document.

Whether a string of LENGTH bytes occurs in a document of smaller id is a question about suffixes
that share their first LENGTH bytes. All suffixes of a corpus can't be sorted in one place, and
most share nothing, so they are dealt out by content first: every window of LENGTH bytes is named
by its anchor, the GRAM bytes in it of least hash, and equal windows have equal anchors. Anchors
that occur in one document only are settled by a short code; the windows of the others meet by
anchor and are sorted as suffixes there, by their first LENGTH bytes, a few at a time.
Contexts found equal by hash are compared byte by byte before anything is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext

from ..shipping import ship
from .common import cut, text_buffer
from .fingerprints import mixed

LENGTH, GRAM = 50, 24
#: Windows that share a least gram: LENGTH - GRAM + 1 places of it.
PLACES = LENGTH - GRAM + 1
#: Bytes of text packed into one row, windows hashed at once, codes of a bucket, about.
PACK, BLOCK, BUCKET = 4 << 20, 1 << 19, 1 << 21
#: An anchor in more packs than HOT is dealt out further by the SIDE bytes next to it, to buckets from SALTED on.
HOT, SIDE, SALTED = 64, (LENGTH - GRAM) // 2, 1 << 40
NEVER = np.iinfo(np.int64).max  # stands for a missing id: later than all others
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 20) - 1)
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse modulo 2**64, for i below n at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(18, (n - 1).bit_length())
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _POWERS.append(np.cumprod(step))
        del _POWERS[:-2]
    return _POWERS[0], _POWERS[1]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes; the string [a, b) hashes to (h[b] - h[a]) * base**-a."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def context_hash(raw: np.ndarray, length: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mixed(raw + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + place.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def context_hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring strings that fill data, a few thousand at a time."""
    out = np.empty(len(start), np.uint64)
    for i in range(0, len(start), 4096):
        own, size = start[i : i + 4096] - start[i], length[i : i + 4096]
        h = prefix_hashes(data[start[i] : start[i] + own[-1] + size[-1]])
        out[i : i + 4096] = context_hash((h[own + size] - h[own]) * powers(len(h))[1][own], size, place[i : i + 4096])
    return out


@dataclass
class Runs:
    """Neighbouring windows of one text with one anchor: starts first..last, anchor at first + place."""

    first: np.ndarray
    count: np.ndarray
    place: np.ndarray
    text: np.ndarray
    key: np.ndarray  #: hash of the anchor's bytes
    context: np.ndarray  #: hash of all bytes of the windows


def runs(data: np.ndarray, bounds: np.ndarray) -> Runs:
    """All windows within texts, as runs."""
    owner = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    parts = []
    for at in range(0, max(0, len(data) - LENGTH + 1), BLOCK):
        windows = min(BLOCK, len(data) - LENGTH + 1 - at)
        seg = data[at : at + windows + LENGTH - 1]
        inverse = powers(len(seg) + 1)[1]
        h = prefix_hashes(seg)
        grams = mixed((h[GRAM:] - h[:-GRAM]) * inverse[: len(h) - GRAM])
        least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)  # ties: the first
        width = 1
        while 2 * width <= PLACES:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[:windows], least[PLACES - width : PLACES - width + windows])
        anchor = (least & _LOW).astype(np.int64)
        text = owner[at : at + windows]
        valid = text == owner[at + LENGTH - 1 : at + LENGTH - 1 + windows]
        change = np.ones(windows, bool)
        change[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (valid[1:] != valid[:-1])
        starts = np.flatnonzero(change)
        counts = np.diff(np.append(starts, windows))
        ok = valid[starts]
        starts, counts = starts[ok], counts[ok]
        place = anchor[starts] - starts
        length = counts + LENGTH - 1
        key = mixed(grams[anchor[starts]] ^ np.uint64(0x5851F42D4C957F2D))
        parts.append((starts + at, counts, place, text[starts], key, context_hash((h[starts + length] - h[starts]) * inverse[starts], length, place)))
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int32, np.uint64, np.uint64)]
    return Runs(*columns)


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the strings at a and b of these lengths are equal, byte by byte."""
    out = np.ones(len(a), bool)
    for at in range(0, len(a), 1 << 15):
        x, y, n = a[at : at + (1 << 15)], b[at : at + (1 << 15)], length[at : at + (1 << 15)]
        offset = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(offset, n)
        differs = data[np.repeat(x, n) + step] != data[np.repeat(y, n) + step]
        out[at : at + (1 << 15)] = ~np.logical_or.reduceat(differs, offset) if len(differs) else True
    return out


def classes(data: np.ndarray, order: np.ndarray, code: np.ndarray, context: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether each place of order begins a class of equal (code, context); hash matches are verified."""
    c, x = code[order], context[order]
    new = np.ones(len(order), bool)
    new[1:] = (c[1:] != c[:-1]) | (x[1:] != x[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    rest = np.flatnonzero(~new)
    a, b = order[rest], order[head[rest]]
    alike = (length[a] == length[b]) & same_bytes(data, start[a], start[b], np.minimum(length[a], length[b]))
    if not alike.all():  # a collision: each of the odd ones stands alone, and so does what follows it
        new[rest[~alike]] = True
        new[np.minimum(rest[~alike] + 1, len(order) - 1)] = True
    return new


def ranked(data: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes by group (given ascending), then by their first LENGTH bytes, stable; which equal the one before them.

    All groups are sorted at once, a few bytes at a time: a round orders those that agree so far with a neighbour by
    the next bytes. So a group of any size costs LENGTH bytes a suffix at most, and those told apart early cost less.
    """
    order, same = np.arange(len(at)), np.append(False, group[1:] == group[:-1])[: len(at)]
    eight = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(8, np.uint8)), 8)
    done = 0
    while done < LENGTH:
        live = np.flatnonzero(same | np.append(same[1:], False)) if len(at) else order
        if not len(live):
            break
        rank = np.cumsum(~same[live]) - 1  # leaves room for as many bytes beside it in a key
        take = min(8, (64 - int(rank[-1]).bit_length()) // 8, LENGTH - done)
        key = eight[at[order[live]] + done].view(">u8")[:, 0].astype(np.uint64) >> np.uint64(64 - 8 * take)
        done += take
        if (key == key[~same[live]][rank]).all():
            continue
        if take < 8:
            key |= rank.astype(np.uint64) << np.uint64(8 * take)
        by = np.argsort(key, kind="stable")
        order[live], key = order[live[by]], key[by]
        same[live[1:]] = key[1:] == key[:-1]
    return order, same


def sort_suffixes(data: np.ndarray, hashes: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order alone; bytes are compared, so the hashes are not asked."""
    return ranked(data, at, group)[0]


def least_id(data: np.ndarray, at: np.ndarray, group: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each window at a suffix: the least id among equal windows of its group."""
    by = np.argsort(group, kind="stable")
    order, same = ranked(data, at[by], group[by])
    ids = ids[by]
    begin = np.flatnonzero(~same)
    least = np.minimum.reduceat(ids[order], begin) if len(begin) else ids[:0]
    out = np.empty(len(at), np.int64)
    out[by[order]] = np.repeat(least, np.diff(np.append(begin, len(order))))
    return out


def squeezed(raw: bytes) -> bytes:
    """Compressed harder than by default: moving and keeping these bytes costs more than packing them."""
    return pa.Codec("zstd", compression_level=9).compress(raw, asbytes=True)


def packed(docs: DataFrame, id_col: str, text_col: str, pack_bytes: int) -> DataFrame:
    """(pack, raw, ids, ends, body): texts of about pack_bytes a row, compressed, checkpointed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def row() -> pa.RecordBatch:
            whole = b"".join(texts)
            ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
            body = squeezed(whole) if whole else b""
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(whole)]), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([ends.tobytes()]), pa.array([body], pa.binary())], names=["pack", "raw", "ids", "ends", "body"])

        for batch in batches:
            data, bounds = text_buffer(batch.column("text"))
            keys = batch.column("doc_id").to_pylist()
            for i, key in enumerate(keys):
                ids.append(NEVER if key is None else key)
                texts.append(data[bounds[i] : bounds[i + 1]].tobytes())
                size += len(texts[-1])
                if size >= pack_bytes:
                    yield row()
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield row()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    packs = rows.mapInArrow(run, "pack long, raw long, ids binary, ends binary, body binary")
    return cut(packs)


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, bounds, ids) of a pack."""
    whole = pa.decompress(row["body"], row["raw"], codec="zstd", asbytes=True) if row["raw"] else b""
    return np.frombuffer(whole, np.uint8), np.concatenate([[0], np.frombuffer(row["ends"], np.int64)]), np.frombuffer(row["ids"], np.int64)


def coded(found: Runs, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the runs' anchors, the different ones in order, and each run's place among these."""
    code = found.key >> np.uint64(shift)
    different, place = np.unique(code, return_inverse=True)
    return code, different, place


@dataclass
class Parts:
    """What of a pack's contexts goes to which bucket: context number, first window of it, how many, ordered by bucket."""

    bucket: np.ndarray
    head: np.ndarray
    skip: np.ndarray
    count: np.ndarray

    def slices(self) -> Iterator[tuple[int, int, int]]:
        """(bucket, from, to)."""
        begin = np.flatnonzero(np.append(True, self.bucket[1:] != self.bucket[:-1])) if len(self.bucket) else np.zeros(0, np.int64)
        yield from zip(self.bucket[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(self.bucket)], strict=True) if len(begin) else ()


def parted(data: np.ndarray, found: Runs, head: np.ndarray, code: np.ndarray, hot: np.ndarray, salts: int) -> Parts:
    """Contexts whole by their anchor's bucket; those of hot anchors in two parts by what stands beside the anchor.

    A window with at least SIDE bytes before its anchor holds the SIDE bytes there, any other holds as many behind
    it; so equal windows still meet, and a phrase whose surroundings change is spread over all tasks.
    """
    cold, warm = np.flatnonzero(~hot), np.flatnonzero(hot)
    first, count, place = found.first[head], found.count[head], found.place[head]
    anchor = (first + place)[warm]
    left = np.clip(place[warm] - SIDE + 1, 0, count[warm])
    pieces = [((code[head[cold]] >> np.uint64(32)).astype(np.int64), cold, np.zeros(len(cold), np.int64), count[cold])]
    for side, at, skip, many in ((0, anchor - SIDE, np.zeros(len(warm), np.int64), left), (1, anchor + GRAM, left, count[warm] - left)):
        some = np.flatnonzero(many)
        beside = data[at[some][:, None] + np.arange(SIDE)].astype(np.uint64)
        salt = mixed((beside + np.uint64(1)) @ powers(SIDE)[0][1 : SIDE + 1] + code[head[warm[some]]] * np.uint64(2) + np.uint64(side))
        pieces.append((SALTED + (salt % np.uint64(salts)).astype(np.int64), warm[some], skip[some], many[some]))
    bucket, number, skip, many = (np.concatenate(c) for c in zip(*pieces, strict=True))
    by = np.argsort(bucket, kind="stable")
    return Parts(bucket[by], number[by], skip[by], many[by])


def _by_bucket(code: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of the slices of ascending codes."""
    if not len(code):
        return
    bucket = (code >> np.uint64(32)).astype(np.int64)
    begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    yield from zip(bucket[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(bucket)], strict=True)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pack_bytes: int = PACK) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    A byte is removed if a string of LENGTH bytes that covers it also starts in a row of a smaller
    doc_id; strings don't cross rows and are judged on the input. Null texts are empty; texts below
    LENGTH bytes keep all. Rows of one id don't count as earlier than each other; rows without an id
    are later than all others and return a null id. An empty table gives no rows. Ids must be whole numbers.
    """
    if not isinstance(docs.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        raise TypeError(f"{id_col} must hold whole numbers, not {docs.schema[id_col].dataType.simpleString()}")
    ship(docs.sparkSession)
    packs = packed(docs, id_col, text_col, pack_bytes)
    total = packs.agg(F.coalesce(F.sum("raw"), F.lit(0))).first()[0]
    # Codes have 32 bits besides the bucket's: more data, more buckets, longer codes.
    bits = max(6, int(total * 2 / (PLACES + 1) / BUCKET).bit_length())
    shift, salts = 32 - bits, 4 << bits

    def announce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each pack and bucket: the different codes, and which of them lie in several rows."""
        for batch in batches:
            for pack in batch.to_pylist():
                data, bounds, _ = unpacked(pack)
                found = runs(data, bounds)
                code, different, place = coded(found, shift)
                order = np.argsort(place, kind="stable")  # texts stay in order within a code
                begin = np.searchsorted(place[order], np.arange(len(different) + 1))
                several = found.text[order[begin[:-1]]] != found.text[order[begin[1:] - 1]]
                low = different.astype(np.uint32)
                rows = [(b, pack["pack"], low[i:j].tobytes(), np.packbits(several[i:j]).tobytes()) for b, i, j in _by_bucket(different)]
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(("bucket", "pack", "codes", "several"), r, strict=True)) for r in rows], schema=pa.schema([("bucket", pa.int64()), ("pack", pa.int64()), ("codes", pa.binary()), ("several", pa.binary())]))

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Which codes of each pack occur in several rows anywhere, and which of these in many packs."""
        told = pa.Table.from_batches(list(batches)).to_pylist()
        sizes = [len(t["codes"]) // 4 for t in told]
        codes = np.frombuffer(b"".join(t["codes"] for t in told), np.uint32)
        several = np.concatenate([np.unpackbits(np.frombuffer(t["several"], np.uint8), count=n) for t, n in zip(told, sizes, strict=True)]).astype(bool)
        order = np.argsort(codes, kind="stable")
        c = codes[order]
        same = np.zeros(len(c), bool)
        same[1:] = c[1:] == c[:-1]
        same[:-1] |= same[1:]
        shared = several.copy()
        shared[order] |= same
        begin = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else np.zeros(0, np.int64)
        many = np.diff(np.append(begin, len(c)))
        hot = np.zeros(len(c), bool)
        hot[order] = np.repeat(many > HOT, many)
        ends = np.cumsum(sizes)
        rows = []
        for t, a, b in zip(told, ends - sizes, ends, strict=True):
            if shared[a:b].any():
                told_of = [(0, shared[a:b]), *([(2, hot[a:b])] if hot[a:b].any() else [])]
                rows += [{"pack": t["pack"], "kind": kind, "bucket": t["bucket"], "body": np.packbits(bits).tobytes()} for kind, bits in told_of]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ANSWER)

    def settle(pack: dict, answers: list[dict]):
        """Runs with a shared anchor, ordered in classes of equal context: (data, bounds, ids, runs, order, new, codes, parts)."""
        data, bounds, ids = unpacked(pack)
        found = runs(data, bounds)
        code, different, place = coded(found, shift)
        shared, hot = np.zeros(len(different), bool), np.zeros(len(different), bool)
        bodies = {(x["kind"], x["bucket"]): x["body"] for x in answers if x["kind"] != 1}
        for b, i, j in _by_bucket(different):
            for kind, bits in ((0, shared), (2, hot)):
                if (kind, b) in bodies:
                    bits[i:j] = np.unpackbits(np.frombuffer(bodies[kind, b], np.uint8), count=j - i)
        kept = np.flatnonzero(shared[place])
        order = kept[np.lexsort((kept, ids[found.text[kept]], found.context[kept], code[kept]))]
        new = classes(data, order, code, found.context, found.first, found.count + LENGTH - 1)
        head = order[new]
        return data, bounds, ids, found, order, new, code, parted(data, found, head, code, hot[place[head]], salts)

    def send(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """Of each pack and bucket: every different context of a shared anchor, with its least id."""
        out = []
        for pack in left.to_pylist():
            data, _, ids, found, order, new, code, parts = settle(pack, right.to_pylist())
            head = order[new][parts.head]
            first, place = found.first[head] + parts.skip, found.place[head] - parts.skip
            length = parts.count + LENGTH - 1
            for b, i, j in parts.slices():
                n = length[i:j]
                step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                body = b"".join(x.tobytes() for x in (code[head[i:j]].astype(np.uint32), ids[found.text[head[i:j]]], place[i:j].astype(np.uint8), parts.count[i:j].astype(np.uint8), data[np.repeat(first[i:j], n) + step]))
                out.append({"bucket": b, "pack": pack["pack"], "many": j - i, "raw": len(body), "body": squeezed(body)})
        return pa.Table.from_pylist(out, schema=_SENT)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each context: which of its windows equal one of a smaller id elsewhere."""
        sent = pa.Table.from_batches(list(batches)).to_pylist()
        columns: list[list[np.ndarray]] = [[], [], [], [], []]
        for s in sent:
            body, at, n = pa.decompress(s["body"], s["raw"], codec="zstd", asbytes=True), 0, s["many"]
            for column, kind in zip(columns, (np.uint32, np.int64, np.uint8, np.uint8), strict=False):
                column.append(np.frombuffer(body, kind, n, at))
                at += n * np.dtype(kind).itemsize
            columns[4].append(np.frombuffer(body, np.uint8, -1, at))
        code, ids, place, count, data = (np.concatenate(c) for c in columns)
        place, count = place.astype(np.int64), count.astype(np.int64)
        length = count + LENGTH - 1
        start = np.cumsum(length) - length
        context = context_hashes(data, start, length, place)
        order = np.lexsort((ids, context, code))
        new = classes(data, order, code, context, start, length)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        head = order[new]  # of least id in its class
        masks = np.where(ids[head][number] < ids, (np.uint32(1) << count.astype(np.uint32)) - np.uint32(1), np.uint32(0)).astype(np.uint32)
        # Anchors with different contexts: their windows are compared as suffixes.
        c = code[head]
        torn = np.zeros(len(head), bool)
        torn[1:] = c[1:] == c[:-1]
        torn[:-1] |= torn[1:]
        some = np.flatnonzero(torn)
        n = count[head[some]]
        which = np.repeat(some, n)
        window = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        group = c[which].astype(np.int64) * 64 + (place[head[which]] - window)
        by = np.argsort(group, kind="stable")
        g = group[by]
        alone = np.append(True, g[1:] != g[:-1]) & np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool)
        use = by[~alone]
        least = np.full((len(head), PLACES), NEVER, np.int64)
        least[which, window] = ids[head[which]]
        if len(use):  # only the strings in question are laid out for sorting
            own = np.unique(which[use])
            n = length[head[own]]
            at = np.cumsum(n) - n
            small = data[np.repeat(start[head[own]], n) + np.arange(int(n.sum())) - np.repeat(at, n)]
            least[which[use], window[use]] = least_id(small, at[np.searchsorted(own, which[use])] + window[use], group[use], ids[head[which[use]]])
        mine = np.flatnonzero(torn[number])
        exact = np.zeros(len(mine), np.uint32)
        for w in range(PLACES):
            exact |= ((least[number[mine], w] < ids[mine]) & (w < count[mine])).astype(np.uint32) << np.uint32(w)
        masks[mine] = exact
        at, rows = 0, []
        for s in sent:
            own = masks[at : at + s["many"]]
            at += s["many"]
            rows.append({"pack": s["pack"], "kind": 1, "bucket": s["bucket"], "body": pa.compress(own.tobytes(), codec="zstd", asbytes=True)})
        yield pa.RecordBatch.from_pylist(rows, schema=_ANSWER)

    def remove(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for pack in left.to_pylist():
            answers = right.to_pylist()
            data, bounds, ids, found, order, new, code, parts = settle(pack, answers)
            head = order[new]
            masks = np.zeros(len(head), np.uint32)
            bodies = {x["bucket"]: x["body"] for x in answers if x["kind"] == 1}
            for b, i, j in parts.slices():
                told = np.frombuffer(pa.decompress(bodies[b], 4 * (j - i), codec="zstd", asbytes=True), np.uint32)
                np.bitwise_or.at(masks, parts.head[i:j], told << parts.skip[i:j].astype(np.uint32))
            number = np.cumsum(new) - 1
            own = ids[found.text[order]]
            count = found.count[order]
            full = (np.uint32(1) << count.astype(np.uint32)) - np.uint32(1)
            mask = np.where(own > ids[found.text[head]][number], full, masks[number]) if len(order) else masks
            delta = np.zeros(len(data) + 1, np.int32)
            whole = mask == full
            np.add.at(delta, found.first[order[whole]], 1)
            np.add.at(delta, found.first[order[whole]] + count[whole] + LENGTH - 1, -1)
            partly = np.flatnonzero((mask != 0) & ~whole)
            for w in range(PLACES):
                hit = found.first[order[partly[(mask[partly] >> np.uint32(w)) & np.uint32(1) == 1]]] + w
                np.add.at(delta, hit, 1)
                np.add.at(delta, hit + LENGTH, -1)
            gone = np.cumsum(delta[:-1]) > 0
            for i, doc in enumerate(ids.tolist()):
                mine, text = gone[bounds[i] : bounds[i + 1]], data[bounds[i] : bounds[i + 1]]
                starts = int(mine[:1].sum()) + int(np.count_nonzero(mine[1:] & ~mine[:-1]))
                out.append((None if doc == NEVER else doc, len(text), int(mine.sum()), starts, hashlib.sha256(text[~mine].tobytes()).hexdigest()))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    answer = "pack long, kind int, bucket long, body binary"
    announced = packs.mapInArrow(announce, "bucket long, pack long, codes binary, several binary")
    shared = cut(announced.groupBy("bucket").applyInArrow(share, answer))
    sent = packs.groupBy("pack").cogroup(shared.groupBy("pack")).applyInArrow(send, "bucket long, pack long, many long, raw long, body binary")
    judged = sent.groupBy("bucket").applyInArrow(compare, answer)
    told = shared.unionByName(judged)
    return packs.groupBy("pack").cogroup(told.groupBy("pack")).applyInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


_ANSWER = pa.schema([("pack", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("body", pa.binary())])
_SENT = pa.schema([("bucket", pa.int64()), ("pack", pa.int64()), ("many", pa.int64()), ("raw", pa.int64()), ("body", pa.binary())])
