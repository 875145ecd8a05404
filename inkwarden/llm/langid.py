"""Language ID by cross-parsing: the language whose sample explains a text in the fewest phrases.

A suffix automaton per language recognises every substring of that language's sample.
A text is parsed greedily into longest substrings of the sample; the number of phrases,
times the bits that point at a place in the sample, per letter, is an estimate of the
cross entropy. The language of the least cost wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import CHUNK, pieces, text_buffer, unused

#: Bytes of labelled text that each language's automaton holds, documents they are taken from at most, and
#: characters that one document gives: so many slices, evenly spread over its whole text.
SAMPLE_BYTES, SAMPLE_DOCS, SHARE, SLICES = 20_000, 64, 640, 4
#: Languages that one parser may hold: each is some megabytes that every worker keeps.
MOST_LANGUAGES = 200
#: Symbols that a lane of the parse holds; a phrase ends where a lane does.
LANE = 512
#: Phrases a symbol from which on a text is unlike every language, and characters below which that can't be told.
#: On sf0.1 texts of that length reach 0.43; uniform random letters, words and base64 have 0.61 and more.
MAX_RATE, TELLING = 0.55, 64
UNKNOWN = "und"


class CrossParser:
    """Suffix automata of all languages as one transition array.

    Rows are states, columns symbols; a cell is (row offset of the next state) * 4, plus the phrases
    that end there: one where the longest match ends and the next begins with this symbol, or where a
    symbol unknown to the sample stands alone; two where both happen.
    """

    def __init__(self, samples: dict[str, bytes]) -> None:
        self.languages = list(samples)  # the first wins a tie
        letters = [b for b in sorted(set(b"".join(samples.values()))) if b >= 0x80 or 97 <= b <= 122]
        self.symbols = np.zeros(256, np.uint8)  # 0: whatever separates letters
        for at, byte in enumerate(letters, 1):
            self.symbols[byte] = at
        for byte in range(65, 91):
            self.symbols[byte] = self.symbols[byte + 32]
        self.width = len(letters) + 1
        tables, self.roots, self.bits, base = [], [], [], 0
        for language in self.languages:
            codes = self.codes(np.frombuffer(samples[language], np.uint8))[0]
            table = self._automaton(codes.tolist())
            root = table[0]
            cells = np.where(table < 0, np.maximum(root, 0)[None, :], table)
            ended = (table < 0).astype(np.int64)
            ended[1:] += ended[1:] * (root < 0)
            tables.append((cells + base) * self.width * 4 + ended)
            self.roots.append(base * self.width)
            self.bits.append(float(np.log2(len(codes) + 2)))
            base += len(table)
        # Cells hold four times an offset; many languages, or many scripts, take more than 32 bits.
        self.kind = np.int32 if base * self.width * 4 + 4 < 2**31 else np.int64
        self.cells = np.concatenate(tables).astype(self.kind).reshape(-1) if tables else np.zeros(0, self.kind)

    def _automaton(self, codes: list[int]) -> np.ndarray:
        """Transitions of the suffix automaton, -1 where there is none."""
        move: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in codes:
            new = len(move)
            move.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in move[p]:
                move[p][c] = new
                p = link[p]
            if p >= 0:
                q = move[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(move)
                    move.append(dict(move[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and move[p].get(c) == q:
                        move[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        table = np.full((len(move), self.width), -1, np.int64)
        for state, row in enumerate(move):
            for c, to in row.items():
                table[state, c] = to
        return table

    def codes(self, data: np.ndarray, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of each text, runs of separators as one, none at either end."""
        bounds = np.array([0, len(data)]) if bounds is None else bounds
        all_codes = self.symbols[data]
        fresh = np.ones(len(all_codes), bool)
        fresh[1:] = (all_codes[1:] > 0) | (all_codes[:-1] > 0)
        first = bounds[:-1][bounds[:-1] < bounds[1:]]
        fresh[first] = all_codes[first] > 0
        kept = np.concatenate([[0], np.cumsum(fresh)])
        return all_codes[fresh], kept[bounds]

    def phrases(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, language) counts of phrases, and the number of symbols of each text."""
        codes, at = self.codes(data, bounds)
        sizes, many = np.diff(at), len(self.languages)
        lanes = -(-sizes // LANE)
        text = np.repeat(np.arange(len(sizes)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = at[text] + nth * LANE
        length = np.minimum(LANE, at[text + 1] - start)
        order = np.argsort(-length, kind="stable")
        text, start, length = text[order], start[order], length[order]
        roots = np.array(self.roots, self.kind)[:, None]
        state = np.repeat(roots, len(text), axis=1)
        counts = np.zeros(state.shape, np.int32)
        active = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1 if len(length) else 1), side="right")
        for t, n in enumerate(active):
            cell = self.cells[state[:, :n] + codes[start[:n] + t]]
            counts[:, :n] += (cell & 3).astype(np.int32)
            state[:, :n] = cell >> 2
        total = np.zeros((len(sizes), many), np.int64)
        np.add.at(total, text, (counts + (state != roots)).T)
        return total, sizes

    def judge(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: the number of its language, the score, phrases a symbol."""
        total, sizes = self.phrases(data, bounds)
        n = np.maximum(sizes, 1)[:, None]
        cost = total * np.array(self.bits) / n
        best = cost.argmin(axis=1)
        lead = (cost - cost.min(axis=1, keepdims=True)) * np.sqrt(n)
        return best, 1 / np.exp2(-np.minimum(lead, 60)).sum(axis=1), total[np.arange(len(best)), best] / n[:, 0]


def _slices(text: Column, share: int, slices: int) -> Column:
    """At most `share` characters of a text: so many equal slices from its beginning to its end."""
    width = share // slices
    spread = [F.substring(text, (F.lit(1) + F.floor((F.length(text) - width) * (k / max(1, slices - 1)))).cast("int"), F.lit(width)) for k in range(slices)]
    return F.when(F.length(text) <= share, text).otherwise(F.concat_ws(" ", *spread))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, share: int = SHARE, slices: int = SLICES, most_languages: int = MOST_LANGUAGES) -> CrossParser:
    """Fit on a bounded sample: of each language the sample_docs different texts of least hash, `share` characters of each.

    Rows without a language or text teach nothing; copies of a text teach once. No more than sample_docs *
    share characters a language reach the driver, whatever the size of the table. Languages are tried from
    the one with the most rows, counted over all, to the one with the fewest, then by name; more than
    most_languages of them are an error.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"), _slices(F.col(text_col), share, slices).alias("text"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(most_languages + 1).collect()}
    if len(counts) > most_languages:
        raise ValueError(f"over {most_languages} languages: normalise the labels, or raise most_languages")
    few = Window.partitionBy("lang").orderBy("h")
    chosen = rows.groupBy("lang", "h").agg(F.lit(1).alias("one")).withColumn("n", F.row_number().over(few)).where(F.col("n") <= sample_docs)
    taught = rows.join(F.broadcast(chosen.select("lang", "h", "n")), ["lang", "h"]).groupBy("lang", "n").agg(F.min("text").alias("text"))
    samples: dict[str, bytes] = {}
    for row in sorted(taught.collect(), key=lambda r: (r["lang"], r["n"])):
        samples[row["lang"]] = samples.get(row["lang"], b"") + row["text"].lower().encode() + b" "
    return CrossParser({k: samples[k][:sample_bytes] for k in sorted(samples, key=lambda k: (-counts[k], k)) if samples[k].strip()})


def identify(docs: DataFrame, parser: CrossParser, text_col: str = "text", prefix: str = "") -> DataFrame:
    """The documents with <prefix>lang_pred, <prefix>score and <prefix>rate, and nothing taken away.

    lang_pred is 'und' and score 0 where a text is null, empty or has no letter, and
    everywhere if no language was learned; equal costs go to the language with more rows.
    rate is phrases a symbol of the winner, 1 for 'und'. Columns of those names are replaced.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(parser)
    added = [f"{prefix}lang_pred", f"{prefix}score", f"{prefix}rate"]
    docs = docs.drop(*added)
    low = unused("__lower", docs.columns)
    ready = docs.withColumn(low, F.when(F.col(text_col).rlike(r"\p{L}"), F.lower(text_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = shared.value
        for batch in pieces(batches, low, CHUNK):
            lower = batch.column(low)
            known = lower.is_valid().to_numpy(zero_copy_only=False)
            if parser.languages:
                best, score, rate = parser.judge(*text_buffer(lower))
                names = np.array(parser.languages, object)[best]
            else:
                known = np.zeros(len(known), bool)
                names, score, rate = np.full(len(known), UNKNOWN, object), np.zeros(len(known)), np.ones(len(known))
            new = [pa.array(np.where(known, names, UNKNOWN), pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(np.where(known, rate, 1.0))]
            kept = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != low]
            yield pa.RecordBatch.from_arrays([*kept, *new], names=[*(c for c in batch.schema.names if c != low), *added])

    schema = docs.schema.add(added[0], "string").add(added[1], "double").add(added[2], "double")
    return ready.mapInArrow(run, schema)


def in_some_language(docs: DataFrame, parser: CrossParser, text_col: str = "text", most: float = MAX_RATE, telling: int = TELLING) -> DataFrame:
    """The documents that are in some language, with their own columns only.

    Those without a letter go, and those of `telling` characters or more whose phrases are as short as noise's.
    """
    prefix = "__"
    while {f"{prefix}{c}" for c in ("lang_pred", "score", "rate")} & {c.lower() for c in docs.columns}:
        prefix = f"_{prefix}"
    judged = identify(docs, parser, text_col, prefix)
    noise = (F.col(f"{prefix}rate") > most) & (F.length(text_col) >= telling)
    return judged.where((F.col(f"{prefix}lang_pred") != UNKNOWN) & ~noise).select(*docs.columns)
