"""Phrases that recur, found by merged count-min sketches and counted exactly.

First pass: every task adds the n-grams of its texts (1 to ``longest`` words, by language) to a count-min sketch of
``ROWS`` rows.  A sketch travels as counts of the cells that were touched, by chunk of ``CHUNK`` cells; chunks are
merged by addition where Spark has dealt them, so no task holds more than a chunk's cells at a time for each chunk it has.  As a sketch
never underestimates, a phrase with a cell below ``least`` can't be frequent; one bit a cell remains.

Second pass: n-grams whose cells are all set, and whose first and last words without one are set too, are counted exactly: within a slice
of text, then by (language, phrase) in Spark.  Nothing that occurs ``least`` times is lost; what the sketch let through
in vain is dropped by its exact count.  Then phrases are cut and scored with exact decimals, and those that a longer one
accounts for are dropped, all by equality joins.

The sketch has a cell for every ``LOAD`` n-grams (estimated from the bytes of all texts), at most ``MOST_CELLS`` a row:
``ROWS * MOST_CELLS / 8`` bytes are the most that is broadcast.  A corpus too large for that fills the sketch, which
then lets more through; results stay the same and the second aggregation carries more.

Defined results: null text is empty, null language is ``und``; phrases never cross one of ``.,;:!?`` or a line's end;
texts of any length are cut at those places, a slice at a time; repeated rows count as rows of their own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import buffers, materialize, mix, span_hashes

ROWS = 2
CHUNK = 1 << 20  # cells of a sketch that travel together
LOAD = 24  # n-grams a cell
LEAST_CELLS, MOST_CELLS = CHUNK, 1 << 29
BATCH = 1 << 22  # n-grams that a task puts into one piece of a sketch
TEXT_BYTES = 1 << 21  # bytes of text that a task turns into arrays at a time

BREAK = np.zeros(256, bool)
BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
APART = BREAK.copy()
APART[list(b" \t")] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SEEDS = np.array([0x51ED270B7A8F2C45, 0xA24BAED4963EE407, 0x9FB21C651E98DF25], np.uint64)
UNKNOWN = "und"


@dataclass
class Slice:
    """Words of a run of text: their bytes with one space after each, where each begins and ends there, its piece and its language."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    lang: np.ndarray
    langs: list[str]
    seeds: np.ndarray

    def grams(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, first word, hash with language) of the n-grams of each length."""
        words = span_hashes(self.data, self.start, self.end)
        for k in range(1, longest + 1):
            n = max(len(words) - k + 1, 0)
            first = np.flatnonzero(self.piece[:n] == self.piece[k - 1 :][:n])
            yield k, first, mix(span_hashes(words, first, first + k) + self.seeds[self.lang[first]])


def cuts(data: np.ndarray, at: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of about ``limit`` bytes that end where a row ends or a piece does."""
    low = 0
    while low < len(data):
        high = min(low + limit, len(data))
        if high < len(data):
            row = int(at[np.searchsorted(at, high, "right") - 1])
            breaks = np.flatnonzero(BREAK[data[low:high]])
            end = max(row, low + int(breaks[-1]) + 1 if len(breaks) else 0)
            if end <= low:  # one piece is longer than the limit
                after = int(at[np.searchsorted(at, high, "right")])
                step = high
                while step < after and not (found := np.flatnonzero(BREAK[data[step : step + limit]])).size:
                    step += limit
                end = min(after, step + int(found[0]) + 1) if step < after else after
            high = end
        yield low, high
        low = high


def text_slices(batches: Iterator[pa.RecordBatch], limit: int = TEXT_BYTES) -> Iterator[Slice]:
    for batch in batches:
        data, at = buffers(batch.column("text"))
        encoded = batch.column("lang").cast(pa.string()).fill_null(UNKNOWN).dictionary_encode()
        langs, codes = encoded.dictionary.to_pylist(), encoded.indices.to_numpy(zero_copy_only=False)
        names = [x.encode() for x in langs]
        ends = np.cumsum([len(x) for x in names], dtype=np.int64)
        seeds = span_hashes(np.frombuffer(b"".join(names), np.uint8), ends - [len(x) for x in names], ends) if names else np.zeros(0, np.uint64)
        for low, high in cuts(data, at, limit):
            part = LOWER[data[low:high]]
            apart, broken = APART[part], BREAK[part]
            first = np.zeros(len(part) + 1, bool)
            inside = at[(at >= low) & (at <= high)] - low
            first[inside] = True
            before = np.append(True, apart[:-1]) | first[:-1]
            after = np.append(apart[1:], True) | first[1:]
            start, end = np.flatnonzero(~apart & before), np.flatnonzero(~apart & after) + 1
            if not len(start):
                continue
            piece = np.cumsum(broken | first[:-1])[start]
            sizes = end - start
            into = np.cumsum(sizes + 1) - sizes - 1
            compact = np.full(int(into[-1] + sizes[-1] + 1), 32, np.uint8)
            compact[np.repeat(into - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(int(sizes.sum()))] = part[~apart]
            lang = codes[np.searchsorted(at, start + low, "right") - 1]
            yield Slice(compact, into, into + sizes, piece, lang, langs, seeds)


def cells_of(hashes: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (mix(hashes ^ SEEDS[row]) >> np.uint64(64 - (cells.bit_length() - 1))).astype(np.uint32)


def sketch_width(total_bytes: int, longest: int) -> int:
    """Cells of a row: a power of two, from the bytes of all texts (six a word)."""
    wanted = max(total_bytes, 1) * longest // 6 // LOAD
    return min(max(1 << max(wanted - 1, 1).bit_length(), LEAST_CELLS), MOST_CELLS)


def narrow(values: np.ndarray) -> np.ndarray:
    """The same values in the narrowest of three unsigned types."""
    top = int(values.max(initial=0))
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


def sketch(docs: DataFrame, cells: int, longest: int, least: int) -> DataFrame:
    """(chunk, bits): which cells of the merged sketch reach ``least``; chunks of row r come after those of row r - 1."""
    each = min(CHUNK, cells)

    def pieces(hashes: list[np.ndarray]) -> pa.RecordBatch:
        chunk, size, where, wide, counts = [], [], [], [], []
        together = np.concatenate(hashes)
        for row in range(ROWS):
            cell, n = np.unique(cells_of(together, row, cells), return_counts=True)
            bounds = np.searchsorted(cell, np.arange(0, cells + 1, each))
            for c in np.flatnonzero(bounds[1:] > bounds[:-1]):
                one = slice(bounds[c], bounds[c + 1])
                steps = narrow(np.diff(cell[one].astype(np.int64) - int(c) * each, prepend=0))
                many = narrow(np.minimum(n[one], least))
                chunk.append(row * (cells // each) + int(c))
                size.append(len(steps))
                where.append(pa.compress(steps.tobytes(), "zstd", asbytes=True))
                counts.append(pa.compress(many.tobytes(), "zstd", asbytes=True))
                wide.append(steps.itemsize * 16 + many.itemsize)
        return pa.record_batch([pa.array(chunk, pa.int32()), pa.array(size, pa.int32()), pa.array(wide, pa.int32()), pa.array(where, pa.binary()), pa.array(counts, pa.binary())], ["chunk", "size", "wide", "steps", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for part in text_slices(batches):
            for _, _, hashes in part.grams(longest):
                held.append(hashes)
                n += len(hashes)
            if n >= BATCH:
                yield pieces(held)
                held, n = [], 0
        if n:
            yield pieces(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                types = {1: np.uint8, 2: np.uint16, 4: np.uint32}
                unpack = lambda data, width: np.frombuffer(pa.decompress(data, r["size"] * width, "zstd", asbytes=True), types[width])  # noqa: B023, E731
                cell = np.cumsum(unpack(r["steps"], r["wide"] // 16), dtype=np.int64)
                sums = merged.setdefault(r["chunk"], np.zeros(each, np.uint32))
                sums[cell] = np.minimum(sums[cell] + unpack(r["counts"], r["wide"] % 16), least)
        for chunk, sums in merged.items():
            yield pa.record_batch([pa.array([chunk], pa.int32()), pa.array([np.packbits(sums >= least).tobytes()], pa.binary())], ["chunk", "bits"])

    parts = docs.mapInArrow(add, "chunk int, size int, wide int, steps binary, counts binary")
    return parts.repartition("chunk").mapInArrow(merge, "chunk int, bits binary")


def counted(docs: DataFrame, longest: int = 5, least: int = 100) -> DataFrame:
    """(lang, phrase, words, a): every n-gram of up to ``longest`` words that occurs ``least`` times in a language, and, with a null phrase, each language's number of words."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = sketch_width(total, longest)
    each = min(CHUNK, cells)
    bits = np.zeros((ROWS, cells // 8), np.uint8)
    for r in sketch(texts, cells, longest, least).toLocalIterator():
        row, c = divmod(r["chunk"], cells // each)
        bits[row, c * (each // 8) : (c + 1) * (each // 8)] = np.frombuffer(r["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for part in text_slices(batches):
            langs = np.array(part.langs, object)
            words = np.bincount(part.lang, minlength=len(langs))
            seen = np.flatnonzero(words)
            names, starts, ends, sizes, counts = [langs[seen]], [], [], [np.zeros(len(seen), np.int32)], [words[seen]]
            before = None
            for k, first, hashes in part.grams(longest):
                passed = np.ones(len(first), bool)
                for row in range(ROWS):
                    cell = cells_of(hashes, row, cells)
                    passed &= (bits[row, cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
                if before is not None:
                    passed &= before[first] & before[first + 1]
                before = np.zeros(len(part.start) + 1, bool)
                before[first[passed]] = True
                _, one, n = np.unique(hashes[passed], return_index=True, return_counts=True)
                word = first[passed][one]
                names.append(langs[part.lang[word]])
                starts.append(part.start[word])
                ends.append(part.end[word + k - 1])
                sizes.append(np.full(len(one), k, np.int32))
                counts.append(n)
            start, end = np.concatenate(starts), np.concatenate(ends)
            offsets = np.append(0, np.cumsum(end - start))
            data = part.data[np.repeat(start - offsets[:-1], end - start) + np.arange(int(offsets[-1]))]
            phrases = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
            phrases = pa.concat_arrays([pa.nulls(len(seen), pa.string()), phrases])
            yield pa.record_batch([pa.array(np.concatenate(names), pa.string()), phrases, pa.array(np.concatenate(sizes)), pa.array(np.concatenate(counts).astype(np.int64))], ["lang", "phrase", "words", "a"])

    found = texts.mapInArrow(count, "lang string, phrase string, words int, a long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a")).where(F.col("phrase").isNull() | (F.col("a") >= least))


def part_of(words: Column, start: Column | int, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, top: int = 2000, share: int = 100) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to ``longest`` words.

    A phrase's score is its lowest over all cuts of ``floor(1000 a n / (l r))``.  A phrase is dropped when a longer one
    that holds it occurs at least ``share`` percent as often, be that one dropped or not.
    """
    exact = materialize(counted(docs, longest, least), "phrases")
    known = exact.where(F.col("phrase").isNotNull())
    totals = exact.where(F.col("phrase").isNull()).select("lang", F.col("a").alias("n"))
    candidates = known.where("words > 1").withColumn("w", F.split("phrase", " "))
    at = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    halves = at.select("lang", "phrase", "a", "k", part_of(F.col("w"), 1, F.col("k")).alias("left"), part_of(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    left = known.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l"))
    right = known.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r"))
    wide = lambda name: F.col(name).cast("decimal(20,0)")
    scored = (
        halves.join(left, ["lang", "left"])
        .join(right, ["lang", "right"])
        .join(totals, "lang")
        .withColumns({"top": F.lit(1000).cast("decimal(4,0)") * wide("a").cast("decimal(17,0)") * wide("n").cast("decimal(17,0)"), "under": wide("l").cast("decimal(19,0)") * wide("r").cast("decimal(19,0)")})
        .withColumn("score", F.expr("cast(top div under as long)"))
        .groupBy("lang", "phrase", "a", "n")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )
    # each longer phrase tells every run of two or more words inside it how often it occurs
    runs = candidates.where("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1))).withColumn("from", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    within = runs.groupBy("lang", part_of(F.col("w"), F.col("from"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    ours = scored.join(within, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share))
    best = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    return ours.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
