"""Exact removal of repeated passages with sharded FM-indexes.

A window is ``window`` consecutive words.  A word goes if a window that covers it also starts in a document with a
smaller id.  Steps:

1. Every window is assigned to its leftmost least-hashed run of ``gram`` words (its anchor), so equal windows have equal
   anchors.  Consecutive windows of an anchor make a passage.  Anchors that occur in one document alone are left out.
2. Distinct passages are dealt to shards by anchor; copies of a passage are one row with their least id.  Each shard
   builds a compressed FM-index over its passages: suffixes sorted as deep as a window, the Burrows-Wheeler transform in
   a wavelet matrix of packed bits with rank counts.
3. Passages stream through backward search, all of a shard in step, one word at a time.  The interval is narrowed by
   the word to the left and widened back to the window's length, so its matching statistic stays at the threshold;
   each interval reports the least document id among its suffixes.
4. What a window reports is set against the document of each occurrence; the windows to remove become intervals of
   words, which are joined to the documents.

An anchor with more than ``hot`` distinct passages isn't gathered in one shard: its windows are keyed by all their words
instead, where copies collapse to one row, and pass steps 2 to 4 in that form.  No step holds more of a key than that.

Defined results: null text has no words; documents shorter than a window lose nothing; rows without an id neither
remove nor lose words; rows with equal ids aren't compared with each other; repeated rows are all kept and treated
alike; an empty table gives an empty result; texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, slices, span_hashes, word_hashes, word_spans

OCCURRENCE = "h long, c long, n int, doc_id long, th int, lo int"
SHARD_WORDS = 300_000


# Anchors and passages


def anchors_of(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, windows) of each run of windows of a document with these word hashes."""
    starts = len(hashes) - window + 1
    grams = len(hashes) - gram + 1
    g = span_hashes(hashes, np.arange(grams), np.arange(gram, gram + grams))
    wide = window - gram + 1
    if wide == 1:
        return g, np.arange(starts), np.ones(starts, np.int64)
    least = np.empty(starts, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(g, wide)
    for a in range(0, starts, 65536):
        least[a : a + 65536] = view[a : a + 65536].argmin(axis=1)
    least += np.arange(starts)
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    return g[least[first]], first, np.diff(np.append(first, starts))


def occurrences(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(h, c, n, doc_id, th, lo): anchor and content hash of each passage, its windows and its first word.

    ``docs`` has doc_id, th, text, and maybe ``runs``, an array of (lo, n): the windows to take (else all).
    """
    with_runs = "runs" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in slices(batches, "text"):
            start, end, row = word_spans(data, at)
            hashes = word_hashes(data, start, end)
            words = np.bincount(row, minlength=batch.num_rows)
            first = np.concatenate(([0], np.cumsum(words)))
            runs = batch.column("runs").to_pylist() if with_runs else None
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for d in np.flatnonzero(words >= window).tolist():
                mine = hashes[first[d] : first[d + 1]]
                h, lo, n = anchors_of(mine, window, gram)
                if runs is not None:
                    wanted = np.zeros(len(mine) - window + 1, bool)
                    for r in runs[d] or []:
                        wanted[r["lo"] : r["lo"] + r["n"]] = True
                    ok = wanted[lo]
                    h, lo, n = h[ok], lo[ok], n[ok]
                c = span_hashes(mine, lo, lo + n + window - 1)
                for column, value in zip(out, (h.view(np.int64), c.view(np.int64), n.astype(np.int32), np.full(len(h), d), lo.astype(np.int32)), strict=True):
                    column.append(value)
            if out[0]:
                h, c, n, d, lo = map(np.concatenate, out)
                take = pa.array(d)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), pa.array(n), batch.column("doc_id").take(take), batch.column("th").take(take), pa.array(lo)], ["h", "c", "n", "doc_id", "th", "lo"])

    return docs.select("doc_id", "th", "text", *(["runs"] if with_runs else [])).mapInArrow(run, OCCURRENCE)


def passage_texts(docs: DataFrame, window: int) -> DataFrame:
    """(h, c, n, least, passage): the words of passages; ``docs`` has doc_id, text and ``picks``, an array of (h, c, n, lo)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in slices(batches, "text"):
            start, end, row = word_spans(data, at)
            first = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=batch.num_rows))))
            picks, raw = batch.column("picks"), data.tobytes()
            flat = picks.flatten()
            doc = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(picks.offsets)))
            lo, n = flat.field("lo").to_numpy(), flat.field("n").to_numpy()
            a = first[doc] + lo
            b = a + n + window - 2
            texts = pa.array([raw[i:j] for i, j in zip(start[a].tolist(), end[b].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([flat.field("h"), flat.field("c"), flat.field("n"), batch.column("doc_id").take(pa.array(doc)), texts], ["h", "c", "n", "least", "passage"])

    return docs.select("doc_id", "text", "picks").mapInArrow(run, "h long, c long, n int, least long, passage binary")


# The FM-index


class Bits:
    """A packed bit vector with counts of ones before each 64 bits."""

    def __init__(self, bit: np.ndarray):
        self.packed = np.zeros(len(bit) // 64 + 1, np.uint64)
        raw = np.packbits(bit.astype(np.uint8), bitorder="little")
        self.packed.view(np.uint8)[: len(raw)] = raw
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.packed), dtype=np.int64))).astype(np.uint32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.packed[word] & below)


class WaveletMatrix:
    """A sequence of small integers as one packed bit vector a level."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.bits, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level) & 1
            self.bits.append(Bits(bit))
            self.zeros.append(int(len(values) - bit.sum()))
            values = np.concatenate((values[bit == 0], values[bit == 1]))
        self.start = self._walk(np.zeros(symbols, np.int64), np.arange(symbols))

    def _walk(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.bits[k].rank(at)
            at = np.where((symbol >> level) & 1 == 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        return self._walk(at, symbol) - self.start[symbol]


class FMIndex:
    """Backward search over a text whose suffixes are sorted by their first words, a few more than ``depth``.

    What is kept is the transformed text as a wavelet matrix and one bit a suffix (a new group of suffixes begins here:
    those that share their first ``depth`` words) with the groups' starts; the suffix array is given back once.
    """

    def __init__(self, text: np.ndarray, symbols: int, depth: int):
        n = len(text)
        rank, span, at_depth = text.astype(np.int32), 1, None
        order = np.argsort(rank, kind="stable").astype(np.int32)
        while span <= depth:
            if 2 * span > depth and at_depth is None:
                rest = np.zeros(n, np.int32)
                rest[: n - (depth - span)] = rank[depth - span :] + 1
                at_depth = (rank, rest)
            key = rank.astype(np.int64) * (n + 2)
            key[: n - span] += rank[span:] + 1
            order = np.argsort(key, kind="stable").astype(np.int32)
            key = key[order]
            new = np.empty(n, np.int32)
            new[order] = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])), dtype=np.int32)
            rank, span = new, 2 * span
            del key
        self.suffixes = order
        self.bwt = WaveletMatrix(text[order - 1], symbols)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        a, b = at_depth[0][order], at_depth[1][order]
        begins = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        self.begins, self.group_start = Bits(begins), np.append(np.flatnonzero(begins), n).astype(np.int32)

    def extend(self, lo: np.ndarray, hi: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after putting a word before each pattern."""
        return self.before[word] + self.bwt.rank(word, lo), self.before[word] + self.bwt.rank(word, hi)

    def group(self, lo: np.ndarray) -> np.ndarray:
        """The group that the suffix at each place is in."""
        return self.begins.rank(lo + 1) - 1

    def widen(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns' first ``depth`` words."""
        g = self.group(lo)
        return self.group_start[g].astype(np.int64), self.group_start[g + 1].astype(np.int64)


def least_documents(words: np.ndarray, first: np.ndarray, length: np.ndarray, owner: np.ndarray, window: int) -> list[np.ndarray]:
    """For each passage words[first : first + length], the least owner of any passage with each of its windows."""
    names, ids = np.unique(words, return_inverse=True)
    passages, symbols = len(first), len(names) + 1
    place = first + np.arange(passages) + 1  # a separator (0) before each passage and at the end
    text = np.zeros(len(words) + passages + 1, np.int32)
    doc = np.repeat(np.arange(passages, dtype=np.int32), length)
    text[np.arange(len(words)) + doc + 1] = ids + 1
    of_text = np.zeros(len(text), np.int32)
    of_text[np.arange(len(words)) + doc + 1] = doc
    del names, ids, doc
    index = FMIndex(text, symbols, window)
    # beginnings of separators report whatever; no window's interval has them
    least = np.minimum.reduceat(owner[of_text[index.suffixes]], index.group_start[:-1])
    index.suffixes = of_text = None
    order = np.argsort(-length, kind="stable")
    place, size = place[order], length[order]
    lo, hi = np.zeros(passages, np.int64), np.full(passages, len(text), np.int64)
    flat = np.empty(int((size - window + 1).sum()), np.int64)
    to = np.concatenate(([0], np.cumsum(size - window + 1)))
    for t in range(int(size[0]) if passages else 0):
        n = int(np.searchsorted(-size, -(t + 1), "right"))
        word = text[place[:n] + size[:n] - 1 - t]
        lo[:n], hi[:n] = index.extend(lo[:n], hi[:n], word)
        if t + 1 >= window:
            if t + 1 > window:
                lo[:n], hi[:n] = index.widen(lo[:n])
            flat[to[:n] + size[:n] - 1 - t] = least[index.group(lo[:n])]
    back = np.empty(passages, np.int64)
    back[order] = np.arange(passages)
    return [flat[to[i] : to[i + 1]] for i in back.tolist()]


def search_shards(passages: DataFrame, window: int) -> DataFrame:
    """(h, c, n, least_of): for each window of each passage the least document that has it.  Equal anchors share a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def search(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            text = table["passage"].combine_chunks() if isinstance(table["passage"], pa.ChunkedArray) else table["passage"]
            raw = text.cast(pa.large_binary())
            at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            data = np.frombuffer(raw.buffers()[2], np.uint8)[at[0] : at[-1]]
            start, end, row = word_spans(data, at - at[0])
            length = np.bincount(row, minlength=len(raw))
            first = np.concatenate(([0], np.cumsum(length)[:-1]))
            found = least_documents(word_hashes(data, start, end), first, length, table["least"].to_numpy(), window)
            places = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            column = lambda name: table[name].combine_chunks() if isinstance(table[name], pa.ChunkedArray) else table[name]
            return pa.RecordBatch.from_arrays([column("h"), column("c"), column("n"), pa.ListArray.from_arrays(pa.array(places), pa.array(np.concatenate(found)))], ["h", "c", "n", "least_of"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += int(batch.column("n").to_numpy().sum()) + batch.num_rows * (window - 1)
            if size >= SHARD_WORDS:
                table = pa.Table.from_batches(held)
                h = table["h"].to_numpy()
                cut = int(np.searchsorted(h, h[-1]))  # the last anchor may go on
                if cut:
                    yield search(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    size = int(table["n"].to_numpy()[cut:].sum()) + (len(h) - cut) * (window - 1)
        if held:
            yield search(pa.Table.from_batches(held))

    return passages.repartition("h").sortWithinPartitions("h").mapInArrow(run, "h long, c long, n int, least_of array<long>")


# Putting it together


def repeated_windows(found: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, th, spans) from occurrences whose anchors are not alone: words (start, end) to remove, by document."""
    copies = found.groupBy("h", "c", "n").agg(F.min(F.struct("doc_id", "th", "lo")).alias("rep"), F.max("doc_id").alias("last"))
    copies = materialize(copies, "passages")
    picks = copies.groupBy("rep.doc_id", "rep.th").agg(F.collect_list(F.struct("h", "c", "n", "rep.lo")).alias("picks"))
    texts = passage_texts(docs.join(picks, ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]), window)
    least = search_shards(texts, window).join(copies.select("h", "c", "n", "last"), ["h", "c", "n"]).where(F.array_min("least_of") < F.col("last"))
    least = materialize(least.select("h", "c", "n", "least_of"), "least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, doc, lo = batch.column("least_of"), batch.column("doc_id").to_numpy(), batch.column("lo").to_numpy().astype(np.int64)
            sizes = np.diff(np.asarray(of.offsets))
            row = np.repeat(np.arange(batch.num_rows), sizes)
            goes = np.flatnonzero(of.flatten().to_numpy() < doc[row])
            w = lo[row[goes]] + goes - np.concatenate(([0], np.cumsum(sizes)))[row[goes]]
            new = np.flatnonzero(np.concatenate(([True], (row[goes][1:] != row[goes][:-1]) | (w[1:] != w[:-1] + 1)))) if len(goes) else goes
            last = np.append(new[1:], len(goes)) - 1 if len(goes) else new
            take = pa.array(row[goes][new])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("th").take(take), pa.array(w[new].astype(np.int32)), pa.array((w[last] + window).astype(np.int32))], ["doc_id", "th", "start", "end"])

    return found.join(least, ["h", "c", "n"]).select("doc_id", "th", "lo", "least_of").mapInArrow(run, "doc_id long, th int, start int, end int")


def not_alone(found: DataFrame) -> DataFrame:
    """Occurrences whose anchor occurs in more than one document.

    The anchors are written first: a join with a table of its own can be split by Spark where one anchor is very common.
    """
    shared = materialize(found.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h"), "shared")
    return materialize(found.join(shared, "h"), "shared-anchors")


def remove_repeats(docs: DataFrame, window: int = 50, gram: int = 12, hot: int = 4000, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``sd_spans``: ordered, disjoint (start, end) of words to remove; null where nothing goes."""
    keyed = docs.select(F.col(row_id).cast("long").alias("doc_id"), F.hash(text).alias("th"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    every = materialize(occurrences(keyed, window, gram), "anchors")
    found = not_alone(every)
    release(every)
    crowded = materialize(found.select("h", "c", "n").distinct().groupBy("h").count().where(F.col("count") > hot).select("h"), "crowded")
    if crowded.isEmpty():
        spans = repeated_windows(found, keyed, window)
    else:
        runs = found.join(crowded, "h", "left_semi").groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "n")).alias("runs"))
        finer = not_alone(materialize(occurrences(keyed.join(runs, ["doc_id", "th"]), window, window), "windows"))
        usual = found.join(crowded, "h", "left_anti")
        spans = repeated_windows(usual, keyed, window).unionByName(repeated_windows(finer, keyed, window))
    merged = spans.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("sd_spans")).withColumnsRenamed({"doc_id": "sd_id", "th": "sd_th"})
    out = docs.withColumn("sd_hash", F.hash(text))
    return out.join(merged, (out[row_id].cast("long") == merged["sd_id"]) & (out["sd_hash"] == merged["sd_th"]), "left").drop("sd_id", "sd_th", "sd_hash")


def kept_words(text: str | None, spans: list | None) -> tuple[list[bytes], int]:
    """The words that stay, and how many there were; words by white space of single bytes."""
    words = (text or "").encode().split()
    n = len(words)
    if not spans:
        return words, n
    out, at = [], 0
    for s in spans:
        out += words[at : max(at, s["start"])]
        at = max(at, s["end"])
    return out + words[at:], n


def digests(marked: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of the result of ``remove_repeats``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, gone, digest = [], [], []
            for t, spans in zip(batch.column(1), batch.column(2), strict=True):
                kept, n = kept_words(t.as_py(), spans.as_py())
                words.append(n)
                gone.append(n - len(kept))
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return marked.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).alias("text"), "sd_spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def kept_texts(marked: DataFrame, text: str = "text") -> DataFrame:
    """The documents with their texts cut: untouched texts stay as they are, others become their kept words with one space between."""
    columns = [c for c in marked.columns if c != "sd_spans"]
    schema = marked.select(*columns).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in slices(batches, text):
            texts = [t.as_py() if not s.as_py() else b" ".join(kept_words(t.as_py(), s.as_py())[0]).decode() for t, s in zip(batch.column(text), batch.column("sd_spans"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text else batch.column(c) for c in columns], columns)

    return marked.mapInArrow(run, schema)
