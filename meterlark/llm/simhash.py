"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits; two link if at most ``distance`` differ.  Bits are dealt to blocks, correlated bits to the
same one.  If thresholds of ``m`` blocks add up to ``distance - m + 1`` (-1 leaves a block out), two linked fingerprints
differ, in at least one block, by no more than that block's threshold.  Several layouts (2 to 6 blocks, some of unequal
widths) are tried; for each, dynamic programming chooses thresholds by the number of candidates that they would give,
estimated from how many pairs of all distinct fingerprints share a value of each block, and the cheapest layout is used.
Every fingerprint is put under its value in each block and, for a threshold t, under all values within t / 2 bits
(rounded up) of it, so two that differ by t meet; what meets under a value is verified on all 64 bits.

Copies collapse to distinct fingerprints first.  For small distances a value that more than ``group_limit`` fingerprints
share is split exactly: the same principle on the bits outside its block, again until groups are small.  For larger
distances, where no splitting tells the members of a dense group apart, a group is linked by stars around members in
its middle, with the triangle inequality deciding who else can link: no group is compared pair by pair.  Of the links
that a task finds it keeps a spanning forest, never all pairs; components come from joins.

``without_near_duplicates`` asks how alike texts are, which 64 bits tell too roughly (of a billion texts many strangers
are within a dozen bits).  It takes 128 bits: the first 64 find candidates (``distance``), all 128 decide.  Two texts link
if their bits say that the shingles' Jaccard similarity is ``similarity`` or more: at a Jaccard similarity j a bit differs
with probability arccos(2 j / (1 + j)) / pi, which for 0.8 is 19 of 128 bits.  See the README for what that finds.

Defined results: null or wordless text has fingerprint zero and links like any other; a text of fewer words than a
shingle is one shingle; texts with equal fingerprints are one group; the component of documents whose ids are all null
is null; repeated rows are kept; an empty table gives an empty result.  ``without_near_duplicates`` keeps, of each
group, the row with the smallest id (null last; of rows with one id and different texts each is a document of its own).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix
from .components import components

PROBE_COST = 20.0  # of one more row to deal out, in candidates verified
MOST_VALUES = 1024  # under which a fingerprint is put in one block
LAYOUTS = [(32, 32), (20, 20, 24), (21, 21, 22), (16, 16, 16, 16), (12, 13, 13, 13, 13), (10, 10, 11, 11, 11, 11)]
SMALL_GROUP = 128  # fingerprints under one value up to which all pairs are compared
SPLIT_DISTANCE = 4  # up to which large groups are split by the same principle again
KEYED = "key long, fp long, more long"


def fingerprints(docs: DataFrame, words_each: int = 3, seed: int = 42, text: str = "text", row_id: str = "doc_id", bits: int = 64) -> DataFrame:
    """(doc_id, fp, more): bit i is set if it is set in over half of the shingles' hashes: 64 bits of XXH64, or 128 of XXH3 (``more`` has the second half, else 0)."""
    digest, words = (xxhash.xxh64_digest, 1) if bits == 64 else (xxhash.xxh3_128_digest, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, 2), np.uint64)
            for row, value in enumerate(batch.column(1)):
                parts = (value.as_py() or "").encode().lower().split()
                if not parts:
                    continue
                joined = b" ".join(parts)
                ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
                starts, ends = np.concatenate(([0], ends[:-1])), ends - 1
                n = max(1, len(parts) - words_each + 1)
                spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
                hashes = np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in spans]), np.uint8).reshape(n, 8 * words)
                ones = np.zeros(64 * words, np.int64)
                for at in range(0, n, 8192):
                    ones += np.unpackbits(hashes[at : at + 8192], axis=1).sum(axis=0, dtype=np.int64)
                out[row, :words] = np.packbits(ones * 2 > n).view(">u8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[:, 0].view(np.int64)), pa.array(out[:, 1].view(np.int64))], ["doc_id", "fp", "more"])

    return docs.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long, more long")


def correlated_blocks(together: np.ndarray, n: int, widths: tuple[int, ...], bits: int = 64) -> list[list[int]]:
    """Deal bits to blocks of these widths: a block begins with the most correlated bit left and takes the bit nearest to it."""
    p = together.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    left, out = set(range(bits)), []
    for width in widths:
        rest = sorted(left)
        block = [rest[int(np.argmax(corr[np.ix_(rest, rest)].sum(axis=1)))]]
        while len(block) < width:
            rest = sorted(left - set(block))
            block.append(rest[int(np.argmax(corr[np.ix_(rest, block)].sum(axis=1)))])
        out.append(sorted(block))
        left -= set(block)
    return out


def near_values(width: int, threshold: int) -> np.ndarray:
    """All differences of at most ``threshold`` of ``width`` bits."""
    return np.array([sum(1 << b for b in c) for t in range(threshold + 1) for c in itertools.combinations(range(width), t)], np.uint64)


def ball(width: int, radius: int) -> int:
    """How many values are within ``radius`` bits of one."""
    return sum(math.comb(width, t) for t in range(min(radius, width) + 1))


def allocate(widths: list[int], pairs: list[float], n: float, distance: int) -> tuple[float, list[int]]:
    """(cost, thresholds): the least estimated cost of thresholds with the sum that the principle needs, or infinity.

    ``pairs`` has, for each block, how many pairs of the ``n`` fingerprints share its value.  A threshold's other values
    bring as many more as they would of evenly spread fingerprints: dense groups share the value itself already.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for width, shared in zip(widths, pairs, strict=True):
        row = {-1: 0.0} | {t: shared + (ball(width, t) - 1) * n * n / 2 / 2**width + PROBE_COST * n * ball(width, (t + 1) // 2) for t in range(distance + 1) if ball(width, (t + 1) // 2) <= MOST_VALUES}
        new: dict[int, tuple[float, list[int]]] = {}
        for total, (c, chosen) in best.items():
            for t, more in row.items():
                if total + t not in new or c + more < new[total + t][0]:
                    new[total + t] = (c + more, [*chosen, t])
        best = new
    return best.get(distance - len(widths) + 1, (math.inf, []))


def pick(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each fingerprint, side by side."""
    out = np.zeros(len(fp), np.uint64)
    for j, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(j)
    return out


def _u64(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def keyed(fps: DataFrame, blocks: list[list[int]], thresholds: list[int]) -> DataFrame:
    """(key, fp, more): each fingerprint under its block values and those near them; the key's remainder tells the block."""
    near = [near_values(len(b), (t + 1) // 2) if t >= 0 else None for b, t in zip(blocks, thresholds, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                fp, more = _u64(batch.column(0)), _u64(batch.column(1))
                for i, (bits, diffs) in enumerate(zip(blocks, near, strict=True)):
                    if diffs is None:
                        continue
                    key = (pick(fp, bits)[:, None] ^ diffs[None, :]) * np.uint64(len(blocks)) + np.uint64(i)
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (key.ravel(), np.repeat(fp, len(diffs)), np.repeat(more, len(diffs)))], ["key", "fp", "more"])

    return fps.select("fp", "more").mapInArrow(run, KEYED)


def shared_pairs(fps: DataFrame, layouts: list[list[list[int]]]) -> list[list[float]]:
    """For each block of each layout, how many pairs of all fingerprints share its value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = _u64(batch.column(0))
            for i, bits in enumerate(x for layout in layouts for x in layout):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), i, np.int32)), pa.array(pick(fp, bits).view(np.int64))], ["block", "value"])

    counts = fps.select("fp").mapInArrow(run, "block int, value long").groupBy("block", "value").agg(F.count("*").cast("double").alias("n"))
    rows = {r["block"]: r["pairs"] for r in counts.groupBy("block").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).collect()}
    flat = iter([rows.get(i, 0.0) for i in range(sum(map(len, layouts)))])
    return [[next(flat) for _ in layout] for layout in layouts]


def split_further(rows: DataFrame, blocks: list[list[int]], level: int, distance: int) -> DataFrame:
    """Rows of too large groups under finer keys.  Two of a group that link differ by ``distance`` at most outside its
    block, so of ``distance + 1`` parts of the other bits one is equal; the path of parts so far goes into the key."""
    parts = distance + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, fp, more = (_u64(batch.column(i)) for i in range(3))
            block = (key % np.uint64(len(blocks))).astype(np.int64)
            for i in range(len(blocks)):
                mine = block == i
                if not mine.any():
                    continue
                others = np.random.default_rng(level).permutation(sorted(set(range(64)) - set(blocks[i])))
                for j, bits in enumerate(np.array_split(others, parts)):
                    value = pick(fp[mine], bits.tolist())
                    finer = (key[mine] // np.uint64(len(blocks))) * np.uint64(0x9E3779B97F4A7C15) ^ (value * np.uint64(parts) + np.uint64(j) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
                    finer = (finer >> np.uint64(8)) * np.uint64(len(blocks)) + np.uint64(i)
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (finer, fp[mine], more[mine])], ["key", "fp", "more"])

    return rows.mapInArrow(run, KEYED)


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links (a, b) make a spanning forest; earlier links are preferred (each group takes its first link out, and again)."""
    names, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root, chosen = np.arange(len(names)), []
    while True:
        rx, ry = root[x], root[y]
        open_ = np.flatnonzero(rx != ry)
        if not len(open_):
            return np.sort(np.concatenate(chosen)) if chosen else open_
        first = np.full(len(names), len(a))
        np.minimum.at(first, rx[open_], open_)
        np.minimum.at(first, ry[open_], open_)
        take = np.unique(first[first < len(a)])
        chosen.append(take)
        while True:
            low = np.minimum(root[x[take]], root[y[take]])
            new = root.copy()
            np.minimum.at(new, root[x[take]], low)
            np.minimum.at(new, root[y[take]], low)
            new = new[new[root]]
            if (new == root).all():
                break
            root = new


class Links:
    """Links (a, b, rank) of a task, cut to a spanning forest whenever they are many; the least ranks are preferred."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size, self.bound = 0, 500_000

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.size += len(columns[0])
        if self.size > self.bound:
            self.parts = [self.cut()]
            self.size = len(self.parts[0][0])
            self.bound = max(self.bound, 2 * self.size)

    def cut(self) -> tuple[np.ndarray, ...]:
        a, b, rank = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        by = np.argsort(rank, kind="stable")
        a, b, rank = a[by], b[by], rank[by]
        keep = forest(a, b)
        return a[keep], b[keep], rank[keep]


def node_of(fp: np.ndarray, more: np.ndarray) -> np.ndarray:
    """A fingerprint's name among the links: itself, if it has 64 bits."""
    return fp ^ mix(more)


def majority(x: np.ndarray) -> np.uint64:
    """The bits that most of some fingerprints have."""
    bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8), bitorder="little").reshape(len(x), 64)
    return np.packbits(bits.sum(axis=0) * 2 > len(x), bitorder="little").view(np.uint64)[0]


def bits_between(fp: np.ndarray, more: np.ndarray, fp2: np.ndarray, more2: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp ^ fp2) + np.bitwise_count(more ^ more2)  # at most 128, so single bytes do


def pair_links(key: np.ndarray, fp: np.ndarray, more: np.ndarray, limit: int, links: Links) -> None:
    """All links within each key; equal keys stand together."""
    left, lag = np.arange(len(key) - 1), 1
    while len(left):
        left = left[left + lag < len(key)]
        left = left[key[left] == key[left + lag]]
        apart = bits_between(fp[left], more[left], fp[left + lag], more[left + lag])
        near = apart <= limit
        hit = left[near]
        if len(hit):
            links.add(node_of(fp[hit], more[hit]), node_of(fp[hit + lag], more[hit + lag]), apart[near])
        lag += 1


def star_links(fp: np.ndarray, more: np.ndarray, limit: int, links: Links, tries: int = 8) -> None:
    """Links that connect what links within one large group, without comparing all pairs of what is dense in it.

    Of the neighbours of some member the one in their middle links to all within ``limit``.  Of the rest only those
    within twice that can link to them (the triangle inequality), each by its nearest; the neighbours are done then, and
    the rest goes on.  When ``tries`` members in turn have few neighbours, nothing is dense, and the rest's pairs are
    compared.
    """
    node, left, failed = node_of(fp, more), np.arange(len(fp)), 0
    rng = np.random.default_rng(len(fp))
    while len(left) > SMALL_GROUP and failed < tries:
        start = left[rng.integers(len(left))]
        near = left[bits_between(fp[left], more[left], fp[start], more[start]) <= limit]
        if len(near) < max(16, len(left) // 50):
            failed += 1
            continue
        failed = 0
        pivot = near[bits_between(fp[near], more[near], majority(fp[near]), majority(more[near])).argmin()]
        apart = bits_between(fp[left], more[left], fp[pivot], more[pivot])
        inside, fringe = apart <= limit, (apart > limit) & (apart <= 2 * limit)
        inner, outer, of_inner = left[inside], left[fringe], apart[inside].astype(np.int64)
        rest = inner != pivot
        links.add(np.full(int(rest.sum()), node[pivot]), node[inner[rest]], apart[inside][rest])
        if len(outer):
            edge = inner[of_inner + limit >= int(apart[fringe].min())]
            step = max(1, (1 << 19) // max(len(edge), 1))
            for at in range(0, len(outer) if len(edge) else 0, step):
                some = outer[at : at + step]
                between = bits_between(fp[some][:, None], more[some][:, None], fp[edge][None], more[edge][None])
                best = between.argmin(axis=1)
                gap = between[np.arange(len(some)), best]
                ok = gap <= limit
                links.add(node[edge[best[ok]]], node[some[ok]], gap[ok])
        left = left[~inside]
    pair_links(np.zeros(len(left), np.uint8), fp[left], more[left], limit, links)


def verified_links(rows: DataFrame, limit: int) -> DataFrame:
    """(a, b): within each key, fingerprints at most ``limit`` bits apart, as a spanning forest of each task's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = Links()
        for table in sorted_groups(batches):
            key, fp, more = (_u64(table.column(i)) for i in range(3))
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(first, len(key)))
            for g in np.flatnonzero(size > SMALL_GROUP).tolist():
                mine = slice(first[g], first[g] + size[g])
                star_links(fp[mine], more[mine], limit, links)
            small = np.repeat(size <= SMALL_GROUP, size)
            pair_links(key[small], fp[small], more[small], limit, links)
        if links.parts:
            a, b, _ = links.cut()
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def sorted_groups(batches: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Batches of about ``rows`` rows that cut no key, from batches sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(x.num_rows for x in held) >= rows:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            key = table.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield table.slice(0, cut)
            held = [table.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def plan(fps: DataFrame, distance: int) -> tuple[list[list[int]], list[int]]:
    """Blocks and thresholds for these fingerprints, from counts over all of them."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64)), 0
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                fp = _u64(whole.column(0).slice(at, 8192))
                bits = ((fp[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
                total += bits.T @ bits
                n += len(fp)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(4096), 4096)), pa.array(np.append(total.ravel(), n).astype(np.int64))], ["cell", "n"])

    cells = fps.select("fp").mapInArrow(moments, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # 4097 rows
    table = np.zeros(4097)
    table[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    layouts = [correlated_blocks(table[:4096].reshape(64, 64), int(table[4096]), widths) for widths in LAYOUTS]
    costs = [allocate([len(b) for b in layout], pairs, table[4096], distance) for layout, pairs in zip(layouts, shared_pairs(fps, layouts), strict=True)]
    at = min(range(len(layouts)), key=lambda i: costs[i][0])
    if not costs[at][1]:
        raise ValueError(f"no layout finds a distance of {distance}")
    return layouts[at], costs[at][1]


def near_links(fps: DataFrame, distance: int, limit: int | None = None, group_limit: int = 2048) -> DataFrame:
    """(a, b): enough links between distinct fingerprints (fp, more) to connect all that link.

    Those whose first 64 bits are at most ``distance`` apart are met; of them those link whose bits all together are at
    most ``limit`` apart (``distance``, if not given).
    """
    blocks, thresholds = plan(fps, distance)
    limit = distance if limit is None else limit
    rows = keyed(fps, blocks, thresholds)
    found = []
    for level in range(6 if distance <= SPLIT_DISTANCE else 0):
        large = materialize(rows.groupBy("key").count().where(F.col("count") > group_limit).select("key"), "large-groups")
        if large.isEmpty():
            break
        found.append(verified_links(rows.join(large, "key", "left_anti"), limit))
        rows = materialize(split_further(rows.join(large, "key", "left_semi"), blocks, level, distance).distinct(), "split")
    found.append(verified_links(rows, limit))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(docs: DataFrame, distance: int = 3, words_each: int = 3, seed: int = 42, group_limit: int = 2048, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id that links reach."""
    prints = materialize(fingerprints(docs, words_each, seed, text, row_id), "fingerprints")
    least = materialize(prints.groupBy("fp", "more").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    labels = components(near_links(least, distance, None, group_limit)).withColumnRenamed("v", "fp")
    joined = least.join(labels, "fp")
    smallest = joined.groupBy("root").agg(F.min("least").alias("smallest"))
    of_fp = least.join(joined.select("fp", "root").join(smallest, "root").select("fp", "smallest"), "fp", "left").select("fp", F.coalesce("smallest", "least").alias("component_id"))
    return prints.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: str = "fp"):
    """A fingerprint as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def bits_apart(similarity: float, bits: int) -> int:
    """How many of ``bits`` differ, on average, at a Jaccard similarity of shingles."""
    return round(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def without_near_duplicates(docs: DataFrame, similarity: float = 0.8, distance: int = 11, words_each: int = 5, seed: int = 42, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row of each group of texts whose shingles are ``similarity`` alike, as their 128 bits tell; columns are carried.

    ``distance`` is how far apart the first 64 bits of such texts are looked for.
    """

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = node_of(_u64(batch.column(1)), _u64(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(node.view(np.int64))], ["nd_key", "fp", "more", "node"])

    rows = docs.withColumns({"nd_id": F.col(row_id).cast("long"), "nd_key": F.xxhash64(row_id, text)})
    first = F.struct(F.col("nd_id").isNull().alias("nameless"), "nd_id", "nd_key")
    prints = materialize(fingerprints(rows, words_each, seed, text, "nd_key", 128).mapInArrow(nodes, "nd_key long, fp long, more long, node long").distinct(), "fingerprints")
    keys = materialize(prints.join(rows.select("nd_id", "nd_key").distinct(), "nd_key").groupBy("fp", "more", "node").agg(F.min(first).alias("first")), "distinct-fingerprints")
    labels = components(near_links(keys.select("fp", "more"), distance, bits_apart(similarity, 128))).withColumnRenamed("v", "node")
    kept = keys.join(labels, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    kept = materialize(kept.select(F.col("first.nd_key").alias("k_key"), F.col("first.nd_id").alias("k_id")), "kept")
    own = rows.join(kept, (rows["nd_key"] == kept["k_key"]) & rows["nd_id"].eqNullSafe(kept["k_id"]))
    return own.dropDuplicates(["nd_key", "nd_id"]).select(*docs.columns)
