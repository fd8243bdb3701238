"""URL rules by a Bloom filter cascade.

A rule is a host and a path prefix with an action.  It fits its host, all subdomains, and every path that starts with
its own; of those that fit, the one with the longest host and path together wins (then the longer host).  The keys that
could decide a URL are its host's suffixes, each with its path's prefixes of the lengths that rules have.  Looking up a
URL means asking, for each of its keys from long to short, whether it is listed.

Level 0 of a cascade holds the listed keys; level 1 the keys of the corpus that level 0 takes in wrongly; level 2 the
listed keys that level 1 takes in, and so on until nothing is taken in wrongly.  Over the corpus's complete key
universe the answer is then exact, from filters whose size follows the list (about 1.44 bits times the logarithm of
universe by list, a key), with no join of URLs and rules.  There is one cascade for the rules that block and one for
those that allow.  Filters over ``max_filter_bytes`` are not broadcast: the list is split by hash into parts below the
bound, and the pages pass the parts one after another, keeping the best rule so far.

Defined results: a URL that is null or has no ``://`` has an empty host and path; a URL that no rule fits is not listed
and gets ``default``; a rule listed with both actions blocks; rows are kept as they are, repeated or not; no rules, or
no pages, give defined empty cascades and results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = "h1 long, h2 long"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def keys_of(host: str, path: str, lengths: Sequence[int]) -> list[str]:
    """Keys that could decide a URL, the longest first (then the one with the longer host); as host + path."""
    if not host:
        return []
    hosts = [host] + [host[i + 1 :] for i, c in enumerate(host) if c == "."]
    found = [(len(h) + n, len(h), h + "\0" + path[:n]) for h in hosts for n in lengths if n <= len(path)]
    return [k for *_, k in sorted(found, reverse=True)]


def hashed(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each key."""
    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k.encode()) for k in keys), ">u8").reshape(-1, 2).astype(np.uint64)
    return both[:, 0].copy(), both[:, 1].copy()


def places(h1: np.ndarray, h2: np.ndarray, bits: int, hashes: int, level: int) -> np.ndarray:
    """(keys, hashes) bit numbers; each level has its own."""
    a = mix(h1 + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    b = mix(h2 + np.uint64(level)) | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(hashes, dtype=np.uint64)) % np.uint64(bits)


def holds(level: tuple[int, int, np.ndarray], at: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    bits, hashes, words = level
    p = places(h1, h2, bits, hashes, at)
    return ((words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)).all(axis=1)


def listed(cascade: list[tuple[int, int, np.ndarray]], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key is in the list: the parity of the first level that lacks it tells."""
    answer = np.full(len(h1), len(cascade) % 2 == 1)
    alive = np.arange(len(h1))
    for at, level in enumerate(cascade):
        inside = holds(level, at, h1[alive], h2[alive])
        answer[alive[~inside]] = at % 2 == 1
        alive = alive[inside]
        if not len(alive):
            break
    return answer


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(n).to_numpy(zero_copy_only=False).view(np.uint64) for n in ("h1", "h2"))


def level_of(keys: DataFrame, n: int, rate: float, at: int) -> tuple[int, int, np.ndarray]:
    """A Bloom filter of ``keys`` (h1, h2): words of bits are or-ed in Spark; the driver gets the filter's words alone."""
    bits = max(64, math.ceil(1.4427 * n * math.log2(1 / rate)))
    hashes = max(1, round(math.log2(1 / rate)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = places(*_columns(batch), bits, hashes, at).ravel()
            yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (p & np.uint64(63))).view(np.int64))], ["word", "mask"])

    words = np.zeros(bits // 64 + 1, np.uint64)
    set_ = keys.select("h1", "h2").mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words[set_["word"].to_numpy()] = set_["mask"].to_numpy().view(np.uint64)
    return bits, hashes, words


def inside(keys: DataFrame, level: tuple[int, int, np.ndarray], at: int) -> DataFrame:
    """Those of ``keys`` that a level takes in."""
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(holds(shared.value, at, *_columns(batch))))

    return keys.mapInArrow(run, KEY)


def build_cascade(universe: DataFrame, keys: DataFrame, universe_size: int) -> list[tuple[int, int, np.ndarray]]:
    """Levels of (bits, hashes, words) that tell ``keys`` from all other keys of ``universe`` (both h1, h2)."""
    keys = materialize(keys.distinct(), "listed")
    n = keys.count()
    if not n:
        return []
    rate = min(0.5, max(1e-9, n / (math.sqrt(2) * max(universe_size, 1))))
    levels = [level_of(keys, n, rate, 0)]
    tagged = inside(universe, levels[0], 0).withColumn("is_listed", F.lit(0)).unionByName(keys.withColumn("is_listed", F.lit(1)))
    wrong = materialize(tagged.groupBy("h1", "h2").agg(F.max("is_listed").alias("is_listed")).where("is_listed = 0").select("h1", "h2"), "wrong")
    right, held = keys, wrong
    while (n := held.count()) > 0:
        at = len(levels)
        levels.append(level_of(held, n, 0.5, at))
        right, held = held, materialize(inside(right, levels[at], at), "cascade")
    return levels


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", max_filter_bytes: int = 64 << 20) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (host and path, or null) and ``verdict``.

    ``rules``: (host, path, action), action ``allow`` or ``block``; hosts in lower case.
    """
    spark = pages.sparkSession
    rules = materialize(rules.groupBy("host", "path").agg(F.max(F.col("action") == "block").alias("blocks")), "rules")
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())  # at most as many as a path has characters
    split = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})

    def all_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[str] = set()
            for host, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.update(keys_of(host, path, lengths))
            h1, h2 = hashed(list(seen))
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], ["h1", "h2"])

    def rule_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = hashed([h + "\0" + p for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], ["h1", "h2"])

    universe = split.select("host", "path").distinct().mapInArrow(all_keys, KEY)
    size, n = universe.agg(F.approx_count_distinct(F.xxhash64("h1", "h2"))).first()[0], rules.count()
    need = n * (1.45 * math.log2(max(2.0, size / max(n, 1))) + 6) / 8
    parts = max(1, math.ceil(need / max_filter_bytes))
    out = split.withColumns({"uf_key": F.lit(None).cast("string"), "uf_blocks": F.lit(None).cast("boolean")})
    for part in range(parts):
        mine = rules.where(F.pmod(F.xxhash64("host", "path"), F.lit(parts)) == part)
        cascades = {blocks: build_cascade(universe, mine.where(F.col("blocks") == blocks).select("host", "path").mapInArrow(rule_keys, KEY), size) for blocks in (True, False)}
        shared = spark.sparkContext.broadcast(cascades)

        def look_up(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            levels = shared.value
            for batch in batches:
                best, blocks = batch.column("uf_key").to_pylist(), batch.column("uf_blocks").to_pylist()
                each = [keys_of(h, p, lengths) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
                flat = [k for keys in each for k in keys]
                hashes = hashed(flat)
                block, allow = listed(levels[True], *hashes), listed(levels[False], *hashes)
                hit, at = np.flatnonzero(block | allow), 0
                row_of = np.repeat(np.arange(len(each)), [len(x) for x in each])
                first, at = np.unique(row_of[hit], return_index=True)
                for row, i in zip(first.tolist(), hit[at].tolist(), strict=True):
                    new, old = flat[i], best[row]
                    if old is None or (len(new), new.index("\0")) > (len(old), old.index("\0")):
                        best[row], blocks[row] = new, bool(block[i])
                names = batch.schema.names
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names[:-2]), pa.array(best, pa.string()), pa.array(blocks, pa.bool_())], names)

        out = out.mapInArrow(look_up, out.schema)
        if parts > 1:
            out = materialize(out, "looked-up")
    verdict = F.when(F.col("uf_key").isNull(), F.lit(default)).when(F.col("uf_blocks"), F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumns({"rule": F.translate("uf_key", "\0", ""), "verdict": verdict}).drop("uf_key", "uf_blocks")
