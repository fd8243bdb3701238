"""Approximate nearest neighbours along shifted Hilbert curves.

Vectors are centred at their mean, scaled by their spread, projected to ``dims`` random orthogonal directions, shifted
at random, cut to a grid and put in the order of a Hilbert curve; each of ``curves`` does so anew.  A curve's order is cut into ``tiles`` of equally many vectors by
key (quantiles of all keys), which Spark deals out by range.  A query looks at its own tile and ``reach`` tiles on
either side, on every curve; its nearest on each are merged and ranked by the exact distance on the original vectors.

Equal vectors are one row with their ten-odd smallest ids, enough for any result, so copies of a vector crowd no tile.
A tile's vectors stream past its queries in batches and may be dealt to several parts, so memory follows the queries
of a tile, not its vectors.  The window is a share of all vectors: recall stays alike at every size.

Defined results: rows without an id, and vectors that are null, empty, zero, of another length than most, or hold null
or non-finite components take no part; equal distances go to the smaller id; a query with fewer candidates than ``k``
gets all that it meets; repeated rows count once; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of grid cells (rows, dims) along a Hilbert curve of ``bits`` a dimension, by reflecting and swapping axes bit by bit."""
    x = cells.T.astype(np.uint64).copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        bit, low = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(dims):
            upper = (x[i] & bit) != 0
            swap = np.where(upper, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(upper, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap if i else np.uint64(0)
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        turn = np.where((x[-1] >> np.uint64(b)) & np.uint64(1) == 1, turn ^ np.uint64((1 << b) - 1), turn)
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return key


class Curves:
    """Projections, shifts and grid of all curves; drawn from a seed, for vectors centred at their mean and scaled by their spread."""

    def __init__(self, length: int, curves: int, dims: int, bits: int, seed: int, extent: float, mean: np.ndarray):
        rng = np.random.default_rng(seed)
        self.mean = mean
        dims = min(dims, length)
        self.bits = min(bits, 63 // dims)
        self.axes = [np.linalg.qr(rng.normal(size=(length, dims)))[0] for _ in range(curves)]
        self.shifts = [rng.random(dims) for _ in range(curves)]
        self.extent = extent

    def keys(self, vectors: np.ndarray) -> list[np.ndarray]:
        out, vectors = [], vectors - self.mean
        for axes, shift in zip(self.axes, self.shifts, strict=True):
            at = (vectors @ axes / self.extent + 1) / 2  # within 0 to 1 for most
            cells = np.clip(((at + shift) / 2 * (1 << self.bits)).astype(np.int64), 0, (1 << self.bits) - 1)
            out.append(hilbert_keys(cells, self.bits).astype(np.int64))
        return out


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls, all of one length, as float64 rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def moments(vectors: DataFrame) -> tuple[int, np.ndarray, float]:
    """Number of vectors, their mean, and the root mean square distance from it by dimension; sums are taken around each task's first vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, total, square = 0, None, 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                first = x[0].copy() if first is None else first
                n, total, square = n + len(x), total + (x - first).sum(axis=0), square + ((x - first) ** 2).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([first + total / n]), pa.array([square - total**2 / n])], ["n", "mean", "square"])

    parts = vectors.select("embedding").mapInArrow(run, "n long, mean array<double>, square array<double>").collect()  # a row a task
    if not parts:
        return 0, np.zeros(1), 1.0
    n = np.array([r["n"] for r in parts], float)
    means = np.array([r["mean"] for r in parts])
    base = means[0]
    mean = base + ((means - base) * n[:, None]).sum(axis=0) / n.sum()
    square = np.array([r["square"] for r in parts]).sum(axis=0) + (n[:, None] * (means - mean) ** 2).sum(axis=0)
    return int(n.sum()), mean, float(np.sqrt(max(square.sum(), 0.0) / n.sum() / len(mean)))


def nearest(asked: np.ndarray, some: np.ndarray, ids: np.ndarray, best: np.ndarray, best_id: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each query's best squared distances and ids so far, with those of ``some`` vectors taken in.

    A matrix product around the mean finds what can be among them within its error; that is measured by differences.
    """
    k = best.shape[1]
    a, b = asked - mean, some - mean
    aa, bb = (a**2).sum(axis=1), (b**2).sum(axis=1)
    rough = aa[:, None] + bb[None] - 2 * a @ b.T
    error = (aa + bb.max()) * 2.0**-44
    least = best[:, -1]
    if len(ids) > k:
        least = np.minimum(least, np.partition(rough, k - 1, axis=1)[:, k - 1] + error)
    q, j = np.nonzero(rough <= (least + error)[:, None])
    step = max(1, (1 << 20) // max(asked.shape[1], 1))
    exact = np.concatenate([((asked[q[i : i + step]] - some[j[i : i + step]]) ** 2).sum(axis=1) for i in range(0, len(q), step)] or [np.zeros(0)])
    old = np.isfinite(best)
    row, _ = np.nonzero(old)
    row, d, name = np.concatenate((row, q)), np.concatenate((best[old], exact)), np.concatenate((best_id[old], ids[j]))
    order = np.lexsort((name, d, row))
    row, d, name = row[order], d[order], name[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    best, best_id = np.full_like(best, np.inf), np.zeros_like(best_id)
    best[row[keep], place[keep]], best_id[row[keep], place[keep]] = d[keep], name[keep]
    return best, best_id


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, embedding) of rows that take part, without repeated rows."""
    v = F.col("embedding")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))
    length = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (length["n"] if length else 0)).distinct()


def neighbours(vectors: DataFrame, is_query: Column, k: int = 10, curves: int = 4, dims: int = 16, bits: int = 3, tiles: int = 7, reach: int = 1, part_rows: int = 200_000, seed: int = 7, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found; ``is_query`` is a condition on vec_id."""
    rows = usable(vectors, vec_id, embedding).withColumn("is_query", is_query)
    by_id = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= k + 1)
    few = few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked = rows.where("is_query").select("embedding").distinct().withColumn("asked", F.lit(True))
    distinct = materialize(few.join(asked, "embedding", "left").select(F.col("ids")[0].alias("rep"), "ids", F.coalesce("asked", F.lit(False)).alias("asked"), "embedding"), "vectors")
    n, mean, spread = moments(distinct)
    drawn = Curves(len(mean), curves, dims, bits, seed, max(3 * spread, 1e-300), mean)
    names = [f"k{i}" for i in range(curves)]

    def all_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in drawn.keys(matrix(batch.column(0)))], names)

    cuts = [i / tiles for i in range(1, tiles)]
    keys = distinct.select("embedding").mapInArrow(all_keys, ", ".join(f"{x} long" for x in names))
    bounds_row = keys.agg(*[F.percentile_approx(x, cuts, 10000).alias(x) for x in names]).first()
    bounds = [np.array(bounds_row[x] or [], np.int64) for x in names]
    parts = max(1, -(-n // (tiles * part_rows)))
    dealt = "cell long, queries boolean, rep long, embedding " + dict(distinct.dtypes)["embedding"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = np.flatnonzero(batch.column("asked").to_numpy(zero_copy_only=False))
            rep = batch.column("rep").to_numpy()
            for c, keys in enumerate(drawn.keys(matrix(batch.column("embedding")))):
                tile = np.searchsorted(bounds[c], keys, "right")
                cell = (c * tiles + tile) * parts + rep % parts
                yield _deal(batch, np.arange(len(rep)), cell, False)
                for step in range(-reach, reach + 1):
                    near = tile[asked] + step
                    ok = (near >= 0) & (near < tiles)
                    for part in range(parts):
                        yield _deal(batch, asked[ok], (c * tiles + near[ok]) * parts + part, True)

    def _deal(batch: pa.RecordBatch, at: np.ndarray, cell: np.ndarray, queries: bool) -> pa.RecordBatch:
        take = pa.array(at)
        return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.full(len(at), queries)), batch.column("rep").take(take), batch.column("embedding").take(take)], ["cell", "queries", "rep", "embedding"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked_id, asked, best_id, best = None, [], [], None, None

        def found() -> pa.RecordBatch:
            q, j = np.nonzero(np.isfinite(best))
            return pa.RecordBatch.from_arrays([pa.array(asked_id[q]), pa.array(best_id[q, j]), pa.array(np.sqrt(best[q, j]))], ["q", "rep", "score"])

        for batch in batches:
            cells, queries = batch.column("cell").to_numpy(), batch.column("queries").to_numpy(zero_copy_only=False)
            rep, x = batch.column("rep").to_numpy(), matrix(batch.column("embedding")) if batch.num_rows else None
            cut = np.flatnonzero(np.concatenate(([True], (cells[1:] != cells[:-1]) | (queries[1:] != queries[:-1])))) if batch.num_rows else []
            for a, b in zip(cut, [*cut[1:], batch.num_rows], strict=True):
                if cells[a] != cell:
                    if best is not None:
                        yield found()
                    cell, asked_id, asked, best = cells[a], [], [], None
                if queries[a]:
                    asked_id.append(rep[a:b])
                    asked.append(x[a:b])
                    continue
                if not len(asked):
                    continue
                if best is None:
                    asked_id, asked = np.concatenate(asked_id), np.concatenate(asked)
                    best, best_id = np.full((len(asked), k + 1), np.inf), np.zeros((len(asked), k + 1), np.int64)
                for s in range(a, b, 2048):
                    some, ids = x[s : min(b, s + 2048)], rep[s : min(b, s + 2048)]
                    best, best_id = nearest(asked, some, ids, best, best_id, drawn.mean)
        if best is not None:
            yield found()

    near = distinct.mapInArrow(deal, dealt).repartition("cell").sortWithinPartitions("cell", F.desc("queries")).mapInArrow(search, "q long, rep long, score double").distinct()
    top = near.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy("score", "rep"))).where(F.col("nth") <= k + 1).drop("nth")
    ids = distinct.select("rep", "ids")
    hits = top.join(ids, "rep").select("q", "score", F.explode("ids").alias("vec_id"))
    # the nearest k + 1 ids of each distinct query, then each of its own rows without itself
    hits = hits.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).where(F.col("nth") <= k + 1)
    lists = hits.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near")).join(distinct.select(F.col("rep").alias("q"), "embedding"), "q").select("embedding", "near")
    each = rows.where("is_query").select(F.col("vec_id").alias("query_id"), "embedding").join(lists, "embedding")
    own = F.filter("near", lambda s: s["vec_id"] != F.col("query_id"))
    return each.select("query_id", F.posexplode(F.slice(own, 1, k)).alias("pos", "hit")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
