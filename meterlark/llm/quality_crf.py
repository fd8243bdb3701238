"""Document quality from a linear-chain conditional random field over lines.

Every line gets features of its bytes and words (kinds of characters, length, repetition) and of its neighbours' lines.
A two-state chain (good, bad) is fitted by gradient ascent on its likelihood.  As labels are by document, lines of bad
documents that a first, chainless fit finds good are taken as good.  Forward-backward marginals of "good", weighted by
the lines' length, give a document's share of good text, which logistic calibration on the training documents turns
into the probability of label 1.

Fitting takes at most ``per_class`` documents of each label (a documented bound); their line features visit the driver.
Scoring streams slices of text; chains of a slice walk in step.

Defined results: null and empty texts, and texts without a non-empty line, get the calibrated score of a text of the
average good share; with no training rows every score is 0.5; rows are kept as they are; long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, span_hashes, word_hashes, word_spans

PER_CLASS = 4000
OWN, NEAR = 16, [3, 5, 6, 7, 11, 13]
WIDTH = OWN + 2 * len(NEAR) + 2


def _kind(letters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(letters)] = True
    return out


KINDS = [
    _kind(bytes(range(97, 123))),
    _kind(bytes(range(65, 91))),
    _kind(b"0123456789"),
    _kind(b"#$%&*<>{}[]=~^\\_@/+`"),
    _kind(b"|"),
    _kind(b"!?"),
    _kind(b".,;:"),
    _kind(bytes(range(128, 256))),
]


def lines_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bytes, features) of each non-empty line."""
    stop = np.zeros(len(data), bool)
    stop[data == 10] = True
    stop[data == 13] = True
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.concatenate(([True], stop[:-1])) | edge[:-1] if len(data) else stop
    after = np.concatenate((stop[1:], [True])) | edge[1:] if len(data) else stop
    start = np.flatnonzero(~stop & before)
    end = np.flatnonzero(~stop & after) + 1
    n = len(start)
    x = np.zeros((n, WIDTH), np.float32)
    row = np.searchsorted(at, start, "right") - 1
    size = (end - start).astype(np.float64)
    if not n:
        return row, size, x
    share = []
    for kind in KINDS:
        seen = np.concatenate(([0], np.cumsum(kind[data], dtype=np.int64)))
        share.append((seen[end] - seen[start]) / size)
    word_start, word_end, _ = word_spans(data, at)
    line = np.searchsorted(start, word_start, "right") - 1
    words = np.bincount(line, minlength=n)
    hashes = word_hashes(data, word_start, word_end)
    twice = np.zeros(len(hashes), bool)
    twice[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    letters = np.bincount(line, word_end - word_start, minlength=n)
    text_hash = span_hashes(data, start, end) ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, group, times = np.unique(text_hash, return_inverse=True, return_counts=True)
    first, last = data[start], data[end - 1]
    own = [
        np.ones(n), np.log1p(size) / 8, share[0], share[1], share[2], share[3] * 3, share[4] * 10, share[5] * 5, share[6] * 3, share[7],
        letters / np.maximum(words, 1) / 10, np.bincount(line, twice, minlength=n) / np.maximum(words, 1) * 2, times[group] > 1, words < 4, (first >= 65) & (first <= 90), (last == 46) | (last == 33) | (last == 63),
    ]
    x[:, :OWN] = np.stack(own, axis=1)
    same = row[1:] == row[:-1]
    x[1:, OWN : OWN + len(NEAR)] = x[:-1, NEAR] * same[:, None]
    x[:-1, OWN + len(NEAR) : OWN + 2 * len(NEAR)] = x[1:, NEAR] * same[:, None]
    x[0, -2] = x[-1, -1] = 1
    x[1:, -2], x[:-1, -1] = ~same, ~same
    return row, size, x


def marginals(emit: np.ndarray, first: np.ndarray, length: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line, expected transitions and log likelihood's partition; ``emit`` is good's score, bad's is 0.

    Chain d holds the lines first[d] .. first[d] + length[d]; ``link[a, b]`` scores going from state a to b (1: good).
    """
    good = np.zeros(len(emit))
    pairs = np.zeros((2, 2))
    if not len(length):
        return good, pairs, 0.0
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    alive = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")
    e = np.exp(link)
    forward = np.zeros((len(emit), 2))
    scale = np.zeros(len(emit))
    top = np.maximum(emit, 0)
    node = np.stack((np.exp(-top), np.exp(emit - top)), axis=1)
    state = np.ones((len(first), 2))
    for t, n in enumerate(alive.tolist()):
        at = first[:n] + t
        v = (state[:n] @ e if t else state[:n]) * node[at]
        total = v.sum(axis=1)
        state[:n] = v / total[:, None]
        forward[at], scale[at] = state[:n], np.log(total) + top[at]
    back = np.ones((len(first), 2))
    for t in range(len(alive) - 1, -1, -1):
        n = alive[t]
        at = first[:n] + t
        both = forward[at] * back[:n]
        total = both.sum(axis=1)
        good[at] = both[:, 1] / total
        if t:
            right = node[at] * back[:n]
            joint = forward[at - 1][:, :, None] * e[None] * right[:, None, :]
            weight = joint.sum(axis=(1, 2))
            pairs += (joint / weight[:, None, None]).sum(axis=0)
            back[:n] = right @ e.T
            back[:n] /= back[:n].sum(axis=1, keepdims=True)
    return good, pairs, float(scale.sum())


class Model:
    """Line weights, links between states and the calibration of a document's good share."""

    def __init__(self, weights: np.ndarray, link: np.ndarray, calibration: np.ndarray, usual: float):
        self.weights, self.link, self.calibration, self.usual = weights, link, calibration, usual


def document_inputs(good: np.ndarray) -> np.ndarray:
    q = np.clip(good, 1e-4, 1 - 1e-4)
    return np.stack((np.ones_like(q), q, np.log(q / (1 - q)) / 4), axis=1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weighted logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - p)) - ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-7:
            break
    return w


def chains_of(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First line and length of each chain: a row's lines."""
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    return first, np.diff(np.append(first, len(row)))


def fit(sample: DataFrame, steps: int = 150, rate: float = 0.1, ridge: float = 1e-4) -> Model | None:
    """Fit on a bounded sample (doc_id, text, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in slices(batches, "text"):
            row, size, x = lines_of(data, at)
            ids, y = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(y[row].astype(np.int32)), pa.array(size), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), WIDTH).cast(pa.list_(pa.float32()))], ["doc_id", "y", "size", "x"])

    table = sample.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, size double, x array<float>").toArrow()
    if not table.num_rows:
        return None
    x = table["x"].combine_chunks().flatten().to_numpy().reshape(-1, WIDTH).astype(np.float64)
    y, size, ids = table["y"].to_numpy(), table["size"].to_numpy(), table["doc_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    x, y, size, ids = x[order], y[order], size[order], ids[order]
    # lines count by length, and either label's documents for as much as the other's
    weight = size / size.mean()
    balance = np.where(y == 1, 0.5 / max((weight * (y == 1)).sum(), 1e-9), 0.5 / max((weight * (y == 0)).sum(), 1e-9)) * weight.sum()
    w = logistic(x, y.astype(float), weight * balance)
    label = np.where(y == 1, 1.0, (x @ w > 1.0).astype(float))
    first, length = chains_of(ids)
    inner = np.ones(len(label), bool)
    inner[first] = False
    pair = np.zeros((2, 2))
    at = np.flatnonzero(inner)
    np.add.at(pair, (label[at - 1].astype(int), label[at].astype(int)), 1)
    link, mean, spread = np.zeros((2, 2)), [np.zeros_like(w), np.zeros((2, 2))], [np.zeros_like(w), np.zeros((2, 2))]
    for t in range(1, steps + 1):
        good, seen, _ = marginals(x @ w, first, length, link)
        grads = [x.T @ (label - good) / len(label) - ridge * w, (pair - seen) / len(label) - ridge * link]
        for k, (value, g) in enumerate(zip((w, link), grads, strict=True)):
            mean[k] = 0.9 * mean[k] + 0.1 * g
            spread[k] = 0.99 * spread[k] + 0.01 * g * g
            value += rate * (mean[k] / (1 - 0.9**t)) / (np.sqrt(spread[k] / (1 - 0.99**t)) + 1e-8)
    good, _, _ = marginals(x @ w, first, length, link)
    share = np.add.reduceat(good * size, first) / np.add.reduceat(size, first)
    return Model(w, link, logistic(document_inputs(share), y[first].astype(float), np.ones(len(first)), 0.1), float(share.mean()))


def score(docs: DataFrame, model: Model | None, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """(doc_id, score, good_share, lines): ``lines`` has each line's P(good) in order."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, data, at in slices(batches, "text", 2 << 20):
            n = batch.num_rows
            row, size, x = lines_of(data, at)
            if m is None:
                good, share, out = np.full(len(row), 0.5), np.full(n, 0.5), np.full(n, 0.5)
            else:
                first, length = chains_of(row)
                good, _, _ = marginals(x @ m.weights, first, length, m.link)
                total = np.bincount(row, size, minlength=n)
                share = np.where(total > 0, np.bincount(row, size * good, minlength=n) / np.maximum(total, 1), m.usual)
                out = 1 / (1 + np.exp(-document_inputs(share) @ m.calibration))
            places = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), pa.array(share), pa.ListArray.from_arrays(pa.array(places), pa.array(good))], ["doc_id", "score", "good_share", "lines"])

    return docs.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double, good_share double, lines array<double>")
