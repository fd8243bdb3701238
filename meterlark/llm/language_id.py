"""Language identification of words, spans and documents.

Each word is scored for each language by naive Bayes over its byte trigrams (with its edges) and the word itself, from
counts over all training text.  The word's script narrows the candidates: a language takes part only if the script
makes up at least ``script_share`` of its training letters (all take part if none qualifies).  A Viterbi pass over a
document's words, with a penalty for each switch, labels spans of mixed-language text.  A document's language is the
one with the most letter bytes; ``score`` is its share of them times its odds against the other languages as a whole.

Counts are summed within tasks and then by Spark; the driver gets one row for each (hash bucket, language), a bound
that doesn't follow the corpus.  Prediction streams slices of text through numpy; documents walk in step, so the work
is a few array operations for each word position.

A letter is a character of Unicode's categories L.

Defined results: null text, and text without a letter, is ``und`` with score 0 and no spans; ties go to the smaller
language code; with no training rows everything is ``und``; long texts are read whole; rows are kept as they are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, SLICE_BYTES, slices, word_hashes, word_spans

GRAMS, WORDS = 1 << 16, 1 << 16
UNKNOWN = "und"
FLUSH_BYTES = 8 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True

#: Scripts as ranges of code points (the main blocks of each).
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
NO_SCRIPT, OTHER = 0, len(SCRIPTS) + 1
#: Script of each letter of all planes; what is no letter has none.
SCRIPT_OF = np.array([OTHER if unicodedata.category(chr(c))[0] == "L" else NO_SCRIPT for c in range(0x110000)], np.uint8)
for _i, _ranges in enumerate(SCRIPTS.values(), 1):
    for _a, _b in _ranges:
        SCRIPT_OF[_a : _b + 1][SCRIPT_OF[_a : _b + 1] == OTHER] = _i


def scripts_of_bytes(data: np.ndarray) -> np.ndarray:
    """For each byte that begins a character its script, else NO_SCRIPT."""
    out = np.where(ASCII_LETTER[data], np.uint8(1), np.uint8(NO_SCRIPT))
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        b = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.int32)
        one, two, three = b[lead], b[lead + 1] & 63, b[lead + 2] & 63
        four = b[lead + 3] & 63
        code = np.where(one < 0xE0, (one & 31) << 6 | two, np.where(one < 0xF0, (one & 15) << 12 | two << 6 | three, (one & 7) << 18 | two << 12 | three << 6 | four))
        out[lead] = SCRIPT_OF[code]
    return out


def features(data: np.ndarray, at: np.ndarray):
    """Of each word: start, end, row, whole-word bucket, script, letter bytes; and of each byte its trigram bucket."""
    start, end, row = word_spans(data, at)
    low = LOWER[data]
    space = IS_SPACE[data]
    padded = np.full(len(data) + 2, 32, np.int32)
    padded[1:-1] = np.where(space, 32, low)
    before, after = padded[:-2].copy(), padded[2:].copy()
    edge = at[(at > 0) & (at < len(data))]
    before[edge], after[edge - 1] = 32, 32
    code = (before << 16 | padded[1:-1] << 8 | after).astype(np.uint32)
    gram = (code * np.uint32(2654435761)) >> np.uint32(16)
    word = (word_hashes(low, start, end) >> np.uint64(48)).astype(np.int64)
    script = scripts_of_bytes(data)
    letters = np.concatenate(([0], np.cumsum(ASCII_LETTER[data] | (data >= 0x80))))
    kind = np.maximum.reduceat(script, start) if len(start) else np.zeros(0, np.uint8)
    size = letters[end] - letters[start]
    return start, end, row, word, kind, np.where(kind == NO_SCRIPT, 0, size), gram


class Model:
    """Log probabilities of buckets by language, and which languages a script allows."""

    def __init__(self, languages: list[str], grams: np.ndarray, words: np.ndarray, allowed: np.ndarray):
        self.languages, self.grams, self.words, self.allowed = languages, grams, words, allowed


def train(docs: DataFrame, text: str = "text", lang: str = "lang", script_share: float = 0.01, smoothing: float = 0.5) -> Model:
    """Count all rows of ``docs`` with a language; the driver gets counts by bucket and language alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[str, int] = {}
        size = GRAMS + WORDS + OTHER + 1
        counts = np.zeros((0, size), np.int64)
        for batch, data, at in slices(batches, "text"):
            names = batch.column(1).to_pylist()
            start, end, row, word, kind, letters, gram = features(data, at)
            if not len(start):
                continue
            code = np.array([index.setdefault(x, len(index)) for x in names])
            n = len(index)
            if n > len(counts):
                counts = np.concatenate((counts, np.zeros((n - len(counts), size), np.int64)))
            solid = ~IS_SPACE[data]
            counts[:, :GRAMS] += np.bincount(np.repeat(code, np.diff(at))[solid] * GRAMS + gram[solid], minlength=n * GRAMS).reshape(n, GRAMS)
            counts[:, GRAMS : GRAMS + WORDS] += np.bincount(code[row] * WORDS + word, minlength=n * WORDS).reshape(n, WORDS)
            counts[:, GRAMS + WORDS :] += np.bincount(code[row] * (OTHER + 1) + kind, letters, minlength=n * (OTHER + 1)).astype(np.int64).reshape(n, OTHER + 1)
        for name, i in index.items():
            used = np.flatnonzero(counts[i]) if i < len(counts) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(counts[i][used] if len(used) else used)], ["lang", "bucket", "n"])

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    table = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = table["lang"].to_pylist()
    languages = sorted(set(names))
    index = {x: i for i, x in enumerate(languages)}
    counts = np.zeros((GRAMS + WORDS + OTHER + 1, len(languages)))
    if languages:
        counts[table["bucket"].to_numpy(), [index[x] for x in names]] = table["n"].to_numpy()
    logs = lambda c: (np.log(c + smoothing) - np.log(c.sum(axis=0) + smoothing * len(c))).astype(np.float32)
    scripts = counts[GRAMS + WORDS :]
    allowed = scripts >= script_share * np.maximum(scripts[1:].sum(axis=0), 1)
    allowed[~allowed.any(axis=1)] = True
    return Model(languages, logs(counts[:GRAMS]), logs(counts[GRAMS : GRAMS + WORDS]), allowed)


def viterbi(scores: np.ndarray, first: np.ndarray, length: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word; document d has the words first[d] .. first[d] + length[d]."""
    labels = np.zeros(len(scores), np.int32)
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    alive = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), "right")  # documents with word t
    stay, best_before = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int32)
    value = np.zeros((len(first), scores.shape[1]), np.float32)
    for t, n in enumerate(alive.tolist()):
        at, v = first[:n] + t, value[:n]
        if t:
            top = v.argmax(axis=1)
            reach = v[np.arange(n), top] - penalty
            kept = v >= reach[:, None]
            stay[at], best_before[at] = kept, top
            v = np.where(kept, v, reach[:, None])
        value[:n] = v + scores[at]
    now = np.zeros(len(first), np.int64)
    for t in range(len(alive) - 1, -1, -1):
        n = alive[t]
        more = alive[t + 1] if t + 1 < len(alive) else 0
        now[more:n] = value[more:n].argmax(axis=1)
        at = first[:n] + t
        labels[at] = now[:n]
        if t:
            now[:n] = np.where(stay[at, now[:n]], now[:n], best_before[at])
    return labels


def identify(docs: DataFrame, model: Model, penalty: float = 12.0, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score, spans): spans are runs of words (first, last, from 0) with their language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    count = len(model.languages)
    narrow = max(1, count // 8)  # tables have a column a language: the more languages, the less text at a time

    def finish(ids: pa.Array, scores: np.ndarray, row: np.ndarray, letters: np.ndarray, m: Model) -> pa.RecordBatch:
        n = len(ids)
        length = np.bincount(row, minlength=n)
        first = np.concatenate(([0], np.cumsum(length)[:-1]))
        labels = viterbi(scores, first, length, penalty).astype(np.int64) if len(row) and count else np.zeros(len(row), np.int64)
        share = np.zeros((n, max(count, 1)))
        np.add.at(share, (row, labels), letters)
        total = share.sum(axis=1)
        known = (total > 0) & (count > 0)
        win = share.argmax(axis=1)
        whole = np.zeros((n, max(count, 1)))
        if count and len(row):
            has = np.flatnonzero(length)
            whole[has] = np.add.reduceat(scores.astype(np.float64), first[has], axis=0)
        odds = np.exp(np.clip(whole[np.arange(n), win][:, None] - whole, -50, 50) * -1).sum(axis=1)
        score = np.where(known, share[np.arange(n), win] / np.maximum(total, 1) / np.maximum(odds, 1), 0.0)
        names = np.array(m.languages or [UNKNOWN], object)
        cut = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (labels[1:] != labels[:-1])))) if len(row) else np.zeros(0, np.int64)
        cut = cut[known[row[cut]]] if len(cut) else cut
        stop = np.append(cut[1:], len(row))
        stop = np.minimum(stop, first[row[cut]] + length[row[cut]]) if len(cut) else stop[:0]
        places = np.concatenate(([0], np.cumsum(np.bincount(row[cut], minlength=n)))).astype(np.int32)
        spans = pa.StructArray.from_arrays([pa.array((cut - first[row[cut]]).astype(np.int32)), pa.array((stop - 1 - first[row[cut]]).astype(np.int32)), pa.array(names[labels[cut]] if len(cut) else [], pa.string())], ["first", "last", "lang"])
        return pa.RecordBatch.from_arrays([ids, pa.array(np.where(known, names[win], UNKNOWN), pa.string()), pa.array(score), pa.ListArray.from_arrays(pa.array(places), spans)], ["doc_id", "lang_pred", "score", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        held: list = []
        size = rows = 0
        for batch, data, at in slices(batches, "text", SLICE_BYTES // narrow):
            start, end, row, word, kind, letters, gram = features(data, at)
            if len(start) and count:
                table = m.grams[gram]
                table[IS_SPACE[data]] = 0
                # a word's bytes are followed by spaces, whose rows are zero
                scores = np.add.reduceat(table, start, axis=0) + m.words[word]
                scores = np.where(m.allowed[kind], scores, scores - 1000).astype(np.float32)
                scores[kind == NO_SCRIPT] = 0
                scores -= scores.max(axis=1, keepdims=True)
            else:
                scores = np.zeros((len(start), max(count, 1)), np.float32)
            held.append((batch.column(0), scores, row + rows, letters))
            rows += batch.num_rows
            size += len(data)
            if size >= FLUSH_BYTES // narrow:
                yield finish(pa.concat_arrays([x[0] for x in held]), *(np.concatenate([x[i] for x in held]) for i in (1, 2, 3)), m)
                held, size, rows = [], 0, 0
        if held:
            yield finish(pa.concat_arrays([x[0] for x in held]), *(np.concatenate([x[i] for x in held]) for i in (1, 2, 3)), m)

    return docs.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<first:int,last:int,lang:string>>")
