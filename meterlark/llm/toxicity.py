"""Toxicity by weak supervision.

Two dozen voters say toxic, clean, or nothing: public seed lexicons by language and force; lexicons of whole words and of
word beginnings (4 and 5 bytes) that lean towards toxic in a bounded sample of labelled documents, by how strongly they
lean; patterns of address, shouting, exclamation, masked and stretched words, "you are", commands and density; and two
that vote clean where nothing suspicious occurs.

A generative label model over all documents' votes estimates, for each class, every voter's accuracy and the correlations
between voters: given the class, each voter depends on one other (a tree of the largest conditional mutual information),
so probabilities are exact and sum to one.  It is fitted by expectation-maximisation on the counts of vote patterns,
begun from the labelled sample; each step is one aggregation by Spark of tables whose size depends on the voters alone.
The model's posteriors then label documents, labelled or not, and a logistic regression on the lexicon features and a
few measures of the text learns from a bounded sample of them (``train_rows``) and from the labelled sample.

All texts are read once: what a document has of the lexicon, its measures and its votes become a small table.

Defined results: null and empty texts get the score of a text with no features; without any labels, or with labels of
one class alone, the seed lexicons and the patterns decide; rows are kept as they are; long texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix, slices, span_hashes, word_spans
from .language_id import ASCII_LETTER, LOWER

PER_CLASS = 10_000
LEXICON = 8192
TRAIN_ROWS = 40_000

#: Small public lists of insults, by language and force.
SEEDS = {
    "en_mild": "idiot idiots moron morons stupid loser losers trash pathetic worthless disgusting clown dumb imbecile jerk crap".split(),
    "en_strong": "scum bastard bitch asshole shit fuck fucking retard".split(),
    "es": "idiota imbécil estúpido basura asqueroso mierda puta cabrón".split(),
    "fr": "idiote imbécile stupide connard salope merde ordure crétin".split(),
    "de": "dummkopf trottel arschloch scheiße abschaum hurensohn vollidiot".split(),
}
#: Words of address, forms of "are" after them, and commands.
ADDRESS = "you your youre du dich dein tu toi vous tú usted".split()
ARE = "are re r bist seid es êtes eres".split()
COMMANDS = "shut verpiss stirb ferme dégage crève cállate lárgate muere".split()
KINDS, STRATA = 3, 3
LEXICONS = [*(f"seed_{k}" for k in SEEDS), *(f"{kind}_{level}" for kind in ("word", "begin5", "begin4") for level in ("strong", "middle", "weak"))]
VOTERS = [*LEXICONS, "address", "shouting", "exclamation", "masked", "stretched", "you_are", "command", "density", "clean_long", "clean_calm"]
CELLS = 3 * len(VOTERS)
MEASURES = 5


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and start, end and row of each run of letters."""
    letter = ASCII_LETTER[data] | (data >= 0x80)
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    if not len(data):
        none = np.zeros(0, np.int64)
        return data, none, none, none
    start = np.flatnonzero(letter & (~np.concatenate(([False], letter[:-1])) | edge[:-1]))
    end = np.flatnonzero(letter & (~np.concatenate((letter[1:], [False])) | edge[1:])) + 1
    return LOWER[data], start, end, np.searchsorted(at, start, "right") - 1


def token_features(data: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Hashes and rows of whole words, of beginnings of 5 bytes and of 4; and the words of each row."""
    low, start, end, row = tokens(data, at)
    hashes, rows = [span_hashes(low, start, end)], [row]
    for n in (5, 4):
        long = np.flatnonzero(end - start > n)
        hashes.append(mix(span_hashes(low, start[long], start[long] + n) + np.uint64(n)))
        rows.append(row[long])
    return hashes, rows, np.bincount(row, minlength=len(at) - 1)


def word_hash_set(words: list[str]) -> np.ndarray:
    """Sorted hashes of whole words, as ``token_features`` gives them."""
    texts = [w.encode() for w in words]
    at = np.concatenate(([0], np.cumsum([len(x) for x in texts])))
    return np.unique(token_features(np.frombuffer(b"".join(texts), np.uint8), at)[0][0])


class Lexicon:
    """Sorted feature hashes with the voter each is for."""

    def __init__(self, hashes: np.ndarray, voter: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.voter = hashes[order], voter[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` that are in the lexicon, and which entry each is."""
        some = np.flatnonzero(self.maybe[(hashes >> np.uint64(44)).astype(np.int64)])
        if not len(self.hashes):
            return some[:0], some[:0]
        entry = np.minimum(np.searchsorted(self.hashes, hashes[some]), len(self.hashes) - 1)
        hit = self.hashes[entry] == hashes[some]
        return some[hit], entry[hit]


def without_copies(sample: DataFrame) -> DataFrame:
    """One row of each set of rows that have a label and their two least-hashed five-word shingles in common, as near copies have.

    Else the chance words of one toxic text that was copied many times would look like a lexicon.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in slices(batches, "text"):
            start, end, row = word_spans(data, at)
            words = span_hashes(LOWER[data], start, end)
            whole = np.flatnonzero(row[:-4] == row[4:]) if len(row) > 4 else np.zeros(0, np.int64)
            first = np.searchsorted(row, np.arange(batch.num_rows + 1))
            short = np.flatnonzero((np.diff(first) < 5) & (np.diff(first) > 0))
            h = np.concatenate((span_hashes(words, whole, whole + 5), span_hashes(words, first[short], first[short + 1])))
            of = np.concatenate((row[whole], short))
            order = np.lexsort((h, of))
            h, of = h[order], of[order]
            once = np.concatenate(([True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])))[: len(h)]
            h, of = h[once], of[once]
            edge = np.searchsorted(of, np.arange(batch.num_rows + 1))
            pad = np.append(h, np.zeros(2, np.uint64))
            count = np.diff(edge)
            mark = mix(np.where(count > 0, pad[edge[:-1]], 0) * np.uint64(3) + np.where(count > 1, pad[edge[:-1] + 1], 0)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(mark)], ["doc_id", "text", "y", "mark"])

    marked = sample.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, text string, y int, mark long")
    return marked.groupBy("y", "mark").agg(F.min_by(F.struct("doc_id", "text"), "doc_id").alias("d")).select("d.doc_id", "d.text", "y")


def mine(sample: DataFrame, size: int = LEXICON, least: int = 3, least_lean: float = 4.0, significance: float = 15.0) -> Lexicon:
    """Features that lean towards toxic in the sample, at most ``size``, chosen by Spark; with the seed lexicons.

    A feature must be in ``least`` toxic texts, copies counting once, be exp(``least_lean``) times as frequent among
    toxic texts as among clean ones, and lean so more than by chance: its likelihood ratio (G) is ``significance`` or more.
    """
    sample = materialize(without_copies(sample), "distinct-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in slices(batches, "text"):
            y = batch.column(2).to_numpy()
            hashes, rows, _ = token_features(data, at)
            for kind, (h, row) in enumerate(zip(hashes, rows, strict=True)):
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                once = np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])))[: len(h)]
                h, label = h[once], y[row[once]]
                names, group = np.unique(h, return_inverse=True)
                ones = np.bincount(group, label, minlength=len(names)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(np.full(len(names), kind, np.int32)), pa.array(ones), pa.array(np.bincount(group, minlength=len(names)) - ones)], ["h", "kind", "n1", "n0"])

    totals = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    bad, good = totals.get(1, 0) + 1.0, totals.get(0, 0) + 1.0
    lean = F.log((F.col("n1") + 0.2) / F.lit(bad)) - F.log((F.col("n0") + 0.2) / F.lit(good))
    both = F.col("n1") + F.col("n0")
    part = lambda c, share: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (both * F.lit(share)))).otherwise(0.0)
    chance = 2 * (part("n1", bad / (bad + good)) + part("n0", good / (bad + good)))
    found = (
        sample.select("doc_id", "text", "y")
        .mapInArrow(run, "h long, kind int, n1 long, n0 long")
        .groupBy("h", "kind")
        .agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
        .where((F.col("n1") >= least) & (lean > least_lean) & (chance >= significance))
        .orderBy((lean * F.sqrt("n1")).desc(), "h", "kind")
        .limit(size)
        .toArrow()
    )
    h, kind = found["h"].to_numpy().view(np.uint64), found["kind"].to_numpy().astype(np.int64)
    leans = np.log((found["n1"].to_numpy() + 0.2) / bad) - np.log((found["n0"].to_numpy() + 0.2) / good)
    level = np.zeros(len(h), np.int64)
    for x in range(KINDS):
        mine_ = np.flatnonzero(kind == x)
        mine_ = mine_[np.argsort(-leans[mine_], kind="stable")]
        level[mine_] = np.arange(len(mine_)) * STRATA // max(len(mine_), 1)
    voter = len(SEEDS) + kind * STRATA + level
    hashes, voters = [h], [voter]
    for i, words in enumerate(SEEDS.values()):
        seeds = word_hash_set(words)
        seeds = seeds[~np.isin(seeds, np.concatenate(hashes))]
        hashes.append(seeds)
        voters.append(np.full(len(seeds), i))
    return Lexicon(np.concatenate(hashes), np.concatenate(voters))


def observe(docs: DataFrame, lexicon: Lexicon, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """(doc_id, hits, measures, votes) of every document: distinct lexicon entries, measures, and a digit for each voter (0 nothing, 1 clean, 2 toxic)."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    seeds, address, are, commands = (word_hash_set(w) for w in ([x for v in SEEDS.values() for x in v], ADDRESS, ARE, COMMANDS))
    upper, mask = np.zeros(256, bool), np.zeros(256, bool)
    upper[65:91] = True
    mask[list(b"*@$#")] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for batch, data, at in slices(batches, "text"):
            n = batch.num_rows
            hashes, rows, words = token_features(data, at)
            hit_row, hit = [], []
            for h, row in zip(hashes, rows, strict=True):
                place, entry = lex.find(h)
                hit_row.append(row[place])
                hit.append(entry)
            pair = np.unique(np.concatenate(hit_row) * np.int64(1 << 32) + np.concatenate(hit))
            row, entry = pair >> 32, pair & 0xFFFFFFFF
            count = lambda mask_rows: np.bincount(mask_rows, minlength=n)
            in_row = lambda places: np.bincount(np.searchsorted(at, places, "right") - 1, minlength=n)[:n]
            by_voter = np.bincount(row * len(LEXICONS) + lex.voter[entry], minlength=n * len(LEXICONS)).reshape(n, len(LEXICONS))
            whole, where_ = hashes[0], rows[0]
            is_seed = np.isin(whole, seeds)
            any_bad = is_seed.copy()
            any_bad[lex.find(whole)[0]] = True
            near = np.zeros(len(whole), bool)
            is_address = np.isin(whole, address)
            said = np.flatnonzero(is_address)
            for d in range(1, 6):
                ok = said[said + d < len(whole)]
                near[ok] |= any_bad[ok + d] & (where_[ok] == where_[ok + d])
            verbs = np.isin(whole[1:], are) & is_address[:-1] & (where_[1:] == where_[:-1])
            size = np.maximum(np.diff(at), 1)
            up = np.concatenate(([0], np.cumsum(upper[data])))
            shout = (up[at[1:]] - up[at[:-1]]) / size
            bang = np.concatenate(([0], np.cumsum(data == 33)))
            bangs = bang[at[1:]] - bang[at[:-1]]
            exclaim = bangs / np.maximum(words, 1)
            begins = np.zeros(len(data) + 1, bool)
            begins[at] = True
            masked = np.flatnonzero(mask[data[1:-1]] & ASCII_LETTER[data[:-2]] & (ASCII_LETTER[data[2:]] | mask[data[2:]]) & ~(begins[1:-2] | begins[2:-1])) + 1
            alike = (data[1:] == data[:-1]) & ASCII_LETTER[data[1:]] & ~begins[1:-1]
            stretched = np.flatnonzero(alike[2:] & alike[1:-1] & alike[:-2])
            total, seeded = count(row), count(where_[is_seed]) > 0
            votes = np.zeros((n, len(VOTERS)), np.int64)
            votes[:, : len(LEXICONS)] = 2 * (by_voter > 0)
            suspicious = [count(where_[near]) > 0, (shout > 0.5) & (words >= 5), (bangs >= 2) & (exclaim >= 0.1), in_row(masked) > 0, in_row(stretched) > 0, count(where_[:-1][verbs]) > 0, count(where_[np.isin(whole, commands)]) > 0, total > 0.02 * np.maximum(words, 1)]
            for v, yes in enumerate(suspicious, len(LEXICONS)):
                votes[:, v] = 2 * yes
            nothing = (total == 0) & ~seeded
            votes[:, -2] = nothing & (words >= 30)
            votes[:, -1] = nothing & ~(suspicious[1] | suspicious[2] | suspicious[3])
            measures = np.stack([np.log1p(words) / 8, np.minimum(total, 5) / 5, shout, np.minimum(exclaim, 1), total / np.maximum(words, 1) * 10], axis=1).astype(np.float32)
            places = np.concatenate(([0], np.cumsum(total))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(places), pa.array(entry.astype(np.int32))), pa.FixedSizeListArray.from_arrays(pa.array(measures.ravel()), MEASURES).cast(pa.list_(pa.float32())), pa.array(votes @ (3 ** np.arange(len(VOTERS))))], ["doc_id", "hits", "measures", "votes"])

    return docs.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, hits array<int>, measures array<float>, votes long")


class LabelModel:
    """P(votes | class) as a tree over voters, and the classes' prior.

    ``given[c, v, x, y]`` is the probability that voter v says y where its parent says x; a root's rows are all alike.
    """

    def __init__(self, prior: float, parent: np.ndarray, given: np.ndarray):
        self.prior, self.parent, self.given = prior, parent, given

    def likelihood(self, votes: np.ndarray) -> np.ndarray:
        """log P(votes | class), a column a class."""
        v = np.arange(votes.shape[1])
        return np.stack([np.log(self.given[c][v, votes[:, self.parent], votes]).sum(axis=1) for c in (0, 1)], axis=1)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic) of patterns of votes (rows of digits)."""
        both = self.likelihood(votes)
        z = np.log(self.prior / (1 - self.prior)) + both[:, 1] - both[:, 0]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def digits(patterns: np.ndarray, voters: int = len(VOTERS)) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(voters) % 3


def pair_tables(votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted counts of what two voters say together: cell (3 v + x, 3 u + y) for each class, of which ``weight`` has a column."""
    said = np.zeros((len(votes), 3 * votes.shape[1]))
    said[np.arange(len(votes))[:, None], 3 * np.arange(votes.shape[1]) + votes] = 1
    return np.stack([(said * weight[:, c, None]).T @ said for c in range(weight.shape[1])])


def model_of(tables: np.ndarray, smoothing: float = 0.5, least_shared: float = 0.005) -> LabelModel:
    """The label model of (soft) pair counts by class: prior, a tree of the largest conditional mutual information, and its tables.

    A voter that shares less than ``least_shared`` with every other stands alone.
    """
    voters = tables.shape[1] // 3
    cells = tables.reshape(2, voters, 3, voters, 3)
    total = np.array([np.trace(cells[c, 0, :, 0, :]) for c in (0, 1)])
    single = np.stack([np.stack([np.diag(cells[c, v, :, v, :]) for v in range(voters)]) for c in (0, 1)]) + smoothing
    single /= single.sum(axis=2, keepdims=True)
    shared = np.zeros((voters, voters))
    for c in (0, 1):
        joint = cells[c].transpose(0, 2, 1, 3) + smoothing / 3
        joint = joint / joint.sum(axis=(2, 3), keepdims=True)
        alone = joint.sum(axis=3, keepdims=True) * joint.sum(axis=2, keepdims=True)
        shared += total[c] / max(total.sum(), 1e-9) * (joint * np.log(joint / alone)).sum(axis=(2, 3))
    np.fill_diagonal(shared, -1)
    parent, inside = np.arange(voters), [0]
    while len(inside) < voters:
        rest = [v for v in range(voters) if v not in inside]
        gain = shared[np.ix_(inside, rest)]
        i, j = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[i, j] >= least_shared:
            parent[rest[j]] = inside[i]
        inside.append(rest[j])
    given = np.empty((2, voters, 3, 3))
    for v in range(voters):
        for c in (0, 1):
            if parent[v] == v:
                given[c, v] = single[c, v]
            else:
                table = cells[c, parent[v], :, v, :] + 3 * smoothing * single[c, v]
                given[c, v] = table / table.sum(axis=1, keepdims=True)
    return LabelModel(float(np.clip((total[1] + 1) / (total.sum() + 10), 0.005, 0.5)), parent, given)


def fit_label_model(patterns: DataFrame, steps: int = 8, tolerance: float = 1e-3) -> LabelModel:
    """EM over a written table of vote patterns (votes, n, y0, y1): documents, and labelled ones of either class.

    It begins from the labelled documents (from patterns with toxic or clean votes if either class has none), which keep
    counting, as much together as all documents together.
    """
    totals = patterns.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "y0", "y1")]).first()
    labelled = totals["y0"] > 0 and totals["y1"] > 0
    strength = max(1.0, totals["n"] / max(totals["y0"] + totals["y1"], 1))

    def tables(model: LabelModel | None) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((2, CELLS, CELLS))
            for whole in batches:
                for at in range(0, whole.num_rows, 8192):
                    batch = whole.slice(at, 8192)
                    votes, n, y0, y1 = (batch.column(c).to_numpy().astype(t) for c, t in (("votes", np.int64), ("n", float), ("y0", float), ("y1", float)))
                    votes = digits(votes)
                    known = np.stack((y0, y1), axis=1) if labelled else np.stack((n * ((votes == 1).any(axis=1) & ~(votes == 2).any(axis=1)), n * (votes == 2).any(axis=1)), axis=1)
                    if model is not None:
                        p = model.posterior(votes)
                        known = (known * strength if labelled else 0) + np.stack((n * (1 - p), n * p), axis=1)
                    out += pair_tables(votes, known)
            flat = out.ravel()
            some = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[some])], ["cell", "n"])

        cells = patterns.mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most 2 * CELLS ** 2 rows
        out = np.zeros(2 * CELLS * CELLS)
        out[cells["cell"].to_numpy()] = cells["n"].to_numpy()
        return out.reshape(2, CELLS, CELLS)

    # without labels the classes must settle before what is left between voters can be told from them
    model = model_of(tables(None), least_shared=0.005 if labelled else math.inf)
    for step in range(steps):
        new = model_of(tables(model), least_shared=0.005 if labelled or step >= steps // 2 else math.inf)
        moved = abs(new.prior - model.prior) / model.prior
        model = new
        if moved < tolerance and (labelled or step > steps // 2):
            break
    return model


class Classifier:
    def __init__(self, weights: np.ndarray, entries: int):
        self.weights, self.entries = weights, entries

    def score(self, hits: pa.ListArray, measures: np.ndarray) -> np.ndarray:
        places = np.asarray(hits.offsets)
        flat = hits.values.to_numpy()[places[0] : places[-1]]
        sums = np.concatenate(([0.0], np.cumsum(self.weights[flat])))
        z = sums[places[1:] - places[0]] - sums[places[:-1] - places[0]] + measures @ self.weights[self.entries : -1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train_classifier(hits: pa.ListArray, measures: np.ndarray, target: np.ndarray, entries: int, steps: int = 300, rate: float = 0.1, ridge: float = 2e-5) -> Classifier:
    """Logistic regression on soft labels by Adam."""
    places = np.asarray(hits.offsets) - np.asarray(hits.offsets)[0]
    flat = hits.flatten().to_numpy()
    row = np.repeat(np.arange(len(target)), np.diff(places))
    model = Classifier(np.zeros(entries + MEASURES + 1), entries)
    mean, spread = np.zeros_like(model.weights), np.zeros_like(model.weights)
    even = np.where(target > 0.5, 0.5 / max((target > 0.5).mean(), 0.05), 0.5 / max((target <= 0.5).mean(), 0.05))
    offsets_hits = pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(flat))
    for t in range(1, steps + 1):
        gap = even * (target - model.score(offsets_hits, measures)) / max(len(target), 1)
        g = np.concatenate((np.bincount(flat, gap[row], minlength=entries), measures.T @ gap, [gap.sum()])) - ridge * model.weights
        mean, spread = 0.9 * mean + 0.1 * g, 0.99 * spread + 0.01 * g * g
        model.weights += rate * (mean / (1 - 0.9**t)) / (np.sqrt(spread / (1 - 0.99**t)) + 1e-9)
    return model


def _measures(column: pa.Array) -> np.ndarray:
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False).reshape(-1, MEASURES).astype(float)


def score(docs: DataFrame, sample: DataFrame, train_rows: int = TRAIN_ROWS, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """(doc_id, score, posterior): the classifier's and the label model's probability that a text is toxic.

    ``sample``: (doc_id, text, y), a bounded sample that may be learned from.
    """
    lexicon = mine(sample)
    seen = materialize(observe(docs, lexicon, text, row_id), "observed")
    known = materialize(observe(sample, lexicon).join(F.broadcast(sample.select(F.col("doc_id"), "y").dropDuplicates(["doc_id"])), "doc_id"), "observed-labelled")
    if seen.isEmpty():
        return seen.select("doc_id", F.lit(0.0).alias("score"), F.lit(0.0).alias("posterior"))
    counted = seen.groupBy("votes").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("y0"), F.lit(0).cast("long").alias("y1"))
    of_label = known.groupBy("votes").agg(F.lit(0).cast("long").alias("n"), F.count_if(F.col("y") == 0).alias("y0"), F.count_if(F.col("y") == 1).alias("y1"))
    patterns = counted.unionByName(of_label).groupBy("votes").agg(*[F.sum(c).alias(c) for c in ("n", "y0", "y1")])
    label_model = fit_label_model(materialize(patterns, "vote-patterns"))
    rows = seen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).select("hits", "measures", "votes").toArrow()
    more = known.select("hits", "measures", "votes", "y").toArrow()
    labels = more["y"].to_numpy().astype(float)
    rows = pa.concat_tables([rows, more.drop_columns(["y"])]).combine_chunks()
    hits = rows["hits"].combine_chunks() if isinstance(rows["hits"], pa.ChunkedArray) else rows["hits"]
    target = label_model.posterior(digits(rows["votes"].to_numpy()))
    target[len(target) - len(labels) :] = labels  # a document whose label is known has no other posterior
    model = train_classifier(hits, _measures(rows["measures"]), target, len(lexicon.hashes))
    shared = docs.sparkSession.sparkContext.broadcast((model, label_model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier, labels = shared.value
        for batch in batches:
            votes = digits(batch.column("votes").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(classifier.score(batch.column("hits"), _measures(batch.column("measures")))), pa.array(labels.posterior(votes))], ["doc_id", "score", "posterior"])

    return seen.mapInArrow(run, "doc_id long, score double, posterior double")
