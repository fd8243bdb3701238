"""Training-data operators against brute force, exact round trips and edge cases."""

import hashlib
import itertools
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from meterlark.llm import ann_curves, components, language_id, mixing, packing, quality_crf, simhash, substring_dedup, topk_search, toxicity, url_filter
from meterlark.llm.labelled import labelled_sample
from meterlark.llm.queries import tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "a", "a  b\n", "Élan vital ñ 漢字 😀", "x " * 3000, "one two", "one two", "!!! ???"]


def sentences(n, words, seed=0):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(200)}" for _ in range(words)) for _ in range(n)]


def frame(spark, texts, ids=None, langs=None, sources=None):
    ids = ids or list(range(len(texts)))
    rows = [(i, t, (langs or ["en"])[k % len(langs or ["en"])], (sources or ["s0", "s1", None])[k % len(sources or ["s0", "s1", None])], None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """Extra columns with names that the operators use too."""
    return df.withColumns({"rank": F.lit("r"), "score": F.lit("s"), "h": F.lit(1), "key": F.lit("k"), "length": F.lit(None).cast("string"), "fp": F.lit(2.5)})


# 1


def brute_bm25(docs, queries, k=10, k1=1.2, b=0.75):
    import re

    tokens = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    bags = [(i, Counter(tokens(t))) for i, t in docs if i is not None]
    n, mean = len(bags), sum(sum(c.values()) for _, c in bags) / max(len(bags), 1)
    df = Counter(w for _, c in bags for w in c)
    out = {}
    for q, t in queries:
        scores = []
        for i, c in bags:
            hit = [w for w in set(tokens(t)) if c[w]]
            if hit:
                scores.append((-round(sum(np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * sum(c.values()) / mean)) for w in hit), 6), i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def test_topk_search(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD_BYTES", 2000)
    texts = sentences(300, 12) + ["W1 w2, w3!", "w1 w2 w3", "w1 w2 w3", *ODD]
    ids = [*range(len(texts) - 1), None]
    queries = [(1, "w1 w2 w3"), (2, "W5 w5 w6 zzz"), (3, None), (4, "!!"), (5, texts[7])]
    got = defaultdict(list)
    for r in sorted(topk_search.search(clashing(frame(spark, texts, ids)), queries).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    want = {q: v for q, v in brute_bm25(list(zip(ids, texts, strict=True)), queries).items() if v}
    assert got == want


def test_topk_search_empty(spark):
    empty = spark.createDataFrame([], DOCS)
    assert topk_search.search(empty, [(1, "a")]).count() == 0
    assert topk_search.search(frame(spark, ["a"]), []).count() == 0


def test_topk_search_table(spark, monkeypatch):
    for name, value in (("SHARD_BYTES", 2000), ("QUERY_ROWS", 50), ("FOUND_ROWS", 100)):
        monkeypatch.setattr(topk_search, name, value)
    texts = sentences(300, 12) + ["W1 w2, w3!", "w1 w2 w3", "w1 w2 w3", *ODD, "w7 other row", "w8 w9"]
    ids = [*range(len(texts) - 3), None, 5, 5]
    docs = clashing(frame(spark, texts, ids))
    got = defaultdict(list)
    for r in sorted(topk_search.search_table(docs, docs.where(F.col("doc_id") % 20 == 0)).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    rows = list(zip(ids, texts, strict=True))
    want = {q: v for q, v in brute_bm25(rows, [(i, t) for i, t in rows if i is not None and i % 20 == 0]).items() if v}
    assert len(want) >= 15 and got == want


def test_topk_search_index_is_slim(spark, monkeypatch):
    """A document's id and length stand in its shard once, not with each posting, and a shard that is handed over is not kept."""
    import weakref

    import pyarrow as pa

    monkeypatch.setattr(topk_search, "SHARD_BYTES", 2000)
    index = topk_search.build_index(frame(spark, sentences(100, 12)), None)
    rows = index.collect()
    assert sum(len(r["lengths"] or []) for r in rows) == sum(len(r["ids"] or []) for r in rows) == 100 < sum(len(r["docs"]) for r in rows)
    assert all((r["ids"] is None) == (r["term"] is not None) for r in rows)

    class Batch:  # as much of a batch as is cut here
        def __init__(self, shard):
            self.shard = pa.array([shard])

        def column(self, name):
            return self.shard

        def slice(self, at, size):
            return Batch(self.shard[0].as_py())

    seen = []
    monkeypatch.setattr(topk_search.pa, "Table", type("Table", (), {"from_batches": staticmethod(lambda held: seen.extend(map(weakref.ref, held)) or len(held))}))
    assert [(n, [x() for x in seen if x()]) for n in topk_search.shards_of(iter([Batch(1), Batch(1)]))] == [(2, [])]


def test_topk_search_table_packs_a_shard_in_a_row(spark, monkeypatch):
    """The index is a row a shard, not a row a term of each shard, and groups of alike documents lose nothing."""
    rng, tables = np.random.default_rng(5), {}
    kept = topk_search.materialize
    monkeypatch.setattr(topk_search, "materialize", lambda df, name="table": tables.setdefault(name, kept(df, name)))
    for name, value in (("BATCH_CELLS", 1000), ("RARE_CELLS", 300), ("EXACT_ROWS", 7), ("GROUP_DOCS", 20), ("QUERY_ROWS", 700)):
        monkeypatch.setattr(topk_search, name, value, raising=False)
    tongue = lambda c, n: " ".join(f"{c}{w}" for w in rng.zipf(1.4, n) % 500)
    texts = [tongue("xyz"[i % 3], int(rng.integers(1, 90))) + (" xyz" if i % 7 else "") for i in range(500)]
    texts += [texts[40], texts[40], "x1 " * 300, None, "", *ODD]
    docs = frame(spark, texts).coalesce(1)
    got = defaultdict(list)
    for r in sorted(topk_search.search_table(docs, docs.where(F.col("doc_id") % 20 == 0)).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    rows = list(enumerate(texts))
    want = {q: v for q, v in brute_bm25(rows, [(i, t) for i, t in rows if i % 20 == 0]).items() if v}
    assert len(want) >= 25 and got == want
    assert tables["index"].count() == 1


def test_topk_search_table_takes_equal_texts_once(spark, monkeypatch):
    """Copies of a text are one document of the index and one query, and each of them is found and answered."""
    tables = {}
    kept = topk_search.materialize
    monkeypatch.setattr(topk_search, "materialize", lambda df, name="table": tables.setdefault(name, kept(df, name)))
    texts = sentences(40, 12) * 14 + [None, "", "w1 w2"]
    ids = [*range(len(texts) - 1), 25]  # an id of two texts
    docs = frame(spark, texts, ids).union(frame(spark, texts[40:45], ids[40:45]))  # and rows that are repeated
    got = defaultdict(list)
    for r in sorted(topk_search.search_table(docs, docs.where(F.col("doc_id") % 20 == 0), k=20).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    rows = list(zip(ids, texts, strict=True)) + list(zip(ids[40:45], texts[40:45], strict=True))
    want = {q: v for q, v in brute_bm25(rows, [(i, t) for i, t in rows if i % 20 == 0], k=20).items() if v}
    assert len(want) == 28 and got == want
    assert sum(len(r["lengths"]) for r in tables["index"].collect()) == 40 + 2  # a byte each
    assert tables["asked"].select("query_id").distinct().count() == 2


def test_topk_search_table_without_terms(spark):
    for docs in (spark.createDataFrame([], DOCS), frame(spark, [None, "", "!!"])):
        assert topk_search.search_table(docs, docs).count() == 0


def test_topk_search_asks_every_twentieth_document(spark, tmp_path):
    from meterlark.llm.queries import op1_topk_search

    frame(spark, sentences(100, 12)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(20, "w1")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r["query_id"] for r in op1_topk_search(spark, str(tmp_path)).collect()} == {0, 20, 40, 60, 80}


# 2


def test_language_id(spark):
    words = {"aa": "banana kabala nadala", "bb": "strkly prstn vrtk", "el": "καλα μερα νερο"}
    train = [(" ".join(random.Random(i).choices(v.split(), k=12)), k) for i in range(30) for k, v in words.items()]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(train)] + [(900, None, "aa"), (901, "x", None)], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert model.languages == ["aa", "bb", "el"]
    mixed = "banana kabala nadala " * 8 + "strkly prstn vrtk " * 8
    asked = frame(spark, ["banana nadala", "vrtk prstn", "νερο", mixed, *ODD])
    got = {r["doc_id"]: r for r in language_id.identify(clashing(asked), model).collect()}
    assert [got[i]["lang_pred"] for i in range(3)] == ["aa", "bb", "el"]
    assert [s["lang"] for s in got[3]["spans"]] == ["aa", "bb"] and (got[3]["spans"][0]["first"], got[3]["spans"][1]["last"]) == (0, 47)
    assert [got[4 + i]["lang_pred"] for i in (0, 1, 2, 9)] == ["und"] * 4 and got[4]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == 4 + len(ODD)


def test_language_id_untrained(spark):
    model = language_id.train(spark.createDataFrame([], DOCS))
    assert [r["lang_pred"] for r in language_id.identify(frame(spark, ["abc", None]), model).collect()] == ["und", "und"]


def test_many_languages(spark):
    """Over 127 languages are told apart, in documents and in spans."""
    rng = random.Random(8)
    words = {f"l{i:03d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(6)] for i in range(200)}
    texts = [(" ".join(rng.choices(v, k=20)), k) for k, v in words.items() for _ in range(2)]
    model = language_id.train(spark.createDataFrame(texts, "text string, lang string"))
    asked = [" ".join(rng.choices(v, k=10)) for v in words.values()] + [" ".join(words["l010"] * 3 + words["l190"] * 3)]
    got = {r["doc_id"]: r for r in language_id.identify(frame(spark, asked), model).collect()}
    assert [got[i]["lang_pred"] for i in range(200)] == list(words)
    assert [s["lang"] for s in got[200]["spans"]] == ["l010", "l190"]


def test_letters_of_all_planes():
    for c in [*range(0x80, 0xD800, 7), *range(0xE000, 0x110000, 11), 0x10107, 0x1E900, 0x1EE00, 0x20000, 0xB2, 0xAA]:
        raw = np.frombuffer(chr(c).encode(), np.uint8)
        assert (language_id.scripts_of_bytes(raw)[0] > 0) == unicodedata.category(chr(c)).startswith("L"), hex(c)


def test_words_scored_by_hand(spark):
    """Brute force: counts of trigrams and words, smoothed, summed for the text of one word."""
    train = [("aba abb", "x"), ("bcb aba", "y")]
    model = language_id.train(spark.createDataFrame(train, "text string, lang string"))
    got = language_id.identify(frame(spark, ["aba"]), model).first()
    logs = []
    for text, _ in train:
        grams, words = Counter(), Counter(text.split())
        for w in text.split():
            p = f" {w} "
            grams.update(p[i : i + 3] for i in range(len(w)))
        of = lambda c, k, n: np.log((c[k] + 0.5) / (sum(c.values()) + 0.5 * n))
        logs.append(sum(of(grams, g, language_id.GRAMS) for g in (" ab", "aba", "ba ")) + of(words, "aba", language_id.WORDS))
    want = 1 / (1 + np.exp(min(logs) - max(logs)))
    assert got["lang_pred"] == "xy"[int(logs[1] > logs[0])] and got["score"] == pytest.approx(want, rel=1e-4)


def test_viterbi_is_optimal():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 7):
        scores = rng.normal(size=(n, 3)).astype(np.float32)
        best = max(np.ndindex(*[3] * n), key=lambda p: sum(scores[i, s] for i, s in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:], strict=False)))
        assert tuple(language_id.viterbi(scores, np.array([0]), np.array([n]), 0.7)) == best


# 3


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    emit, link = rng.normal(size=5), rng.normal(size=(2, 2))
    weight = {}
    for path in np.ndindex(2, 2, 2, 2, 2):
        weight[path] = np.exp(sum(emit[i] for i, s in enumerate(path) if s) + sum(link[a, b] for a, b in zip(path, path[1:], strict=False)))
    total = sum(weight.values())
    good, pairs, logz = quality_crf.marginals(emit, np.array([0]), np.array([5]), link)
    assert np.allclose(good, [sum(w for p, w in weight.items() if p[i]) / total for i in range(5)]) and np.isclose(logz, np.log(total))
    assert np.allclose(pairs, [[sum(w for p, w in weight.items() for i in range(4) if (p[i], p[i + 1]) == (a, b)) / total for b in (0, 1)] for a in (0, 1)])


def test_line_labels_against_enumeration(spark):
    """P(good) of each line of a text, and the document's share, from all labellings of its lines."""
    rng = np.random.default_rng(8)
    model = quality_crf.Model(rng.normal(size=quality_crf.WIDTH), rng.normal(size=(2, 2)), np.array([0.1, 2.0, 0.5]), 0.5)
    text = "A fine line of words.\n\nBUY NOW!!! $$$\nanother line, with more words\n|x|y|\nlast"
    got = quality_crf.score(frame(spark, [text]), model).first()
    raw = np.frombuffer(text.encode(), np.uint8)
    _, size, x = quality_crf.lines_of(raw, np.array([0, len(raw)]))
    emit = x @ model.weights
    weight = {p: np.exp(sum(emit[i] for i, s in enumerate(p) if s) + sum(model.link[a, b] for a, b in zip(p, p[1:], strict=False))) for p in np.ndindex(*[2] * len(size))}
    good = np.array([sum(w for p, w in weight.items() if p[i]) for i in range(len(size))]) / sum(weight.values())
    share = (good * size).sum() / size.sum()
    assert len(size) == 5 and np.allclose(got["lines"], good) and got["good_share"] == pytest.approx(share)
    assert got["score"] == pytest.approx(1 / (1 + np.exp(-(0.1 + 2 * share + 0.5 * np.log(share / (1 - share)) / 4))))


def test_long_chains_are_learned_whole(spark):
    """A document of hundreds of lines is one chain, in fitting as in scoring."""
    assert [x.tolist() for x in quality_crf.chains_of(np.array([0] * 300 + [2] * 5))] == [[0, 300], [300, 5]]


def test_quality(spark):
    good, bad = sentences(60, 40), ["BUY!! NOW!! " * 10 + "\n### | ### | $$$"] * 20 + ["same same same same " * 10] * 20
    docs = frame(spark, good + bad + ODD)
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(100)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_crf.fit(labelled_sample(docs, labels, "quality", F.lit(True), 100))
    got = {r["doc_id"]: r for r in quality_crf.score(clashing(docs), model).collect()}
    assert np.mean([(got[i]["score"] >= 0.5) == (i < 60) for i in range(100)]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == 100 + len(ODD)
    assert quality_crf.score(docs, None).agg(F.min("score")).first()[0] == 0.5
    assert quality_crf.fit(labelled_sample(docs, labels.limit(0), "quality", F.lit(True), 100)) is None


# 4


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(4, 12))[rng.integers(0, 4, 600)] + rng.normal(size=(600, 12)) * 0.3, np.tile(rng.normal(size=12), (50, 1))]).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 12), (1002, [float("nan")] * 12), (None, rows[0][1]), (1003, [1.0]), (1004, []), (1005, [None] * 12), rows[3]]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns({"rank": F.lit(1), "score": F.lit("x")})
    got = defaultdict(list)
    for r in sorted(ann_curves.neighbours(df, F.col("vec_id") % 10 == 0).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    d = x.astype(float)
    recall = []
    for q in range(0, 650, 10):
        dist = np.sqrt(((d - d[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(650), dist)) if i != q][:10]
        recall.append(len({i for i, _ in got[q]} & set(want)) / 10)
        assert all(abs(dist[i] - s) < 1e-12 for i, s in got[q]) and [s for _, s in got[q]] == sorted(s for _, s in got[q])
        if q >= 600:
            assert [i for i, _ in got[q]] == want
    assert len(got) == 65 and np.mean(recall) >= 0.9
    assert ann_curves.neighbours(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


@pytest.mark.parametrize("kind", ["offset", "clustered", "lattice"])
def test_nearest_neighbours_far_from_the_origin(spark, kind):
    """Recall on vectors far from the origin and in clusters; all of many equal distances go by id."""
    rng = np.random.default_rng(2)
    if kind == "lattice":
        x = rng.integers(0, 3, (500, 6)).astype(float)
    else:
        x = rng.normal(size=(8 if kind == "clustered" else 600, 12))[rng.integers(0, 8, 600) if kind == "clustered" else slice(None)] + rng.normal(size=(600, 12)) * 0.2 + (3e8 if kind == "offset" else 50)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").where("vec_id > 0 or size(embedding) > 0")
    got = defaultdict(list)
    for r in sorted(ann_curves.neighbours(df, F.col("vec_id") % 10 == 0).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    ids = [i for i in range(len(x)) if x[i].any()]
    recall = []
    for q in (i for i in ids if i % 10 == 0):
        dist = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = sorted((i for i in ids if i != q), key=lambda i: (dist[i], i))[:10]
        recall.append(len({i for i, _ in got[q]} & set(want)) / 10)
        assert [s for _, s in got[q]] == [dist[i] for i, _ in got[q]] and [(s, i) for i, s in got[q]] == sorted((s, i) for i, s in got[q])
    assert np.mean(recall) >= 0.9


def test_nearest_takes_all_ties():
    asked, some = np.zeros((1, 3)), np.tile(np.eye(3), (40, 1))
    best, ids = ann_curves.nearest(asked, some, np.arange(120)[::-1].copy(), np.full((1, 5), np.inf), np.zeros((1, 5), np.int64), np.full(3, 7.0))
    assert best.tolist() == [[1.0] * 5] and ids.tolist() == [[0, 1, 2, 3, 4]]


def test_hilbert_steps_are_one():
    cells = np.array(list(np.ndindex(8, 8)))
    keys = ann_curves.hilbert_keys(cells, 3)
    path = cells[np.argsort(keys)]
    assert sorted(keys.tolist()) == list(range(64)) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


# 5


def test_mixing(spark):
    rng = random.Random(1)
    texts = [" ".join(["w"] * rng.randrange(0, 40)) for _ in range(900)] + [None, ""]
    docs = frame(spark, texts, sources=["b", "b", "b", "b", "b", "a", None, "ä"])
    rows = mixing.mix_sources(clashing(docs)).collect()
    assert len(rows) == len(texts) and {r["mx_copies"] for r in rows} <= {0, 1, 2, 3}
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    sizes = {s: sum(r["mx_size"] for r in v) for s, v in by.items()}
    assert all(v[0]["mx_total"] == sizes[s] for s, v in by.items())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, total, want = set(order), sum(sizes.values()), {}
    while True:
        share = {s: (total - sum(want.values())) * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * sizes[s]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3 * sizes[s]
            left.discard(s)
    for s, v in by.items():
        assert v[0]["mx_target"] == pytest.approx(want[s])
        assert abs(sum(r["mx_copies"] * r["mx_size"] for r in v) - want[s]) <= 40
    again = {(r["doc_id"], r["mx_copies"]) for r in mixing.mix_sources(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["mx_copies"]) for r in rows}
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.mixed_documents(docs).count() == sum(r["mx_copies"] for r in rows)


def test_dual_against_bisection(spark):
    """The multipliers of the dual, solved for each source alone."""
    rng = random.Random(9)
    rows = [(k, n, rng.randrange(1, 50)) for k in ("0a", "0b", "0c") for n in sorted(rng.sample(range(1, 400), 40))]
    total = {k: sum(n * c for s, n, c in rows if s == k) for k in ("0a", "0b", "0c")}
    target = {"0a": 0.4 * total["0a"], "0b": 2.2 * total["0b"], "0c": 1.0 * total["0c"]}
    counts = spark.createDataFrame(rows, "mx_key string, mx_size long, mx_n long")
    goals = spark.createDataFrame([(k, total[k], min(n for s, n, _ in rows if s == k), 3.0 * total[k], target[k]) for k in total], "mx_key string, mx_total long, mx_least long, mx_cap double, mx_target double")
    got = {r["mx_key"]: r["mx_lambda"] for r in mixing.balance(counts, goals, 3).collect()}
    for k in total:
        words = lambda x: sum(c * n * min(3.0, np.exp(x * n)) for s, n, c in rows if s == k)  # noqa: B023, E731
        lo, hi = -5.0, 5.0
        for _ in range(200):
            lo, hi = ((lo + hi) / 2, hi) if words((lo + hi) / 2) < target[k] else (lo, (lo + hi) / 2)
        assert words(got[k]) == pytest.approx(target[k], rel=1e-6) and got[k] == pytest.approx(lo, abs=1e-6)


def test_mixing_all_empty(spark):
    assert {(r["mx_target"], r["mx_size"]) for r in mixing.mix_sources(frame(spark, [None, "", " "])).collect()} == {(0.0, 0)}


# 6


def simhash_of(text, words_each=3):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + words_each]), 42) for i in range(max(1, len(w) - words_each + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("limit", [2048, 5])
def test_simhash(spark, limit):
    base = sentences(12, 60, seed=4)
    rng = random.Random(5)
    texts = list(base)
    for t in base[:8]:
        for _ in range(12):
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += [base[0], base[0].upper(), *ODD]
    prints = [simhash_of(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    got = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.near_duplicates(clashing(frame(spark, texts)), group_limit=limit).withColumn("fp", simhash.hex_of("fp")).collect()}
    assert got == {i: (f"{p:016x}", find(i)) for i, p in enumerate(prints)}


def test_simhash_odd_rows(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    rows = simhash.near_duplicates(frame(spark, ["a b c", "a b c", "q r s t"], [None, 3, None])).collect()
    assert sorted((r["doc_id"] is None, r["component_id"]) for r in rows if r["component_id"] is not None) == [(False, 3), (True, 3)]
    kept = simhash.without_near_duplicates(clashing(frame(spark, ["a b c", "a b c", "q r s t", "z y x w", "q r s t"], [None, 3, None, 3, 9]))).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(3, "a b c"), (3, "z y x w"), (9, "q r s t")]
    assert simhash.without_near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [128, 2])
def test_similar_texts(spark, monkeypatch, limit):
    """Brute force: components of pairs whose 128 bits are as near as those of texts 0.8 alike; links found beyond the first 64 bits' distance are links too."""
    monkeypatch.setattr(simhash, "SMALL_GROUP", limit)
    rng, texts = random.Random(12), []
    for t in sentences(6, 90, seed=21):
        texts.append(t)
        for edits in (1, 1, 1, 2, 2, 3, 4, 6):
            w = t.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"v{rng.randrange(1000)}"
            texts.append(" ".join(w))
    texts += [texts[0].upper(), *ODD]
    words = [(t or "").encode().lower().split() for t in texts]
    sets = [{b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    prints = []
    for w in words:
        h = [xxhash.xxh3_128_intdigest(b" ".join(w[i : i + 5]), 42) for i in range(max(1, len(w) - 4))] if w else []
        prints.append(sum(1 << b for b in range(128) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0)

    def kept_of(linked):
        parent = list(range(len(texts)))

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i in range(len(texts)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 19 and linked(prints[i] ^ prints[j]):
                    parent[max(find(i), find(j))] = min(find(i), find(j))
        return {find(i) for i in range(len(texts))}

    kept = {r["doc_id"] for r in simhash.without_near_duplicates(frame(spark, texts)).collect()}
    assert kept_of(lambda x: True) <= kept <= kept_of(lambda x: (x >> 64).bit_count() <= 11)
    gone = sorted(set(range(len(texts))) - kept)
    alike = [max(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] | sets[j] else 1.0 for j in range(len(texts)) if j != i) for i in gone]
    assert len(gone) > 20 and min(alike) > 0.6 and np.median(alike) > 0.8
    assert simhash.bits_apart(0.8, 128) == 19 and simhash.bits_apart(1.0, 64) == 0


def test_dense_groups_are_linked_exactly():
    """A dense group, its fringe and strangers: the same components as all pairs give."""
    rng = np.random.default_rng(5)
    fp, more = [], []
    for centre in rng.integers(0, 1 << 63, (6, 2), dtype=np.uint64).tolist():
        for _ in range(rng.integers(1, 120)):
            x = list(centre)
            for bit in rng.choice(128, rng.integers(0, 16), replace=False).tolist():
                x[bit // 64] ^= 1 << bit % 64
            fp.append(x[0])
            more.append(x[1])
    fp, more = np.array(fp, np.uint64), np.array(more, np.uint64)
    links = simhash.Links()
    simhash.star_links(fp, more, 11, links)
    a, b, rank = links.cut()
    at = {int(x): i for i, x in enumerate(simhash.node_of(fp, more))}

    def roots(pairs):
        parent = list(range(len(fp)))

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, j in pairs:
            parent[max(find(i), find(j))] = min(find(i), find(j))
        return [find(at[int(x)]) for x in simhash.node_of(fp, more)]

    near = np.argwhere(np.bitwise_count(fp[:, None] ^ fp[None]).astype(int) + np.bitwise_count(more[:, None] ^ more[None]) <= 11)
    assert roots([(at[int(x)], at[int(y)]) for x, y in zip(a, b, strict=True)]) == roots([(at[int(simhash.node_of(fp, more)[i])], at[int(simhash.node_of(fp, more)[j])]) for i, j in near.tolist()])
    assert rank.max() <= 11


def test_allocation_is_least():
    rng = np.random.default_rng(2)
    for widths in [(16, 16, 16, 16), (20, 20, 24), (12, 13, 13, 13, 13)]:
        pairs, n, distance = rng.integers(0, 1000, len(widths)).astype(float).tolist(), 500.0, 7
        cost = lambda t, w, p: 0.0 if t < 0 else p + (simhash.ball(w, t) - 1) * n * n / 2 / 2**w + simhash.PROBE_COST * n * simhash.ball(w, (t + 1) // 2)
        allowed = [[t for t in range(-1, distance + 1) if t < 0 or simhash.ball(w, (t + 1) // 2) <= simhash.MOST_VALUES] for w in widths]
        want = min(sum(map(cost, ts, widths, pairs)) for ts in itertools.product(*allowed) if sum(ts) == distance - len(widths) + 1)
        got, chosen = simhash.allocate(list(widths), pairs, n, distance)
        assert got == pytest.approx(want) and sum(chosen) == distance - len(widths) + 1


def test_unequal_thresholds_win():
    """A hundred million fingerprints: two blocks, of which one is probed to two bits, cost less than any equal thresholds."""
    n = 1e8
    costs = {widths: simhash.allocate(list(widths), [n * n / 2 / 2**w for w in widths], n, 3) for widths in simhash.LAYOUTS}
    best = min(costs.values())
    halves = sum(n * n / 2 / 2**32 * simhash.ball(32, 1) + simhash.PROBE_COST * n * simhash.ball(32, 1) for _ in range(2))  # 1 and 1
    assert best[1] == [0, 2] and best[0] < min(costs[16, 16, 16, 16][0], halves) / 1.5
    few = {widths: simhash.allocate(list(widths), [1e10 / 2 / 2**w for w in widths], 1e5, 3) for widths in simhash.LAYOUTS}
    assert min(few.values())[1] == [0, 0, 0, 0]


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(5, 5)]
    got = {r["v"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {v: v for e in edges for v in e}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        parent[find(a)] = find(b)
    groups, theirs = defaultdict(set), defaultdict(set)
    for v in got:
        groups[got[v]].add(v)
        theirs[find(v)].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(x) for x in theirs.values() if len(x) > 1)


# 7


def test_url_filter(spark):
    rng = random.Random(2)
    rules = [(f"h{i}.com", f"/{'p' * (i % 4)}/" if i % 4 else "/", "block" if i % 3 else "allow") for i in range(40)] + [("h1.com", "/p/", "allow"), ("com", "/z", "allow")]
    urls = [f"{rng.choice(['http', 'https'])}://{rng.choice(['', 'www.', 'a.b.'])}H{rng.randrange(60)}.com/{rng.choice(['', 'p/', 'pp/x', 'ppp/y?q=1', 'zebra#f', '?p/'])}" for _ in range(600)] + [None, "", "nohost", "://", "x://h1.com", "http://h1.com?x", "http://h1.com/p/\n/q"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"h1": F.lit(1), "word": F.lit("w")})

    def brute(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = rest
        for c in "/?#":
            host = host.split(c, 1)[0]
        path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        best = max((r for r in rules if host and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])), key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
        if best is None:
            return host, path, None, "allow"
        return host, path, best[0] + best[1], "block" if any(r[:2] == best[:2] and r[2] == "block" for r in rules) else "allow"

    table = spark.createDataFrame(rules, "host string, path string, action string")
    for bound in (64 << 20, 20):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, table, max_filter_bytes=bound).collect()}
        assert got == {i: brute(u) for i, u in enumerate(urls)}
    assert {r["verdict"] for r in url_filter.filter_urls(pages, table.limit(0)).collect()} == {"allow"}
    assert url_filter.filter_urls(pages.limit(0), table).count() == 0


# 8


def brute_repeats(rows, window=50):
    rows = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in rows:
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in rows:
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < d:
                    gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [4000, 3])
def test_substring_dedup(spark, hot):
    rng = random.Random(9)
    shared = sentences(3, 70, seed=7)
    texts = sentences(25, 120, seed=8)
    for i in range(30):
        a, b = rng.choice(sentences(1, 40, seed=100 + i)), rng.choice(sentences(1, 30, seed=200 + i))
        texts.append(f"{a}\n{rng.choice(shared)} {b}")
    texts += [texts[0], texts[0], texts[1] + " tail", "same " * 300, "same " * 200, *ODD]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[3], ids[4] = None, ids[5]
    got = substring_dedup.digests(substring_dedup.remove_repeats(clashing(frame(spark, texts, ids)), hot=hot))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_repeats(list(zip(ids, texts, strict=True)))


def test_substring_dedup_texts(spark):
    t = sentences(1, 60)[0]
    docs = frame(spark, [t, "a  b", "x " + t + "\ny", None], [1, 2, 3, 4])
    got = {r["doc_id"]: r["text"] for r in substring_dedup.kept_texts(substring_dedup.remove_repeats(docs)).collect()}
    assert got == {1: t, 2: "a  b", 3: "x y", 4: None}
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_fm_index_counts():
    rng = np.random.default_rng(0)
    text = np.concatenate((rng.integers(1, 4, 300), [0]))
    index = substring_dedup.FMIndex(text, 4, 6)
    s = text.tolist()
    for n in range(1, 7):
        for at in range(0, 290, 13):
            lo, hi = np.array([0]), np.array([len(text)])
            for w in reversed(s[at : at + n]):
                lo, hi = index.extend(lo, hi, np.array([w]))
            assert hi[0] - lo[0] == sum(s[i : i + n] == s[at : at + n] for i in range(len(s)))


# 9


def test_toxicity(spark):
    rng = random.Random(6)
    texts, toxic = [], []
    for i, t in enumerate(sentences(400, 30, seed=11)):
        bad = i % 5 == 0
        w = t.split()
        if bad:
            w[rng.randrange(30)] = rng.choice(["stupid", "scum", "vorkig" + rng.choice(["a", "en", "os"]), "lumpra" + rng.choice(["x", "y", "zz"])])
        texts.append(" ".join(w))
        toxic.append(int(bad))
    docs = frame(spark, texts + ODD)
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int")
    sample = labelled_sample(docs, labels, "toxic", F.col("doc_id") % 3 != 1, 1000)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(clashing(docs), sample).collect()}
    held = [i for i in range(400) if i % 3 == 1]
    assert np.mean([(got[i] >= 0.7) == toxic[i] for i in held]) > 0.97
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 400 + len(ODD) and got[400] < 0.5
    assert toxicity.score(docs.limit(0), sample).count() == 0
    unlabelled = toxicity.score(docs, sample.limit(0))
    assert unlabelled.count() == 400 + len(ODD)


def test_label_model_sums_to_one_and_knows_correlation():
    """Enumerated: a tree model's probabilities sum to one, and a copied voter adds no evidence."""
    rng = np.random.default_rng(4)
    n, y = 4000, rng.random(4000) < 0.3
    say = lambda right, silent: np.where(rng.random(n) < silent, 0, np.where(y == (rng.random(n) < right), 2, 1))
    a, b = say(0.9, 0.2), say(0.7, 0.5)
    votes = np.stack((a, a, b), axis=1)
    tables = toxicity.pair_tables(votes, np.stack((~y, y), axis=1).astype(float))
    model = toxicity.model_of(tables)
    every = np.array(list(np.ndindex(3, 3, 3)))
    assert np.allclose(np.exp(model.likelihood(every)).sum(axis=0), 1)
    alone = toxicity.model_of(toxicity.pair_tables(votes[:, 1:], np.stack((~y, y), axis=1).astype(float)))
    assert np.allclose(model.posterior(np.array([[2, 2, 0], [1, 1, 2]])), alone.posterior(np.array([[2, 0], [1, 2]])), atol=0.01)
    assert {tuple(sorted((v, int(p)))) for v, p in enumerate(model.parent) if v != p} >= {(0, 1)}


def test_label_model_learns_without_labels(spark):
    """EM finds the classes and the accuracies of voters that no one has labelled."""
    rng = np.random.default_rng(6)
    n, y = 6000, rng.random(6000) < 0.2
    votes = np.zeros((n, len(toxicity.VOTERS)), np.int64)
    accuracy = [0.95, 0.9, 0.85, 0.9]
    for v, right in enumerate(accuracy):
        votes[:, v] = np.where(rng.random(n) < 0.1, 0, np.where(y == (rng.random(n) < right), 2, 1))
    patterns, counts = np.unique(votes @ (3 ** np.arange(len(toxicity.VOTERS))), return_counts=True)
    rows = spark.createDataFrame([(int(p), int(c), 0, 0) for p, c in zip(patterns, counts, strict=True)], "votes long, n long, y0 long, y1 long")
    model = toxicity.fit_label_model(rows, steps=40, tolerance=1e-6)
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.95 and abs(model.prior - 0.2) < 0.05


def test_toxicity_of_one_class(spark):
    docs = frame(spark, ["you are scum", "a calm text", None])
    labels = spark.createDataFrame([(0, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, labelled_sample(docs, labels, "toxic", F.lit(True), 10)).collect()}
    assert len(got) == 3 and got[0] > got[1] and all(0 <= s <= 1 for s in got.values())


# 10


@pytest.mark.parametrize("as_text", [False, True])
def test_tokens_equal_the_library(spark, as_text):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file())
    library.encode_special_tokens = as_text
    texts = [*ODD, "It's  we'll\n\n 'tis 12,345.6 ", " lead", "trail ", "a\u00a0b \u2003 c", "<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>\n y  <|endof text|>", *sentences(5, 50)]
    got = {r["doc_id"]: r for r in packing.token_pieces(frame(spark, texts), tokenizer_file(), 1 << 20, specials_are_text=as_text).collect()}
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[i]["length"], got[i]["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))


def test_packing(spark):
    texts = sentences(120, 20) + sentences(30, 300, seed=2) + ODD
    rows = packing.pack_documents(clashing(frame(spark, texts)), tokenizer_file(), 256).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by_doc.values():
        pieces.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert [r["start"] for r in pieces] == [sum(x["length"] for x in pieces[:i]) for i in range(len(pieces))]
        assert all(r["length"] == 256 for r in pieces[1:])
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    need = sum(r["length"] for r in rows) / 256
    assert len(by_doc) == len(texts) and len(by_sequence) <= need * 1.05 + 1
    assert packing.pack_documents(frame(spark, []), tokenizer_file()).count() == 0


def test_plan_is_best_fit():
    rng = random.Random(0)
    counts = Counter(rng.randrange(1, 65) for _ in range(3000))
    rows = packing.plan(counts, 64)
    used = defaultdict(list)
    for length, _, n, first, offset in rows.tolist():
        for s in range(first, first + n):
            used[s].append((offset, length))
    assert Counter(x for v in used.values() for _, x in v) == counts
    bins = []
    for length in sorted(counts.elements(), reverse=True):
        fit = [i for i, room in enumerate(bins) if room >= length]
        i = min(fit, key=lambda i: bins[i], default=None)
        if i is None:
            bins.append(64 - length)
        else:
            bins[i] -= length
    assert len(used) == len(bins)
