"""Prefix trie, phrase mining and line frequency against brute force, with edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meterlark.llm import collocations, line_frequency, prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TURNS = "conv_id long, turn long, role string, text string"


def clashing(df):
    return df.withColumns({"c": F.lit("x"), "at": F.lit(1), "name": F.lit("n"), "words": F.lit(2.5), "chunk": F.lit("k"), "a": F.lit(None).cast("string"), "k": F.lit(0)})


# 11


def brute_trie(rows, group=20, most=4):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            content = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            by[c].append(((turn is not None, turn or 0, role, content), role, text))
    own = {c: [x[1:] for x in sorted(v)] for c, v in by.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - (abs(c) % group) * (1 if c >= 0 else -1)
        whole[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, cs in members.items():
        words = len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(cs) - 1) * words
    out = set()
    for p, cs in members.items():
        ends = sorted(c for c in cs if len(whole[c]) == len(p))
        out.add((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def trie_rows(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = [tuple(r[n] for n in names) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def conversations(seed=0, n=70):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        size = rng.choice([1, 1, 2, 3, 5, 8, 9, 17 if c % 9 == 0 else 4])
        rows += [(c, t, ["user", "assistant", None][t % 3], f"t{rng.randrange(2)}  w w" if rng.random() < 0.8 else f"{c} {t}") for t in range(size)]
    return rows


def test_trie(spark):
    rows = conversations()
    rows += [(-7, 0, "user", "t0  w w"), (-7, 1, None, None), (-7, None, None, ""), (None, 0, "user", "nobody"), (1003, 0, "user", "alone"), (1003, 1, "user", "twice"), (1003, 1, "user", "twice"), (90_001, 5, "user", "漢 字"), (90_002, 0, "", "x " * 50_000)]
    df = clashing(spark.createDataFrame(rows, TURNS).repartition(5))
    assert trie_rows(prefix_trie.trie_of_rebuilt(df)) == brute_trie(rows)


def test_trie_of_one_long_conversation_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    rows = [(0, t, "user", f"t{t % 5}") for t in range(131)] + [(c, t, "user", f"t{t}") for c in range(20, 400, 20) for t in range(3)]
    assert trie_rows(prefix_trie.trie_of_rebuilt(spark.createDataFrame(rows, TURNS))) == brute_trie(rows)
    as_they_are = trie_rows(prefix_trie.trie_of(spark.createDataFrame(rows, TURNS)))
    assert as_they_are == brute_trie(rows, most=1)


def test_trie_of_turnless_and_empty(spark):
    rows = [(c, 0, "user", "a") for c in range(101, 119)]  # their heads' conversation is absent
    assert trie_rows(prefix_trie.trie_of_rebuilt(spark.createDataFrame(rows, TURNS))) == brute_trie(rows)
    assert prefix_trie.trie_of_rebuilt(spark.createDataFrame([], TURNS)).count() == 0


def test_names_are_dense(spark):
    rows = spark.range(1000, numPartitions=7).select("id", (F.col("id") % 37).alias("key"))
    got = prefix_trie.named(rows, ["key"], "name").collect()
    names = {r["id"] % 37: r["name"] for r in got}
    assert sorted(names.values()) == list(range(37)) and all(names[r["id"] % 37] == r["name"] for r in got)


# 12


def brute_phrases(rows, longest, least, top, share=100):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, p), a in candidates.items():
        longer = [b for (m, q), b in candidates.items() if m == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= share * a for b in longer):
            continue
        score, k = min((int(Fraction(1000 * a * n[lang], f[lang, p[:k]] * f[lang, p[k:]])), k) for k in range(1, len(p)))
        phrase = " ".join(p)
        out[lang].append((-score, -a, phrase.encode(), phrase, f[lang, p[:k]], f[lang, p[k:]]))
    return [(lang, i + 1, p, -a, left, right, n[lang], -s) for lang, v in out.items() for i, (s, a, _, p, left, right) in enumerate(sorted(v)[:top])]


def documents(seed=1, n=120):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "élan", "New", "york", "a", "z\x00", "漢字", "In"]
    return [
        (rng.choice(["en", "fr", None, "und", ""]), " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".", "\t", "\n", "\v", "\x85"]) for _ in range(rng.randrange(60))))
        for _ in range(n)
    ]


@pytest.mark.parametrize("limit", [1 << 21, 64])
def test_phrases(spark, monkeypatch, limit):
    """Whatever is cut where, and with a sketch that is emptied every few n-grams."""
    monkeypatch.setattr(collocations.text_slices, "__defaults__", (limit,))
    monkeypatch.setattr(collocations, "BATCH", 500)
    rows = documents() + [("en", None), ("en", ""), (None, " ,.,"), ("en", "the new york of " * 3000)] + [("en", "new york in élan. of the")] * 12
    df = clashing(spark.createDataFrame(rows, "lang string, text string").repartition(3))
    got = [tuple(r) for r in collocations.collocations(df, longest=5, least=8, top=25).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert sorted(got) == sorted(brute_phrases(rows, 5, 8, 25))
    got = [tuple(r) for r in collocations.collocations(df, longest=3, least=4, top=9, share=60).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert sorted(got) == sorted(brute_phrases(rows, 3, 4, 9, 60))


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "LEAST_CELLS", 16)
    monkeypatch.setattr(collocations, "MOST_CELLS", 16)
    rows = documents(seed=5)
    df = spark.createDataFrame(rows, "lang string, text string")
    got = [tuple(r) for r in collocations.collocations(df, least=5, top=30).collect()]
    assert sorted(got) == sorted(brute_phrases(rows, 5, 5, 30))


def test_no_phrases(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", "a b c"), (None, None)], "lang string, text string")).count() == 0


def test_sketch_overestimates(spark):
    """Merged over tasks, a cell's bit is set if and only if its n-grams together reach the count."""
    rows = documents(seed=3)
    cells, least = 1 << 10, 6
    df = spark.createDataFrame([(x or "und", y) for x, y in rows], "lang string, text string").repartition(6)
    got = {r["chunk"]: np.unpackbits(np.frombuffer(r["bits"], np.uint8)) for r in collocations.sketch(df, cells, 3, least).collect()}
    want = np.zeros((collocations.ROWS, cells), int)
    for part in collocations.text_slices(iter([pa.record_batch([pa.array([x or "und" for x, _ in rows]), pa.array([y for _, y in rows])], ["lang", "text"])])):
        for _, _, hashes in part.grams(3):
            for row in range(collocations.ROWS):
                np.add.at(want[row], collocations.cells_of(hashes, row, cells), 1)
    assert {k: v.tolist() for k, v in got.items()} == {row: (want[row] >= least).astype(int).tolist() for row in range(collocations.ROWS)}


# 13


def brute_lines(rows, most_texts, most_share, least_words=20, least_left=0.5):
    norm = lambda x: re.sub(r"[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ")).lower()
    texts, sizes = defaultdict(set), defaultdict(set)
    for _, host, text in rows:
        sizes[host].add(text or "")
        for line in (text or "").split("\n"):
            if WORD.search(line):
                texts[host, norm(line)].add(text)
    common = {k for k, v in texts.items() if len(v) > most_texts and len(v) > most_share * len(sizes[k[0]])}
    out = []
    for i, host, text in rows:
        text = text or ""
        w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {p for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        gone = sum(len(WORD.findall(x)) for x in lines if (host, norm(x)) in common)
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        left = len(w) - gone
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), gone, failed, not failed and left >= least_words and left >= least_left * len(w)))
    return out


def pages(seed=2):
    rng = random.Random(seed)
    menu = ["Home | About  us\t| Contact", "© 2024 All rights reserved # 12", "Read more » in %d comments"]
    rows = []
    for i in range(140):
        lines = [" ".join(rng.choice(["alpha", "βeta", "c*", "漢", "d1"]) + str(rng.randrange(30)) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(9))]
        for k, line in enumerate(menu):
            if rng.random() < 0.4:
                lines.insert(rng.randrange(len(lines) + 1), (line % i if k == 2 else line).upper() if rng.random() < 0.5 else line.replace("%d", str(i)))
        if rng.random() < 0.3:
            lines += lines[:3]
        rows.append((i, ["h0", "h0", "h1", None][i % 4], "\n".join(lines)))
    return rows + [(200, "h0", None), (201, None, ""), (202, "h1", " \n\t\r\n"), (203, "h1", "a b c d e f g h " * 400), (204, "h0", "\n".join(menu * 30)), (None, "h0", "x y " * 15)] + [(300 + i, "h0", rows[0][2]) for i in range(40)]


FACTS = ["doc_id", "lf_words", "lf_chars", "lf_symbols", "lf_dup_lines", "lf_repeats", "lf_removed", "lf_base_failed", "lf_kept"]


def test_line_frequency(spark):
    rows = pages()
    df = clashing(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4))
    got = line_frequency.judge(df, most_texts=10, most_share=0.1)
    assert sorted((tuple(r[n] for n in FACTS) for r in got.collect()), key=repr) == sorted(brute_lines(rows, 10, 0.1), key=repr)
    kept = line_frequency.cleaned(df, most_texts=10, most_share=0.1)
    assert kept.columns == df.columns
    facts = {r[0]: r for r in brute_lines(rows, 10, 0.1)}
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert set(texts) == {i for i, r in facts.items() if r[-1]} and any(facts[i][6] for i in texts)
    assert all(len(WORD.findall(t)) == facts[i][1] - facts[i][6] for i, t in texts.items())
    assert line_frequency.judge(df.limit(0)).count() == 0 and line_frequency.cleaned(df.limit(0)).count() == 0


def test_copies_do_not_make_their_lines_common(spark):
    text = "\n".join(" ".join(f"w{k}x{i}" for i in range(9)) for k in range(5))
    rows = [(i, "h", text) for i in range(60)]
    assert all(r["lf_kept"] and r["lf_removed"] == 0 for r in line_frequency.judge(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect())


def test_the_main_path_has_no_python(spark):
    plan = line_frequency.judge(spark.createDataFrame(pages(), "doc_id long, source string, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
