"""The pipeline's stages and the queries' columns on a small folder."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meterlark.llm import queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(0)
    top = tmp_path_factory.mktemp("tables")
    words = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    passage = words(80)
    texts = [words(60) for _ in range(120)] + [words(30) + " scum " + words(20) for _ in range(30)] + [words(20) + " " + passage + " " + words(20) for _ in range(6)]
    texts += [texts[0], texts[1] + " more", None, "", "one"]
    docs = [(i, t, rng.choice(["en", "fr"]), rng.choice(["a", "b", None]), None if t is None else len(t)) for i, t in enumerate(texts)] + [(0, texts[0], "en", "a", 1), (None, "nameless text here", None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), int(120 <= i < 150)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(0, texts[3]), (20, texts[4]), (21, "x")], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)], 0) for i in range(120)], "vec_id long, embedding array<float>, label int").write.parquet(f"{top}/embeddings.parquet")
    spark.createDataFrame([(i, f"http://www.example.{t}/{p}/x", "") for i, (t, p) in enumerate([("com", "en"), ("net", "es"), ("org", "fr"), ("com", "de")])], "page_id long, url string, html string").write.parquet(f"{top}/pages.parquet")
    return str(top)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder).cache()
        if name != "packing":
            assert out.columns == COLUMNS
        kept.append({r["doc_id"] for r in out.select("doc_id").collect()})
        docs = out
    toxic = set(range(120, 150))
    assert not kept[0] & toxic and len(kept[0] & set(range(120))) > 115
    assert 156 not in kept[1] and 0 in kept[1] and None in kept[1]
    assert kept[2] == kept[1] and kept[4] == kept[3] <= kept[2]


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, folder, name):
    want = {
        "op1": ["query_id", "rank", "doc_id", "score"], "op2": ["doc_id", "held_out", "lang_pred", "score"], "op3": ["doc_id", "held_out", "score", "predicted"], "op4": ["query_id", "rank", "vec_id", "score"], "op5": ["doc_id", "size", "source_size", "target", "taken"], "op6": ["doc_id", "fingerprint", "component_id"],
        "op7": ["page_id", "host", "path", "rule", "verdict"], "op8": ["doc_id", "n_words", "n_removed", "kept_sha256"], "op9": ["doc_id", "held_out", "score", "predicted"], "op10": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    }[name.split("_")[0]]
    out = queries.QUERIES[name](spark, folder)
    assert out.columns[: len(want)] == want
    rows = out.count()
    documents = spark.read.parquet(f"{folder}/documents.parquet").count()
    assert rows == documents if name.split("_")[0] in ("op2", "op3", "op5", "op6", "op8", "op9") else rows > 0
    assert out.where(F.col(want[0]).isNotNull()).count() > 0


@pytest.mark.parametrize(("name", "divisor", "rest"), [("op2_language_id", 3, 1), ("op3_quality_crf", 4, 2), ("op9_toxicity", 3, 1)])
def test_held_out_rows_teach_nothing(spark, folder, tmp_path, name, divisor, rest):
    """What is held out follows the id's checksum, and changing its labels changes no score."""
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % divisor == rest
    rows = queries.QUERIES[name](spark, folder).collect()
    assert all(r["held_out"] == held(r["doc_id"]) for r in rows)
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet").collect(), spark.read.parquet(f"{folder}/labels.parquet").collect()
    other = [(r["doc_id"], r["text"], "xx" if held(r["doc_id"]) else r["lang"], r["source"], r["n_chars"]) for r in docs]
    spark.createDataFrame(other, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    turned = [(r["doc_id"], 1 - r["quality"], 1 - r["toxic"]) if held(r["doc_id"]) else tuple(r) for r in labels]
    spark.createDataFrame(turned, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    again = queries.QUERIES[name](spark, str(tmp_path)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, round(r["score"], 6), r["lang_pred"] if "lang_pred" in r else r["predicted"])
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_stages_keep_what_they_should(spark):
    """Rows with one id and different texts, null ids and texts, empty texts and an empty table pass the filtering stages."""
    long = " ".join(f"v{i}" for i in range(70))
    rows = [(1, "first text of this id", "en", "a", 5), (1, "second text, unlike the first", "en", "a", None), (2, "", "en", "a", 3), (3, None, None, None, None), (None, None, None, None, None), (None, long, "en", "b", 9), (4, long + " tail", "en", "b", 9), (5, long + " tail", "en", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    near = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()), key=str)
    assert near == sorted([(1, "first text of this id"), (1, "second text, unlike the first"), (2, ""), (4, long + " tail")], key=str)
    cut = {(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_repeated_passages(spark, docs, "").collect()}
    assert cut == {(i, t) for i, t, *_ in rows if i != 5} | {(5, "tail")} - {(5, long + " tail")} or cut == {(i, t) for i, t, *_ in rows if i != 5}
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.drop_repeated_passages, corpus_pipeline.mix_sources, corpus_pipeline.pack_sequences):
        assert stage(spark, docs.limit(0), "").count() == 0
