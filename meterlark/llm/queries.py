"""The queries of this package, by name, and SQL for those that SQL can express."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_curves, collocations, language_id, line_frequency, mixing, packing, prefix_trie, quality_crf, simhash, substring_dedup, topk_search, toxicity, url_filter
from .common import read_table, remainder_of_id
from .labelled import labelled_sample



def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """A tokenizer's file, which executors have at the same place; METERLARK_TOKENIZERS names another folder."""
    folder = os.environ.get("METERLARK_TOKENIZERS")
    return f"{folder}/{name}" if folder else str(public_tokenizers.path(name))


def op1_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    """Queries: the documents whose id is divisible by 20; all documents are searched."""
    docs = read_table(spark, folder, "documents")
    return topk_search.search_table(docs, docs.where(F.col("doc_id") % 20 == 0))


OP1_SQL = r"""
WITH lowered AS (
  SELECT doc_id, row_number() OVER () AS row_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents WHERE doc_id IS NOT NULL),
words AS (SELECT doc_id, row_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM lowered),
facts AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM words),
asked AS (SELECT DISTINCT doc_id AS query_id, unnest(ws) AS term FROM words WHERE doc_id % 20 = 0),
flat AS (SELECT doc_id, row_id, len(ws) AS size, unnest(ws) AS term FROM words),
tf AS (SELECT doc_id, row_id, size, term, count(*) AS tf FROM flat WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (
  SELECT query_id, row_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term), facts GROUP BY query_id, row_id, doc_id),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    held_out = remainder_of_id(F.col("doc_id"), 3) == 1
    model = language_id.train(docs.where(~held_out))
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_quality_crf(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    held_out = remainder_of_id(F.col("doc_id"), 4) == 2
    sample = labelled_sample(docs, read_table(spark, folder, "labels"), "quality", ~held_out, quality_crf.PER_CLASS)
    scored = quality_crf.score(docs, quality_crf.fit(sample))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_ann_curves(spark: SparkSession, folder: str) -> DataFrame:
    return ann_curves.neighbours(read_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "source", "text")
    out = mixing.mix_sources(docs)
    return out.select("doc_id", F.col("mx_size").alias("size"), F.col("mx_total").alias("source_size"), F.col("mx_target").alias("target"), (F.col("mx_copies") * F.col("mx_size")).alias("taken"), F.col("mx_copies").alias("copies"))


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    out = simhash.near_duplicates(read_table(spark, folder, "documents"))
    return out.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


#: host, path, action
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = """
WITH rules(rule_host, rule_path, action) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
cut AS (
  SELECT page_id, url, row_number() OVER () AS row_id,
    CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, row_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
best AS (
  SELECT row_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(action, length(rule_host || rule_path)) AS action
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY row_id)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM parts LEFT JOIN best USING (row_id)
"""


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return substring_dedup.digests(substring_dedup.remove_repeats(docs))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50 AND doc_id IS NOT NULL),
windows AS (SELECT r, doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS k FROM starts),
firsts AS (SELECT k, min(doc_id) AS least FROM windows GROUP BY k),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM windows JOIN firsts USING (k) WHERE least < doc_id),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words WHERE (r, p) NOT IN (SELECT r, p FROM gone) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    held_out = remainder_of_id(F.col("doc_id"), 3) == 1
    sample = labelled_sample(docs, read_table(spark, folder, "labels"), "toxic", ~held_out, toxicity.PER_CLASS)
    return toxicity.score(docs, sample).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, folder, "documents"), tokenizer_file())


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie_of_rebuilt(read_table(spark, folder, "conversations"))


OP11_SQL = r"""
WITH raw AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS content, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, content) - 1 AS pos, content, words FROM raw),
bits AS (SELECT 0 AS step, i AS r, CAST(i AS BIGINT) AS v FROM range(256) t(i)),
crc1 AS (SELECT r, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM bits),
crc2 AS (SELECT r, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM crc1),
crc3 AS (SELECT r, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM crc2),
crc4 AS (SELECT r, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM crc3),
crc5 AS (SELECT r, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM crc4),
crc6 AS (SELECT r, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM crc5),
crc7 AS (SELECT r, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM crc6),
crc8 AS (SELECT r, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM crc7),
crc AS (SELECT list(v ORDER BY r) AS t FROM crc8),
every AS (
  SELECT c, n, c - c % 20 AS b,
    xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda s, x: xor(s >> 8, t[xor(s & 255, x) + 1]))) % 4 AS h
  FROM (SELECT c, count(*) AS n FROM turns GROUP BY c), crc),
plan AS (SELECT x.c, x.b, x.h, least(x.h, coalesce(y.n, 0)) AS head FROM every x LEFT JOIN every y ON y.c = x.b),
rebuilt AS (
  SELECT c, pos - h + head AS pos, content, words FROM turns JOIN plan USING (c) WHERE pos >= h
  UNION ALL SELECT plan.c, pos, content, words FROM plan JOIN turns ON turns.c = plan.b WHERE pos < head),
paths AS (SELECT c, pos + 1 AS d, words, md5(array_to_string(list(content) OVER (PARTITION BY c ORDER BY pos), ',')) AS key FROM rebuilt
  UNION ALL SELECT c, 0, 0, '' FROM plan),
nodes AS (SELECT d, key, min(c) AS o, count(*) AS n, max(words) AS words FROM paths GROUP BY d, key),
owned AS (SELECT p.c, p.d, o FROM paths p JOIN nodes USING (d, key)),
linked AS (SELECT nodes.*, owned.o AS up FROM nodes LEFT JOIN owned ON owned.c = nodes.o AND owned.d = nodes.d - 1),
kids AS (SELECT up AS o, d - 1 AS d, count(*) AS kids FROM linked WHERE d > 0 GROUP BY ALL),
valued AS (SELECT linked.*, coalesce(kids, 0) AS kids FROM linked LEFT JOIN kids USING (o, d)),
subtree AS (SELECT a.o, a.d, count(*) FILTER (kids = 0) AS leaves, CAST(sum((n - 1) * words) AS BIGINT) AS saved FROM valued v JOIN owned a ON a.c = v.o AND a.d <= v.d GROUP BY ALL),
ends AS (SELECT o, d, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS sha FROM owned WHERE d = (SELECT max(p.d) FROM paths p WHERE p.c = owned.c) GROUP BY ALL)
SELECT o AS conv_id, d AS depth, up AS parent_conv_id, n AS n_convs, kids AS n_children, leaves AS n_leaves, saved AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM valued JOIN subtree USING (o, d) LEFT JOIN ends USING (o, d)
"""


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(read_table(spark, folder, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
words AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, w, i, unnest(range(1, 6)) AS size FROM starts),
f AS (SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, size, count(*) AS a FROM grams WHERE i + size - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
cut AS (SELECT lang, phrase, a, w, size, unnest(range(1, size)) AS k FROM c),
scored AS (
  SELECT cut.lang, cut.phrase, cut.a, n, k, x.a AS l, y.a AS r, CAST(CAST(1000 AS HUGEINT) * cut.a * n // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM cut JOIN totals USING (lang) JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM low WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = low.lang AND c.phrase <> low.phrase AND contains(' ' || c.phrase || ' ', ' ' || low.phrase || ' ') AND 100 * c.a >= 100 * low.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


def op13_line_frequency(spark: SparkSession, folder: str) -> DataFrame:
    """A document's host is its source."""
    out = line_frequency.judge(read_table(spark, folder, "documents").select("doc_id", "source", "text"))
    names = {"lf_words": "n_words", "lf_chars": "word_chars", "lf_symbols": "n_symbols", "lf_dup_lines": "n_dup_lines", "lf_repeats": "n_repeat_words", "lf_base_failed": "base_failed", "lf_kept": "kept"}
    return out.select("doc_id", *[F.col(a).alias(b) for a, b in names.items()])


OP13_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_id, coalesce(text, '') AS t, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS host, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT row_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) > 8),
windows AS (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, array_to_string(w[i:i + 7], ' ')) AS times FROM starts),
repeats AS (SELECT row_id, count(DISTINCT p) AS n FROM (SELECT row_id, unnest(range(i, i + 8)) AS p FROM windows WHERE times > 1) GROUP BY row_id),
raw AS (SELECT row_id, host, md5(t) AS whole, unnest(string_split(t, chr(10))) AS line FROM d),
lines AS (
  SELECT row_id, host, whole, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    lower(regexp_replace(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]+', '0', 'g')) AS norm
  FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT row_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY row_id),
sizes AS (SELECT host, count(DISTINCT md5(t)) AS size FROM d GROUP BY host),
common AS (SELECT host, norm FROM lines JOIN sizes USING (host) GROUP BY host, norm, size HAVING count(DISTINCT whole) > 10 AND count(DISTINCT whole) > size * 0.01e0),
removed AS (SELECT row_id, CAST(sum(n) AS BIGINT) AS gone FROM lines JOIN common USING (host, norm) GROUP BY row_id),
facts AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, coalesce(gone, 0) AS gone
  FROM d LEFT JOIN dups USING (row_id) LEFT JOIN repeats USING (row_id) LEFT JOIN removed USING (row_id)),
based AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM facts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - gone >= 20 AND n_words - gone >= n_words * 0.5e0 AS kept FROM based
"""


QUERIES = {
    "op1_topk_search": op1_topk_search,
    "op2_language_id": op2_language_id,
    "op3_quality_crf": op3_quality_crf,
    "op4_ann_curves": op4_ann_curves,
    "op5_mixing": op5_mixing,
    "op6_simhash": op6_simhash,
    "op7_url_filter": op7_url_filter,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_packing": op10_packing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_collocations": op12_collocations,
    "op13_line_frequency": op13_line_frequency,
}
ORACLE_SQL = {"op1_topk_search": OP1_SQL, "op7_url_filter": OP7_SQL, "op8_substring_dedup": OP8_SQL, "op11_prefix_trie": OP11_SQL, "op12_collocations": OP12_SQL, "op13_line_frequency": OP13_SQL}
