"""A corpus pipeline of five operators: toxicity, near-duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, folder) and works on all that the stage before kept; its result is written as Parquet
and read back as the next stage's ``docs``.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlark.llm import mixing, packing, simhash, substring_dedup, toxicity
from meterlark.llm.common import materialize, read_table
from meterlark.llm.labelled import labelled_sample
from meterlark.llm.queries import tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier scores below 0.7.  Rows with equal id and text share their score; rows without an id are scored by their text."""
    keyed = docs.select(*COLUMNS).withColumn("pl_key", F.xxhash64("doc_id", "text"))
    sample = labelled_sample(docs, read_table(spark, folder, "labels"), "toxic", F.lit(True), toxicity.PER_CLASS)
    scored = toxicity.score(keyed.select("pl_key", "text"), sample, row_id="pl_key")
    rejected = scored.where("score >= 0.7").select(F.col("doc_id").alias("pl_key")).distinct()
    return keyed.join(rejected, "pl_key", "left_anti").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document, the one with the smallest id, of each group whose five-word shingles are 0.8 alike or more, as their 128 bits tell."""
    return simhash.without_near_duplicates(docs.select(*COLUMNS))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without the words of 50-word windows that start in a document with a smaller id; a text of which nothing is left goes."""
    marked = substring_dedup.remove_repeats(docs.select(*COLUMNS))
    cut = substring_dedup.kept_texts(marked.withColumn("pl_cut", F.col("sd_spans").isNotNull()))
    lost = F.col("pl_cut") & (F.length("text") == 0)
    return cut.where(~lost).withColumn("n_chars", F.when(F.col("pl_cut"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row a piece of a document with its place in a sequence of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_file())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = read_table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)


#: Label models, fingerprints and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
