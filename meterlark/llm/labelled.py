"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn_from: Column, per_class: int, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """(doc_id, text, y): at most ``per_class`` ids of each label, the first by hash of the id, with their documents.

    ``learn_from`` is a condition on doc_id that labels must meet before anything is learned from them.  Rows without
    an id or label are no examples; an id that is labelled twice takes its largest label.
    """
    rows = labels.select(F.col(row_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & learn_from)
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    picked = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    ids = materialize(picked[0].unionByName(picked[1]), "labelled-ids")
    return materialize(docs.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(ids), "doc_id"), "labelled")
