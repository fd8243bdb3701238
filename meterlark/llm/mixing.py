"""Mixing sources to target weights by entropy balancing.

Among all document rates between 0 and ``max_repeat`` whose words meet each source's target, take the ones of least
relative entropy against "every document once".  The dual has one multiplier a source and its solution is an
exponentially tilted rate, ``min(max_repeat, exp(multiplier * size))``.  The rate depends on source and size alone, so
Newton's method runs over exact counts by (source, size): each step is one join and one aggregation of that small
table, kept apart by source and never brought to the driver.

Rates become whole copies by one pass of systematic rounding along (source, size): a document gets the integers that
the running sum of rates crosses.  As neighbours in that order have nearly equal sizes, a source's words miss its
target by no more than about its longest document; where the running sum begins is chosen, of 64 places, to come
nearest.  Running sums are exact decimals, so reruns agree.  Long runs of one (source, size) are dealt to ``salts``
parts, whose places in the running sum come from their counts.

Defined results: null text has size 0; documents of size 0 take no words; a null source is a source of its own, last
in order; repeated rows count as rows of their own; an empty table gives an empty result; other columns are carried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WORD, materialize

UNIT = 1_000_000_000  # rates are counted in these parts of a copy
OFFSETS = 64  # places at which a source's running sum may begin


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A never-null text that orders sources by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sizes: DataFrame, weights: Sequence[float], max_repeat: float) -> DataFrame:
    """(mx_key, mx_total, ...) with ``mx_target``: shares by weight of all words, none above ``max_repeat`` times its source's.

    One row a source.  Taking sources by cap per weight, those before the first that its share fits are held at their cap.
    """
    order = Window.orderBy("mx_key")
    by_cap = Window.orderBy("mx_ratio", "mx_key")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    out = (
        sizes.withColumn("mx_weight", weight)
        .withColumn("mx_cap", F.col("mx_total") * F.lit(float(max_repeat)))
        .withColumn("mx_ratio", F.col("mx_cap") / F.col("mx_weight"))
        .withColumn("mx_level", (F.sum("mx_total").over(everything) - F.coalesce(F.sum("mx_cap").over(before), F.lit(0.0))) / (F.sum("mx_weight").over(everything) - F.coalesce(F.sum("mx_weight").over(before), F.lit(0.0))))
        .withColumn("mx_level", F.min_by(F.when(F.col("mx_level") <= F.col("mx_ratio"), F.col("mx_level")), F.when(F.col("mx_level") <= F.col("mx_ratio"), F.struct("mx_ratio", "mx_key"))).over(everything))
    )
    return out.withColumn("mx_target", F.least(F.col("mx_cap"), F.col("mx_weight") * F.coalesce(F.col("mx_level"), F.lit(0.0)))).drop("mx_ratio", "mx_level", "mx_weight")


def balance(counts: DataFrame, goals: DataFrame, max_repeat: float, tolerance: float = 1e-7, max_steps: int = 60) -> DataFrame:
    """(mx_key, mx_lambda): the dual's solution for each source, by Newton steps held within brackets."""
    top = F.log(F.lit(float(max_repeat)))
    open_ = (F.col("mx_target") > 0) & (F.col("mx_target") < F.col("mx_cap") * (1 - 1e-9))
    gap = F.log(F.col("mx_target") / F.col("mx_total")) / F.col("mx_least")
    state = materialize(
        goals.where(open_)
        .withColumn("mx_lambda", F.lit(0.0))
        .withColumn("mx_lo", F.when(F.col("mx_target") < F.col("mx_total"), gap).otherwise(F.lit(0.0)))
        .withColumn("mx_hi", F.when(F.col("mx_target") < F.col("mx_total"), F.lit(0.0)).otherwise(top / F.col("mx_least")))
        .select("mx_key", "mx_target", "mx_lambda", "mx_lo", "mx_hi"),
        "mix-dual",
    )
    counts = counts.where("mx_size > 0")
    for _ in range(max_steps):
        tilt = F.least(F.col("mx_lambda") * F.col("mx_size"), top)
        words = F.col("mx_n") * F.col("mx_size") * F.exp(tilt)
        sums = (
            counts.join(state, "mx_key")
            .groupBy("mx_key", "mx_target", "mx_lambda", "mx_lo", "mx_hi")
            .agg(F.sum(words).alias("mx_words"), F.sum(F.when(tilt < top, words * F.col("mx_size")).otherwise(F.lit(0.0))).alias("mx_slope"))
        )
        low = F.col("mx_words") < F.col("mx_target")
        lo, hi = F.when(low, F.col("mx_lambda")).otherwise(F.col("mx_lo")), F.when(low, F.col("mx_hi")).otherwise(F.col("mx_lambda"))
        step = F.col("mx_lambda") - F.log(F.col("mx_words") / F.col("mx_target")) * F.col("mx_words") / F.col("mx_slope")
        miss = F.abs(F.col("mx_words") / F.col("mx_target") - 1)
        state = materialize(
            sums.withColumn("mx_miss", miss)
            .withColumn("mx_to", F.when((F.col("mx_slope") > 0) & (step > lo) & (step < hi), step).otherwise((lo + hi) / 2))
            .select("mx_key", "mx_target", F.when(F.col("mx_miss") <= tolerance, F.col("mx_lambda")).otherwise(F.col("mx_to")).alias("mx_lambda"), lo.alias("mx_lo"), hi.alias("mx_hi"), "mx_miss"),
            "mix-dual",
        )
        worst = state.agg(F.max("mx_miss")).first()[0]
        state = state.drop("mx_miss")
        if worst is None or worst <= tolerance:
            break
    else:
        raise RuntimeError(f"targets are missed by {worst} after {max_steps} steps")
    return state.select("mx_key", F.round("mx_lambda", 12).alias("mx_lambda"))


def offsets(planned: DataFrame) -> DataFrame:
    """(mx_key, mx_offset): where each source's running sum begins, of ``OFFSETS`` places the one whose words come nearest to the target.

    A size's copies are the integers that its part of the running sum crosses, so counts by size tell the words.
    """
    tried = planned.withColumn("mx_offset", F.explode(F.array(*[F.lit(i * (UNIT // OFFSETS)).cast("long") for i in range(OFFSETS)])))
    crossed = F.expr(f"cast((mx_from + mx_offset + cast(mx_n as decimal(38,0)) * mx_rate) div {UNIT} - (mx_from + mx_offset) div {UNIT} as double)")
    words = tried.groupBy("mx_key", "mx_offset").agg(F.sum(crossed * F.col("mx_size")).alias("mx_words"), F.first("mx_target").alias("mx_target"))
    return words.groupBy("mx_key").agg(F.min_by("mx_offset", F.struct(F.abs(F.col("mx_words") - F.col("mx_target")), "mx_offset")).alias("mx_offset"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeat: int = 3, salts: int = 256, source: str = "source", text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``mx_size``, ``mx_total`` (its source's words), ``mx_target`` and ``mx_copies`` (0 to ``max_repeat``).

    Weights repeat over the sources in code-point order.  All columns of ``docs`` are carried; none may begin with ``mx_``.
    """
    rows = docs.withColumns({"mx_size": word_count(F.col(text)), "mx_key": source_key(F.col(source)), "mx_hash": F.xxhash64(row_id, text)}).withColumn("mx_salt", F.pmod("mx_hash", F.lit(salts)).cast("int"))
    parts = materialize(rows.groupBy("mx_key", "mx_size", "mx_salt").agg(F.count("*").alias("mx_n")), "mix-counts")
    counts = materialize(parts.groupBy("mx_key", "mx_size").agg(F.sum("mx_n").alias("mx_n")), "mix-sizes")
    sizes = counts.groupBy("mx_key").agg(F.sum(F.col("mx_n") * F.col("mx_size")).alias("mx_total"), F.min(F.when(F.col("mx_size") > 0, F.col("mx_size"))).alias("mx_least"))
    goals = materialize(targets(sizes, weights, max_repeat), "mix-targets")
    dual = balance(counts, goals, max_repeat)
    rate = (
        F.when(F.col("mx_target") <= 0, F.lit(0.0))
        .when(F.col("mx_lambda").isNull(), F.lit(float(max_repeat)))
        .otherwise(F.exp(F.least(F.col("mx_lambda") * F.col("mx_size"), F.log(F.lit(float(max_repeat))))))
    )
    exact = T.DecimalType(38, 0)
    along = Window.partitionBy("mx_key").orderBy("mx_size").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("mx_key", "mx_size").orderBy("mx_salt").rowsBetween(Window.unboundedPreceding, -1)
    passed = lambda n, w: F.coalesce(F.sum((F.col(n) * F.col("mx_rate")).cast(exact)).over(w), F.lit(0).cast(exact))
    planned = (
        counts.join(goals.join(dual, "mx_key", "left"), "mx_key")
        .withColumn("mx_rate", F.round(rate * UNIT).cast("long"))
        .withColumn("mx_from", (passed("mx_n", along) % UNIT).cast("long"))
        .select("mx_key", "mx_size", "mx_n", "mx_total", "mx_target", "mx_rate", "mx_from")
    )
    planned = materialize(planned, "mix-plan")
    planned = planned.join(offsets(planned), "mx_key").withColumn("mx_from", (F.col("mx_from") + F.col("mx_offset")) % UNIT).drop("mx_n", "mx_offset")
    planned = (
        parts.join(planned, ["mx_key", "mx_size"])
        .withColumn("mx_from", ((F.col("mx_from") + passed("mx_n", within)) % UNIT).cast("long"))
        .drop("mx_n")
    )
    rank = F.row_number().over(Window.partitionBy("mx_key", "mx_size", "mx_salt").orderBy("mx_hash", row_id)) - 1
    there = F.pmod(F.col("mx_from") + F.pmod(F.col("mx_rank") * F.col("mx_rate"), F.lit(UNIT)), F.lit(UNIT))
    return (
        rows.withColumn("mx_rank", rank.cast("long"))
        .join(planned, ["mx_key", "mx_size", "mx_salt"])
        .withColumn("mx_copies", F.least(F.floor((there + F.col("mx_rate")) / UNIT), F.lit(max_repeat)).cast("int"))
        .drop("mx_key", "mx_salt", "mx_hash", "mx_rank", "mx_rate", "mx_from")
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    return mix_sources(docs, **how).where("mx_copies > 0").withColumn("mx_copy", F.explode(F.sequence(F.lit(1), F.col("mx_copies")))).select(*docs.columns)
