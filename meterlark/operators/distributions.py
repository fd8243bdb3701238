"""Distributions that are stored by day and merged into any window, exact where they are small.

PCT6 to PCT8, AGG44.  For each group and day a row holds count, least and most value, a KLL sketch, and, on days of at most ``EXACT`` values,
the values with their counts.  A window's percentiles are linearly interpolated over all its values if it has at most
``EXACT`` of them, else read off its days' merged sketches, whose rank error doesn't grow with the window.  A merge reads one row a group and
day, whatever the number of values; only windows that are exact unfold their values, at most ``EXACT`` each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT = 10_000  # values up to which a window's percentiles are exact
SIZE = 4096  # the sketches' parameter; a stored sketch has at most about 70 kB
SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def rank_error(size: int = SIZE) -> float:
    """By how much the rank of a sketch's answer may differ from the wanted share (normalised rank error of KLL, at 99 percent)."""
    return 2.296 / size**0.9021


def equal(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> list[Column]:
    """Equality of keys, null to null; without keys there is one row a side."""
    return [a[k].eqNullSafe(b[k]) for k in keys] or [F.lit(True)]


def daily_distributions(rows: DataFrame, value: str, keys: Sequence[str], day: Column, exact: int = EXACT, size: int = SIZE) -> DataFrame:
    """(keys, day, n, least, most, sketch, held): what is stored; null values don't count.

    Values are counted before they meet, so a day of few different values is small however often they occur.
    """
    counted = rows.select(*keys, day.alias("day"), F.col(value).cast("double").alias("x")).where("x is not null")
    stored = counted.groupBy(*keys, "day").agg(F.count("x").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), F.kll_sketch_agg_double("x", F.lit(size)).alias("sketch"))
    small = stored.where(F.col("n") <= exact).select(*keys, "day")
    values = counted.join(small, equal(counted, small, [*keys, "day"]), "left_semi").groupBy(*keys, "day", "x").agg(F.count("x").alias("m"))
    held = values.groupBy(*keys, "day").agg(F.array_sort(F.collect_list(F.struct("x", "m"))).alias("held"))
    return stored.join(held, equal(stored, held, [*keys, "day"]), "left").select(*[stored[c] for c in (*keys, "day", "n", "least", "most", "sketch")], "held")


def merged_distributions(stored: DataFrame, keys: Sequence[str], exact: int = EXACT, size: int = SIZE) -> DataFrame:
    """(keys, n, least, most, exact, p50, p95, p99) of all days of each group of ``keys``, which may be any expression of the stored keys and days."""
    totals = stored.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"),
    )
    totals = totals.withColumn("exact", F.col("n") <= exact)
    few = totals.where("exact").select(*keys)
    values = stored.join(few, equal(stored, few, keys), "left_semi").select(*keys, F.explode("held").alias("v"))
    precise = values.groupBy(*keys).agg(F.percentile("v.x", list(SHARES.values()), F.col("v.m")).alias("q"))
    near = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(p) for p in SHARES.values()]))
    both = totals.join(precise, equal(totals, precise, keys), "left").select(*[totals[c] for c in (*keys, "n", "least", "most", "exact")], F.when(F.col("exact"), F.col("q")).otherwise(near).alias("q"))
    return both.select(*keys, "n", "least", "most", "exact", *[F.col("q")[i].alias(name) for i, name in enumerate(SHARES)])


def rank_misses(rows: DataFrame, value: str, keys: Sequence[str], merged: DataFrame) -> DataFrame:
    """(keys, miss): the largest distance between a wanted share and the exact ranks of its answer, over the shares.

    An answer's ranks run from the share of smaller values to the share of values that aren't larger.
    """
    values = rows.select(*keys, F.col(value).cast("double").alias("x")).where("x is not null")
    answers = merged.select(*keys, "n", *SHARES)
    counts = [F.sum((F.col("x") < F.col(name)).cast("long")).alias(f"{name}_below") for name in SHARES] + [F.sum((F.col("x") <= F.col(name)).cast("long")).alias(f"{name}_to") for name in SHARES]
    met = values.join(answers, equal(values, answers, keys)).select(*[values[k] for k in keys], "x", "n", *SHARES).groupBy(*keys).agg(F.first("n").alias("n"), *counts)
    misses = [F.greatest(F.lit(0.0), F.col(f"{name}_below") / F.col("n") - F.lit(p), F.lit(p) - F.col(f"{name}_to") / F.col("n")) for name, p in SHARES.items()]
    return met.select(*keys, F.greatest(*misses).alias("miss"))
