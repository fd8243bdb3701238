"""Exact percentiles of groups of any size, and broadcasts of tables that have been counted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sinks.tables import written

BROADCAST_ROWS = 50_000


def counted_broadcast(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``table`` marked for broadcast if it has at most so many rows; a larger one is left to Spark."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def exact_percentiles(rows: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], bins: int = 64) -> DataFrame:
    """(keys, one column a share): linearly interpolated percentiles, without a group's values in one task.

    Approximate percentiles cut each group's values into bins; rows are counted by bin, and only bins that hold a wanted
    rank are counted by value and put in order, each on its own.  Null keys are a group; null values don't count.
    """
    if bins & (bins - 1):
        raise ValueError("the number of bins must be a power of two")
    v = rows.select(*keys, F.col(value).cast("double").alias("qx")).where("qx is not null")
    cuts = v.groupBy(*keys).agg(F.percentile_approx("qx", [i / bins for i in range(1, bins)], 10 * bins).alias("q_cuts"), F.count(F.lit(1)).alias("q_n"))
    named = {k: f"q_{i}" for i, k in enumerate(keys)}
    side = lambda df: df.select(*[F.col(k).alias(n) for k, n in named.items()], *[c for c in df.columns if c not in keys])
    same = lambda a, b: [a[k].eqNullSafe(b[n]) for k, n in named.items()] or [F.lit(True)]
    of = side(written(cuts, "cuts"))
    tagged = v.join(counted_broadcast(of), same(v, of)).withColumn("q_bin", F.lit(0))
    step = bins // 2
    while step:  # the number of cuts below the value, by halving
        tagged = tagged.withColumn("q_bin", F.col("q_bin") + F.when(F.get("q_cuts", F.col("q_bin") + (step - 1)) < F.col("qx"), step).otherwise(0))
        step //= 2
    tagged = written(tagged.select(*keys, "qx", "q_bin", "q_n"), "binned")
    counts = tagged.groupBy(*keys, "q_n", "q_bin").agg(F.count(F.lit(1)).alias("q_m"))
    before = Window.partitionBy(*keys).orderBy("q_bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("q_before", F.coalesce(F.sum("q_m").over(before), F.lit(0)))
    at = lambda q: F.lit(q) * (F.col("q_n") - 1)
    ranks = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), r.cast("long").alias("r"), w.alias("w")) for name, q in shares.items() for r, w in ((F.floor(at(q)), 1 - (at(q) - F.floor(at(q)))), (F.floor(at(q)) + 1, at(q) - F.floor(at(q))))]))
    wanted = counts.select("*", ranks.alias("t")).where("t.w > 0 and t.r >= q_before and t.r < q_before + q_m").select(*keys, "q_bin", "t.name", (F.col("t.r") - F.col("q_before")).alias("r"), "t.w")
    wanted = written(wanted, "ranks")
    few = side(wanted.select(*keys, "q_bin").distinct()).withColumnRenamed("q_bin", "q_hit")
    values = tagged.join(counted_broadcast(few), [*same(tagged, few), tagged["q_bin"] == few["q_hit"]], "left_semi").groupBy(*keys, "q_bin", "qx").agg(F.count(F.lit(1)).alias("q_m"))
    order = Window.partitionBy(*keys, "q_bin").orderBy("qx").rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("q_from", F.coalesce(F.sum("q_m").over(order), F.lit(0)))
    hits = side(wanted).withColumnRenamed("q_bin", "q_hit")
    found = values.join(hits, [*same(values, hits), values["q_bin"] == hits["q_hit"], (F.col("r") >= F.col("q_from")) & (F.col("r") < F.col("q_from") + F.col("q_m"))]).select(*keys, "name", (F.col("qx") * F.col("w")).alias("part"))
    return found.groupBy(*keys).agg(*[F.sum(F.when(F.col("name") == name, F.col("part"))).alias(name) for name in shares])


def measured_percentiles(rows: DataFrame, keys: Sequence[str], measures: dict[str, Column], shares: dict[str, float]) -> DataFrame:
    """(keys, <measure>_<share> ...): exact percentiles of several measures of the same rows, as ``exact_percentiles`` finds them, in one pass for all measures.

    The measures' values are written once and read three times.  A group without values has no row.
    """
    each = F.array(*[F.struct(F.lit(name).alias("measure"), value.cast("double").alias("x")) for name, value in measures.items()])
    values = written(rows.select(*keys, F.explode(each).alias("m")).select(*keys, "m.measure", "m.x").where("x is not null"), "measures")
    found = exact_percentiles(values, [*keys, "measure"], "x", shares)
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("measure") == name, F.col(share))).alias(f"{name}_{share}") for name in measures for share in shares])


def beside(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``a`` with the columns of ``b`` for the same keys (null to null), which both have; without keys ``b`` has one row."""
    other = b.withColumnsRenamed({k: f"r_{k}" for k in keys})
    return a.join(other, [a[k].eqNullSafe(other[f"r_{k}"]) for k in keys] or [F.lit(True)], "left").drop(*[f"r_{k}" for k in keys])
