"""Provisioned against pay-as-you-go capacity, by deployment, from five-minute usage.

Series are gap-filled by deployment: at most 90 days of five minutes (25,920 rows) each, a bound that holds at any
volume, so ordered windows by deployment stay small while deployments spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import fixed
from ..functions.quantiles import counted_broadcast, exact_percentiles

MINUTES, LOOKBACK_DAYS = 5, 90
MONTH_MINUTES = 43_200


def capacities(spark: SparkSession) -> DataFrame:
    """J11: capacity rows by canonical model."""
    return spark.createDataFrame(fixed.CAPACITIES, "canonical string, quota long, tpm_per_unit long, output_ratio int, global_least int, global_step int, regional_least int, regional_step int")


def usage_buckets(rows: DataFrame, keys: Sequence[str], requests: Column | None = None) -> DataFrame:
    """CAP7, AGG27, STR7: (keys, slot, input, output, requests) by five minutes; rows are requests unless ``requests`` says how many each holds."""
    slot = F.floor(F.unix_seconds("ts") / (MINUTES * 60)).cast("long")
    n = F.lit(1) if requests is None else F.coalesce(requests, F.lit(0))
    value = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.where("ts is not null").groupBy(*keys, slot.alias("slot")).agg(F.sum(value("input_tokens")).alias("input"), F.sum(value("output_tokens")).alias("output"), F.sum(n).alias("requests"))


def series(buckets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """WIN8, CAP5: the last 90 days with missing slots as zero, tokens a minute, and whether a slot was observed or active."""
    every = Window.partitionBy(*keys)
    kept = buckets.withColumn("last", F.max("slot").over(every)).where(F.col("slot") >= F.col("last") - LOOKBACK_DAYS * 1440 // MINUTES).drop("last")
    calendar = kept.groupBy(*keys).agg(F.min("slot").alias("a"), F.max("slot").alias("z")).select(*keys, F.explode(F.sequence("a", "z")).alias("slot"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return calendar.join(kept, [*keys, "slot"], "left").select(
        *keys, "slot", (zero("input") / MINUTES).alias("input_tpm"), (zero("output") / MINUTES).alias("output_tpm"), ((zero("input") + zero("output")) / MINUTES).alias("tpm"), F.col("requests").isNotNull().alias("observed"), ((zero("input") + zero("output") > 0) | (zero("requests") > 0)).alias("active")
    )


def series_shape(points: DataFrame, keys: Sequence[str], day: int = 288, week: int = 2016) -> DataFrame:
    """STA1 to STA3, PCT3: counts, mean, p95, population CV, sustained share and lagged similarity of each series."""
    order = Window.partitionBy(*keys).orderBy("slot")
    whole = Window.partitionBy(*keys)
    rows = points.withColumns({"back_day": F.lag("tpm", day).over(order), "back_week": F.lag("tpm", week).over(order), "peak": F.max("tpm").over(whole)})

    def similarity(back: str, lag: int) -> Column:
        both = F.stddev_pop(F.when(F.col(back).isNotNull(), F.col("tpm"))) * F.stddev_pop(back)
        r = F.covar_pop("tpm", back) / F.nullif(both, F.lit(0.0))
        return F.when(F.count(F.lit(1)) < 2 * lag, F.lit(None)).when(r.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), r))

    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("elapsed"),
        F.count_if("observed").alias("observed"),
        F.count_if("active").alias("active"),
        F.round(F.avg("tpm"), 6).alias("average_tpm"),
        F.round(F.percentile("tpm", F.lit(0.95)), 6).alias("p95_tpm"),
        F.round(F.when(F.avg("tpm") > 0, F.stddev_pop("tpm") / F.avg("tpm")).otherwise(0.0), 6).alias("cv"),
        F.round(F.when(F.max("peak") > 0, F.avg((F.col("tpm") >= F.col("peak") * 0.3).cast("double"))).otherwise(0.0), 6).alias("sustained"),
        F.round(similarity("back_day", day), 6).alias("daily_similarity"),
        F.round(similarity("back_week", week), 6).alias("weekly_similarity"),
    )


def latency_shape(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Latency percentiles (of any number of requests) and the throttled ones."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status_code") == 429).alias("throttled"))
    shares = exact_percentiles(rows, keys, "latency_ms", {"p50_latency": 0.5, "p95_latency": 0.95, "p99_latency": 0.99})
    return counts.join(shares, list(keys), "left").select(*keys, "requests", "throttled", *[F.round(n, 6).alias(n) for n in ("p50_latency", "p95_latency", "p99_latency")])


def dimensions(shape: DataFrame, latency: DataFrame, keys: Sequence[str], quota: str = "quota") -> DataFrame:
    """CAP2, CAP3: four verdicts and the recommendation; ``shape`` has the capacity's quota (null: no capacity row)."""
    rows = shape.join(latency, list(keys), "left")
    enough = F.col("active") >= fixed.ADVISOR_ACTIVE_BUCKETS
    rate = F.when((F.col("requests") > 0) & (F.col("throttled") <= F.col("requests")), F.col("throttled") / F.col("requests"))
    use = F.when(F.col(quota) > 0, F.col("p95_tpm") / F.col(quota)).otherwise(0.0)
    likeness = F.greatest(F.lit(0.5), F.coalesce("daily_similarity", F.lit(0.0)), F.coalesce("weekly_similarity", F.lit(0.0)))
    ratio = F.when(F.col("p50_latency") > 0, F.col("p99_latency") / F.col("p50_latency")).otherwise(0.0)
    p95 = F.coalesce("p95_latency", F.lit(0.0))
    verdict = lambda missing, good, bad: F.when(~enough | missing, "insufficient").when(good, "positive").when(bad, "negative").otherwise("neutral")
    out = rows.withColumns(
        {
            "workload_shape": verdict(F.lit(False), F.col("cv") < 0.3, F.col("cv") > 0.7),
            "capacity_pressure": verdict(rate.isNull(), (rate > 0.05) | (use > 0.85), (rate < 0.01) & (use < 0.5)),
            "latency_sensitivity": verdict(F.col("p50_latency").isNull(), (p95 > 5000) | (ratio > 4), (p95 < 2000) & (ratio < 2)),
            "load_predictability": verdict(F.lit(False), (F.col("sustained") >= 0.6) & (likeness >= 0.7), F.col("sustained") < 0.3),
        }
    )
    four = F.array("workload_shape", "capacity_pressure", "latency_sensitivity", "load_predictability")
    count = lambda v: F.size(F.filter(four, lambda x: x == v))
    advice = F.when(F.col(quota).isNull(), "Capacity data required").when(count("insufficient") >= 2, "Insufficient evidence").when(count("positive") >= 3, "PTU recommended").when(count("positive") >= 2, "Borderline").otherwise("PAYG recommended")
    return out.select(*keys, "workload_shape", "capacity_pressure", "latency_sensitivity", "load_predictability", F.round(rate, 6).alias("throttle_rate"), advice.alias("recommendation"))


def sweep(points: DataFrame, plans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SRT10, CAP1: the number of units with the least hybrid cost (fewer units among equals), with its economics.

    ``plans`` has keys, tpm_per_unit, output_ratio, least, step, hourly_rate, blended (dollars per million tokens).  A
    series and its candidate capacities are put in one order and summed from the top, so each slot is met once; a series
    is at most 90 days of five minutes.
    """
    rows = points.join(counted_broadcast(plans), list(keys)).withColumn("weighted", F.col("input_tpm") + F.col("output_ratio") * F.col("output_tpm"))
    facts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile("weighted", F.lit(0.95)).alias("p95"), F.max("weighted").alias("peak"), F.avg("tpm").alias("mean_tpm"))
    facts = plans.join(facts, list(keys))
    units = lambda c: F.ceil(F.col(c) * 1.2 / F.col("tpm_per_unit") / F.col("step")).cast("long") * F.col("step")
    facts = facts.withColumn("p95_units", F.greatest(F.col("least").cast("long"), units("p95"))).withColumn("upper", F.greatest("p95_units", F.col("least").cast("long"), units("peak")))
    grid = facts.select(*keys, "tpm_per_unit", F.explode(F.sequence(F.col("least").cast("long"), F.col("upper"), F.col("step").cast("long"))).alias("units"))
    # what is over a capacity: slots and capacities in one order, sums from the top down
    slots = rows.where("weighted > 0").select(*keys, F.col("weighted").alias("x"), F.lit(None).cast("long").alias("units"), F.col("weighted").alias("w"), F.lit(1).alias("one"))
    marks = grid.select(*keys, (F.col("units") * F.col("tpm_per_unit")).cast("double").alias("x"), "units", F.lit(0.0).alias("w"), F.lit(0).alias("one"))
    above = Window.partitionBy(*keys).orderBy(F.desc("x"), F.col("one").asc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = slots.unionByName(marks).withColumns({"sum_over": F.sum("w").over(above), "slots_over": F.sum("one").over(above)}).where("units is not null")
    over = over.select(*keys, "units", (F.col("sum_over") - F.col("slots_over") * F.col("x")).alias("overflow"), "slots_over")
    grid = grid.drop("tpm_per_unit")
    reserved = F.col("units") * F.col("hourly_rate") * 720 * 0.35
    cost = reserved + F.coalesce("overflow", F.lit(0.0)) / F.col("n") * MONTH_MINUTES / 1_000_000 * F.col("blended")
    priced = grid.join(over, [*keys, "units"], "left").join(facts, list(keys)).withColumns({"reserved": reserved, "hybrid": cost})
    best = priced.groupBy(*keys).agg(F.min_by(F.struct("units", "reserved", "hybrid", F.coalesce("slots_over", F.lit(0)).alias("over"), "n", "p95_units", "mean_tpm", "blended", "tpm_per_unit", "hourly_rate"), F.struct(F.round("hybrid", 9).alias("h"), "units")).alias("b")).select(*keys, "b.*")
    payg = F.col("mean_tpm") * MONTH_MINUTES / 1_000_000 * F.col("blended")
    even = F.when(F.col("blended") > 0, F.col("reserved") * 1_000_000 / (MONTH_MINUTES * F.col("blended")))
    return best.select(
        *keys,
        F.col("p95_units"),
        F.col("units").alias("suggested_units"),
        (F.col("units") * F.col("tpm_per_unit")).alias("capacity_tpm"),
        F.round("reserved", 4).alias("reserved_monthly"),
        F.round(F.col("units") * F.col("hourly_rate") * 720, 4).alias("hourly_monthly"),
        F.round("hybrid", 6).alias("hybrid_monthly"),
        F.round(payg, 6).alias("payg_monthly"),
        F.round(F.col("over") / F.col("n") * 100, 4).alias("spillover_percent"),
        F.round(F.when(even <= F.col("units") * F.col("tpm_per_unit"), even), 4).alias("break_even_tpm"),
        F.when(F.round("hybrid", 9) < F.round(payg, 9), "PTU lower").otherwise("PAYG lower").alias("economic_result"),
    )


def cost_curve(chosen: DataFrame, keys: Sequence[str], steps: int = 60) -> DataFrame:
    """CAP6, WIN10: points of the pay-as-you-go and hybrid lines, and where they cross.

    ``chosen`` has keys, peak, average_tpm, capacity_tpm, reserved_monthly, blended.
    """
    rate = F.lit(MONTH_MINUTES) / 1_000_000 * F.col("blended")
    top = F.greatest("peak", F.col("capacity_tpm").cast("double"), "average_tpm", F.lit(1.0)) * 1.2
    rows = chosen.withColumns({"rate": rate, "top": top}).select("*", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("i"))
    x = F.col("top") * F.col("i") / steps
    rows = rows.withColumn("x", x).withColumns({"payg": F.col("x") * F.col("rate"), "hybrid": F.col("reserved_monthly") + F.greatest(F.lit(0.0), F.col("x") - F.col("capacity_tpm")) * F.col("rate")}).withColumn("gap", F.col("hybrid") - F.col("payg"))
    order = Window.partitionBy(*keys).orderBy("i")
    before, at = F.lag("gap").over(order), F.lag("x").over(order)
    rows = rows.withColumns({"gap_before": before, "x_before": at})
    part = F.abs("gap_before") / (F.abs("gap_before") + F.abs("gap"))
    cross = F.when(F.col("gap_before") == 0, F.col("x_before")).when((F.col("gap_before") < 0) != (F.col("gap") < 0), F.col("x_before") + part * (F.col("x") - F.col("x_before")))
    return rows.select(*keys, "i", F.round("x", 2).alias("sustained_tpm"), F.round("payg", 4).alias("payg_monthly"), F.round("hybrid", 4).alias("hybrid_monthly"), F.round(cross, 2).alias("crossing_tpm"))


def confidence(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """STA5, STA6: score of the evidence and its label.

    ``rows`` has keys, active, observed, elapsed, observed_days, outcome_share, latency_share, pricing_share,
    identity_known, capacity_known, mode_known.
    """
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    flag = lambda c: F.when(F.col(c), 1.0).otherwise(0.0)
    scores = {
        "active": unit(F.col("active") / fixed.ADVISOR_ACTIVE_BUCKETS),
        "lookback": unit(F.col("observed_days") / 7),
        "completeness": F.when(F.col("elapsed") > 0, unit(F.col("observed") / F.col("elapsed"))).otherwise(0.0),
        "outcomes": unit(F.col("outcome_share")),
        "latency": unit(F.col("latency_share")),
        "pricing": unit(F.col("pricing_share")),
        "identity": flag("identity_known"),
        "capacity": flag("capacity_known"),
        "mode": flag("mode_known"),
    }
    total = sum((F.lit(w) * scores[k] for k, w in fixed.CONFIDENCE_WEIGHTS.items()), F.lit(0.0))
    score = F.round(total * 100, 1)
    label = F.when(score >= 90, "High confidence").when(score >= 70, "Moderate confidence").when(score >= 50, "Low confidence").otherwise("Insufficient evidence")
    return rows.select(*keys, score.alias("confidence_score"), label.alias("confidence_label"))
