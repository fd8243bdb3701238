"""Summaries of five-minute metric buckets; a bucket is never taken for a request."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.measures import state_of, total_of, total_state

MEASURES = ["input_tokens", "cached_tokens", "output_tokens", "requests", "successful_requests", "throttled_requests", "failed_requests"]


def is_active() -> Column:
    """Whether a bucket has volume or requests."""
    value = lambda n: F.coalesce(F.col(n), F.lit(0))
    return (value("input_tokens") + value("output_tokens") > 0) | (value("requests") > 0)


def outcome_coverage() -> Column:
    """Aggregate: ``complete`` if all buckets are, ``partial`` if some outcome is known, else ``unavailable``."""
    state = F.coalesce(F.col("outcome_coverage"), F.lit("unavailable"))
    some = F.bool_or(state.isin("complete", "partial")) | (F.count("successful_requests") > 0) | (F.count("throttled_requests") > 0)
    return F.when(F.bool_and(state == "complete"), "complete").when(some, "partial").otherwise("unavailable")


def bucket_summary(buckets: DataFrame, keys: Sequence[str] = (), minutes: int = 5, expected: int | None = None) -> DataFrame:
    """Sums, states, outcomes and the four counts of buckets (elapsed, observed, active, idle) by ``keys``.

    ``bucket`` is the start in epoch seconds.  Elapsed buckets are ``expected``, else the span between first and last.
    """
    seconds = minutes * 60
    out = buckets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("metric_buckets_read"),
        *[F.sum(m).alias(m) for m in MEASURES],
        *[state_of(F.col(m)).alias(f"{m}_state") for m in MEASURES[:3]],
        outcome_coverage().alias("outcomes"),
        F.count_distinct("bucket").alias("observed_buckets"),
        F.count_distinct(F.when(is_active(), F.col("bucket"))).alias("active_buckets"),
        F.count_distinct(F.when(is_active(), F.floor(F.col("bucket") / 86400))).alias("active_days"),
        F.count_distinct(F.floor(F.col("bucket") / 86400)).alias("observed_days"),
        F.min("bucket").alias("first_bucket"),
        F.max("bucket").alias("last_bucket"),
        F.count("average_latency_ms").alias("with_latency"),
    )
    no_cache = (F.col("cached_tokens_state") == "unavailable") & (F.col("input_tokens") < 1024)
    known = F.col("outcomes") != "unavailable"
    span = (F.floor((F.col("last_bucket") - F.col("first_bucket")) / seconds) + 1).cast("long")
    return out.select(
        *keys,
        "metric_buckets_read",
        (F.lit(expected).cast("long") if expected else span).alias("elapsed_buckets"),
        "observed_buckets",
        "active_buckets",
        F.greatest(F.lit(0), F.col("observed_buckets") - F.col("active_buckets")).alias("idle_buckets"),
        "active_days",
        "observed_days",
        F.col("requests").alias("requests_observed"),
        *[F.when(known, F.col(m)).alias(n) for m, n in (("successful_requests", "successful_requests"), ("throttled_requests", "rate_limited_requests"), ("failed_requests", "failed_requests"))],
        F.col("outcomes").alias("outcome_coverage"),
        "input_tokens",
        F.when(no_cache, F.lit(0)).otherwise(F.col("cached_tokens")).alias("cached_tokens"),
        "output_tokens",
        total_of(F.col("input_tokens"), F.col("output_tokens")).alias("total_tokens"),
        "input_tokens_state",
        F.when(no_cache, "measured").otherwise(F.col("cached_tokens_state")).alias("cached_tokens_state"),
        "output_tokens_state",
        total_state(F.col("input_tokens_state"), F.col("output_tokens_state")).alias("total_tokens_state"),
        F.round(F.col("with_latency") / F.col("metric_buckets_read") * 100, 1).alias("latency_coverage_percent"),
    )


def field_coverage(summary: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Which fields a bucket source has given; retries never."""
    return summary.select(
        *keys,
        F.col("input_tokens").isNotNull().alias("input_tokens"),
        F.col("cached_tokens").isNotNull().alias("cached_tokens"),
        F.col("output_tokens").isNotNull().alias("output_tokens"),
        F.col("requests_observed").isNotNull().alias("requests"),
        (F.col("outcome_coverage") != "unavailable").alias("request_outcomes"),
        (F.col("latency_coverage_percent") > 0).alias("latency"),
        F.lit(False).alias("retries"),
    )


def bucket_gaps(buckets: DataFrame, keys: Sequence[str], minutes: int = 5, largest: int = 200) -> DataFrame:
    """Runs of missing buckets between a slice's first and last: start, length, and their number in the slice (at most ``largest`` are listed)."""
    seconds = minutes * 60
    order = Window.partitionBy(*keys).orderBy("slot")
    slots = buckets.select(*keys, (F.col("bucket") / seconds).cast("long").alias("slot")).distinct()
    gaps = slots.withColumn("before", F.lag("slot").over(order)).where(F.col("slot") > F.col("before") + 1)
    gaps = gaps.select(*keys, ((F.col("before") + 1) * seconds).alias("gap_start"), (F.col("slot") - F.col("before") - 1).alias("missing_buckets"))
    every = Window.partitionBy(*keys)
    return gaps.withColumns({"gap_number": F.row_number().over(every.orderBy("gap_start")), "gaps": F.count(F.lit(1)).over(every)}).where(F.col("gap_number") <= largest)


def day_coverage(buckets: DataFrame, keys: Sequence[str], minutes: int = 5) -> DataFrame:
    """Days of each slice's calendar (first to last day): complete, partial, missing."""
    per_day = 1440 // minutes
    days = buckets.select(*keys, "bucket").distinct().groupBy(*keys, F.floor(F.col("bucket") / 86400).cast("long").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    calendar = days.groupBy(*keys).agg(F.min("day").alias("a"), F.max("day").alias("z")).select(*keys, F.explode(F.sequence("a", "z")).alias("day"))
    joined = calendar.join(days, [*keys, "day"], "left")
    return joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("days"), F.count_if(F.col("n") >= per_day).alias("days_complete"), F.count_if((F.col("n") > 0) & (F.col("n") < per_day)).alias("days_partial"), F.count_if(F.col("n").isNull()).alias("days_missing"))


def pivot_points(points: DataFrame, keys: Sequence[str] = ("ts", "deployment_name")) -> DataFrame:
    """Long metric points (field, signature, value, kind) to wide buckets.

    A series that comes twice (same field, signature, time and deployment) counts once.  Counters are summed over other
    dimensions; averages keep the first by signature; status codes become outcome counts and a map.
    """
    once = points.where(F.col("value").isNotNull()).groupBy("field", "signature", *keys, "kind", "status_code").agg(F.min("value").alias("value"))
    counter = lambda name: F.sum(F.when(F.col("field") == name, F.col("value"))).cast("long").alias(name)
    first = lambda name: F.min_by(F.when(F.col("field") == name, F.col("value")), F.when(F.col("field") == name, F.col("signature"))).alias(name)
    code, requests = F.col("status_code"), F.col("field") == "requests"
    outcome = lambda cond, name: F.sum(F.when(requests & code.isNotNull() & cond, F.col("value"))).cast("long").alias(name)
    return once.groupBy(*keys).agg(
        *[counter(n) for n in ("input_tokens", "cached_tokens", "output_tokens", "requests")],
        first("average_latency_ms"),
        outcome(code.between(200, 399), "successful_requests"),
        outcome(code == 429, "throttled_requests"),
        outcome(~code.between(200, 399) & (code != 429), "failed_requests"),
    )


def merge_chunks(chunks: Sequence[DataFrame]) -> DataFrame:
    """Union of collection chunks, the first chunk's row for each (bucket, deployment); what is active is counted after that."""
    tagged = [c.withColumn("chunk", F.lit(i)) for i, c in enumerate(chunks)]
    out = tagged[0]
    for more in tagged[1:]:
        out = out.unionByName(more)
    first = F.row_number().over(Window.partitionBy("bucket", "deployment_name").orderBy("chunk"))
    return out.withColumn("nth", first).where("nth = 1").drop("nth", "chunk")


def insights(summary: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Operational insights from bucket summaries: (insight_id, category, priority, materiality, value), in order of priority and id."""
    n, limited, failed = F.col("requests_observed"), F.col("rate_limited_requests"), F.col("failed_requests")
    some, total = n > 0, F.col("total_tokens")
    other = F.greatest(F.lit(0), failed - F.coalesce(limited, F.lit(0)))
    rate, loss = limited / n * 100, other / n * 100
    null = F.lit(None).cast("double")
    rules = [
        ("AGG-COVERAGE", "data_quality", 0, (F.col("elapsed_buckets") > 0) & (F.col("observed_buckets") < F.col("elapsed_buckets")), F.lit("material"), F.round(F.col("observed_buckets") / F.col("elapsed_buckets") * 100, 1)),
        ("AGG-RATE-LIMIT", "reliability", 1, some & (limited > 0) & (rate >= 5), F.when(rate >= 10, "material").otherwise("advisory"), F.round(rate, 1)),
        ("AGG-FAILURE-RATE", "reliability", 1, some & (other > 0), F.when(loss >= 10, "material").otherwise("advisory"), F.round(loss, 1)),
        ("AGG-TOKENS-PER-REQUEST", "token_efficiency", 2, some & total.isNotNull(), F.lit("observation"), F.round(total / n, 2)),
        ("AGG-NATIVE-USAGE-GAP", "data_quality", 1, some & total.isNull(), F.lit("observation"), null),
        ("AGG-CACHED-TOKEN-GAP", "pricing_readiness", 2, (F.col("cached_tokens_state") == "unavailable") & total.isNotNull(), F.lit("observation"), null),
        ("AGG-OUTCOME-GAP", "data_quality", 1, some & (F.col("outcome_coverage") == "unavailable"), F.lit("observation"), null),
        ("DQ-LATENCY-GAP", "data_quality", 1, some & (F.col("latency_coverage_percent") == 0), F.lit("observation"), null),
    ]
    each = F.array(*[F.when(cond, F.struct(F.lit(i).alias("insight_id"), F.lit(c).alias("category"), F.lit(p).alias("priority"), m.alias("materiality"), v.cast("double").alias("value"))) for i, c, p, cond, m, v in rules])
    return summary.select(*keys, F.explode(F.array_compact(each)).alias("i")).select(*keys, "i.*")
