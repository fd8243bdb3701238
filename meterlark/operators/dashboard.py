"""One row a deployment for the capacity dashboard: eligibility, state, blockers, usage and coverage; and the portfolio's counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import known_model, publisher_of

BUCKET_SECONDS = 300


def partial_day(day: Column, start: Column, end: Column) -> Column:
    """FLT13: whether a window (timestamps) leaves out part of a day; a window that isn't known does."""
    begins = day.cast("timestamp")
    last = begins + F.make_dt_interval(days=F.lit(1)) - F.make_dt_interval(secs=F.lit(BUCKET_SECONDS))
    return F.coalesce((start > begins) | (end < last), F.lit(True))


def dashboard_state(eligibility: Column, recommendation: Column, identified: Column, enough: Column) -> Column:
    """CAP4: the first of these that holds is the headline; capacity and pricing come behind identity and evidence."""
    return (
        F.when(~identified, "collection_identity_error")
        .when(eligibility == "ptu_not_applicable", "ptu_not_applicable")
        .when(~enough, "insufficient_evidence")
        .when(eligibility == "model_capacity_unavailable", "capacity_unavailable")
        .when(eligibility == "pricing_unavailable", "pricing_unavailable")
        .when(eligibility.isin("eligible_insufficient_evidence", "deployment_mode_unavailable"), "insufficient_evidence")
        .when(recommendation == "PTU recommended", "ptu_recommended")
        .when(recommendation == "Borderline", "borderline")
        .when(recommendation == "PAYG recommended", "payg_recommended")
        .otherwise("insufficient_evidence")
    )


def usage_days(buckets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AGG29, AGG30: by ``keys`` what the buckets (bucket in epoch seconds) add up to, with days that are complete and partial.

    The 429 rate is given only if the throttled requests and the requests they are part of come from the same buckets.
    """
    known = F.col("outcome_coverage") != "unavailable"
    tokens = F.col("input_tokens") + F.col("output_tokens")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("bucket") / 86400).cast("int"))
    busy = (F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0)) > 0) | (F.coalesce("requests", F.lit(0)) > 0)
    slots = buckets.groupBy(*keys, day.alias("day"), "bucket").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("requests").alias("requests"), F.sum(F.when(known, F.col("throttled_requests"))).alias("throttled"), F.sum(F.when(known, F.col("requests"))).alias("base"),
        F.sum(F.when(known, F.col("successful_requests"))).alias("successful"), F.sum(F.when(known, F.col("failed_requests"))).alias("failed"), F.bool_or(busy).alias("busy"), F.bool_and(tokens.isNotNull()).alias("whole"),
    )
    days = slots.groupBy(*keys, "day").agg(
        F.min("bucket").alias("first"), F.max("bucket").alias("last"), F.count(F.lit(1)).alias("buckets"), F.count_if("busy").alias("busy"), F.count_if("whole").alias("whole"), F.sum(F.when(F.col("whole"), F.col("input_tokens") + F.col("output_tokens"))).alias("tokens"),
        *[F.sum(c).alias(c) for c in ("requests", "throttled", "base", "successful", "failed")],
    )
    window = days.groupBy(*keys).agg(F.timestamp_seconds(F.min("first")).alias("window_start"), F.timestamp_seconds(F.max("last") + BUCKET_SECONDS).alias("window_end"))
    marked = days.join(window, list(keys)).withColumn("partial", partial_day(F.col("day"), F.col("window_start"), F.col("window_end")))
    counted = F.col("whole") > 0
    out = marked.groupBy(*keys).agg(
        F.min("window_start").alias("window_start"), F.max("window_end").alias("window_end"), F.sum("requests").alias("total_requests"), F.sum("throttled").alias("rate_limited_requests"), F.sum("base").alias("base"), F.sum("successful").alias("successful_requests"), F.sum("failed").alias("other_failed_requests"),
        F.count_if(F.col("busy") > 0).alias("active_days"), F.count_if(counted & ~F.col("partial")).alias("complete_days"), F.count_if(counted & F.col("partial")).alias("partial_days"), F.sum("tokens").alias("tokens"), F.count_if(counted).alias("token_days"), F.sum("busy").alias("active_buckets"), (F.sum("whole") == F.sum("buckets")).alias("all_whole"),
    )
    rate = F.when((F.col("base") > 0) & (F.col("rate_limited_requests") <= F.col("base")), F.round(F.col("rate_limited_requests") / F.col("base") * 100, 2))
    return out.withColumns({"rate_limit_percent": rate, "daily_average_tokens": F.when(F.col("all_whole"), F.round(F.col("tokens") / F.col("token_days"), 1)), "smoke_test_window": (F.col("active_buckets") < 5) & (F.col("total_requests") <= 10)}).drop("base", "tokens", "token_days", "all_whole")


def assessments(rows: DataFrame) -> DataFrame:
    """CAP1, CAP4, J21: ``rows`` (one a deployment) with publisher, eligibility_status, recommendation, state and secondary_blockers.

    Needs model_name, deployment_mode, active_buckets, input_tokens_state, output_tokens_state, pricing_status, ptu_eligible,
    quota (null: no capacity row) and recommendation (of ``capacity.dimensions``).  Deployments carry their own key, so
    nothing is joined to records again.
    """
    identified, mode = known_model(F.col("model_name")), F.lower(F.col("deployment_mode"))
    whole = (F.col("input_tokens_state") == "measured") & (F.col("output_tokens_state") == "measured")
    enough = (F.col("active_buckets") >= fixed.ADVISOR_ACTIVE_BUCKETS) & whole
    barred = F.coalesce(~F.col("ptu_eligible"), F.lit(False))
    publisher = publisher_of(F.col("model_name"))
    no_capacity = F.col("quota").isNull()
    other = F.coalesce((publisher != "") & (publisher != "microsoft"), F.lit(False))
    eligibility = (
        F.when(~identified, "collection_identity_error").when(barred, "ptu_not_applicable").when(no_capacity & other, "ptu_not_applicable").when(no_capacity, "model_capacity_unavailable")
        .when(~mode.isin("global", "regional"), "deployment_mode_unavailable").when(~enough, "eligible_insufficient_evidence").when(F.col("pricing_status") != "priced", "pricing_unavailable").otherwise("eligible_sufficient_evidence")
    )
    recommendation = F.when(~identified, "Collection identity error").when(barred, "PTU not applicable").when(no_capacity & other, "PTU not applicable").otherwise(F.col("recommendation"))
    out = rows.withColumns({"publisher": publisher, "eligibility_status": eligibility, "recommendation": recommendation, "sufficient_evidence": enough})
    applies = F.col("eligibility_status") != "ptu_not_applicable"
    blockers = F.array_compact(
        F.array(
            F.when(no_capacity & identified & applies, "Capacity data required"), F.when(~mode.isin("global", "regional") & applies, "Deployment mode unconfirmed"), F.when(~whole & applies, "Token usage data required"), F.when((F.col("pricing_status") != "priced") & applies, "Pricing required")
        )
    )
    return out.withColumns({"state": dashboard_state(F.col("eligibility_status"), F.col("recommendation"), identified, F.col("sufficient_evidence")), "secondary_blockers": blockers})


def portfolio(assessed: DataFrame) -> DataFrame:
    """AGG31: how many deployments have which recommendation."""
    r = F.col("recommendation")
    return assessed.agg(
        F.count_if(r == "PTU recommended").alias("recommended_deployments"), F.count_if(r == "Borderline").alias("borderline_deployments"), F.count_if(r == "PAYG recommended").alias("payg_deployments"),
        F.count_if(r.isin("Insufficient evidence", "Capacity data required", "PTU not applicable", "Collection identity error")).alias("insufficient_deployments"),
    )
