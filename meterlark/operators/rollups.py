"""Usage and cost by slice: portfolio, deployment, model, workload, day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import merged_state, percent, state_of, total_of, total_state
from ..functions.text import canonical_model, known_model, one_or_mixed, only_value


def known_tokens() -> Column:
    """Input and output of a row, what isn't measured as zero."""
    return F.coalesce(F.col("input_tokens"), F.lit(0)) + F.coalesce(F.col("output_tokens"), F.lit(0))


def cost_aggregates(cost: str, prefix: str) -> list[Column]:
    """Aggregates over the resolutions in column ``cost``; names begin with ``prefix``."""
    c = F.col(cost)
    ok = c["resolved"] & c["cost_usd"].isNotNull()
    whole = F.bool_and(F.when(ok, c["fresh_cost"].isNotNull() & c["cached_cost"].isNotNull() & c["output_cost"].isNotNull()))
    part = lambda name: F.when(whole, F.sum(F.when(ok, c[name])))
    texts = lambda name: F.array_sort(F.array_compact(F.collect_set(F.when(~ok, c[name]))))
    named = {
        "estimated_cost_usd": F.sum(F.when(ok, c["cost_usd"])),
        "fresh_input_cost_usd": part("fresh_cost"),
        "cached_input_cost_usd": part("cached_cost"),
        "output_cost_usd": part("output_cost"),
        "resolved": F.count_if(ok),
        "resolved_tokens": F.coalesce(F.sum(F.when(ok, known_tokens())), F.lit(0)),
        "unresolved_requests": F.count_if(~ok),
        "unresolved_tokens": F.coalesce(F.sum(F.when(~ok, known_tokens())), F.lit(0)),
        "pricing_source": F.coalesce(one_or_mixed(F.when(ok, c["source"])), F.lit("unresolved")),
        "pricing_catalog_name": one_or_mixed(F.when(ok, c["catalog"])),
        "pricing_effective_from": one_or_mixed(F.when(ok, c["effective_from"])),
        "pricing_billing_basis": one_or_mixed(F.when(ok, c["billing_basis"])),
        "pricing_publisher": one_or_mixed(F.when(ok, c["publisher"])),
        "pricing_confidence": one_or_mixed(F.when(ok, c["confidence"])),
        "input_price_per_million": only_value(F.when(ok, c["input_rate"])),
        "cached_input_price_per_million": only_value(F.when(ok, c["cached_rate"])),
        "output_price_per_million": only_value(F.when(ok, c["output_rate"])),
        "unresolved_reasons": texts("reason"),
        "suggested_override_keys": texts("override_key"),
    }
    return [v.alias(prefix + k) for k, v in named.items()]


COSTS = ["estimated_cost_usd", "fresh_input_cost_usd", "cached_input_cost_usd", "output_cost_usd", "resolved", "resolved_tokens", "unresolved_requests", "unresolved_tokens", "pricing_source", "pricing_catalog_name", "pricing_effective_from", "pricing_billing_basis", "pricing_publisher", "pricing_confidence", "input_price_per_million", "cached_input_price_per_million", "output_price_per_million", "unresolved_reasons", "suggested_override_keys"]
CACHE_NEEDS = 1024


def pricing_status(reasons: Column, cost: Column, unresolved: Column, token_coverage: Column, identified: Column) -> Column:
    """Why a slice is or isn't priced, the first that holds."""
    return (
        F.when(~identified, "identity_unresolved")
        .when(F.array_contains(reasons, "currency-conversion-required"), "currency_mismatch")
        .when(cost.isNull() & F.exists(reasons, lambda r: F.startswith(r, F.lit("usage-metrics-unavailable:"))), "usage_incomplete")
        .when(unresolved > 0, "partial")
        .when(cost.isNull(), "catalog_missing")
        .when(token_coverage < 100, "partial")
        .otherwise("priced")
    )


def slice_summary(priced: DataFrame, keys: Sequence[str], digits: int = 6) -> DataFrame:
    """Usage, states, costs and coverage of request traces by ``keys`` (none: one row), in one aggregation.

    If a slice's input is wholly measured and below 1,024 tokens no prompt can have been cached, so unmeasured cached
    input counts as zero there; both readings are aggregated and the slice picks one.
    """
    sums = [
        F.count(F.lit(1)).alias("requests"),
        *[F.sum(m).alias(m) for m in ("input_tokens", "cached_tokens", "output_tokens")],
        *[state_of(F.col(m)).alias(f"{m}_state") for m in ("input_tokens", "cached_tokens", "output_tokens")],
        F.count("input_tokens").alias("with_input"),
        F.sum(known_tokens()).alias("all_tokens"),
        F.count_if(F.col("retry_of").isNotNull() & (F.col("retry_of") != "")).alias("retries"),
        F.round(F.avg("latency_ms"), 1).alias("average_latency_ms"),
        F.bool_or(known_model(F.col("model_name"))).alias("identified"),
        F.when(F.min("service_tier") == F.max("service_tier"), F.min("service_tier")).otherwise("mixed").alias("service_tier"),
    ]
    out = priced.groupBy(*keys).agg(*sums, *cost_aggregates("cost", "a_"), *cost_aggregates("cost_no_cache", "b_"))
    low = (F.col("with_input") == F.col("requests")) & (F.col("input_tokens") < CACHE_NEEDS)
    out = out.withColumns({name: F.when(low, F.col("b_" + name)).otherwise(F.col("a_" + name)) for name in COSTS})
    measured = (F.col("input_tokens_state") == "measured") & (F.col("output_tokens_state") == "measured")
    out = out.withColumns(
        {
            "total_tokens": total_of(F.col("input_tokens"), F.col("output_tokens")),
            "total_tokens_state": total_state(F.col("input_tokens_state"), F.col("output_tokens_state")),
            "average_tokens_per_request": F.when(measured, F.round((F.col("input_tokens") + F.col("output_tokens")) / F.col("requests"), 1)),
            "pricing_coverage_requests_percent": percent(F.col("resolved"), F.col("requests")),
            "pricing_coverage_tokens_percent": percent(F.col("resolved_tokens"), F.col("all_tokens")),
            "pricing_complete": (F.col("resolved") == F.col("requests")) & (F.col("resolved_tokens") == F.col("all_tokens")),
        }
        | {name: F.round(name, digits) for name in ("estimated_cost_usd", "fresh_input_cost_usd", "cached_input_cost_usd", "output_cost_usd")}
    )
    status = pricing_status(F.col("unresolved_reasons"), F.col("estimated_cost_usd"), F.col("unresolved_requests"), F.col("pricing_coverage_tokens_percent"), F.col("identified"))
    drop = [c for c in out.columns if c[:2] in ("a_", "b_")] + ["with_input", "all_tokens", "resolved", "resolved_tokens", "identified"]
    return out.withColumn("pricing_status", status).drop(*drop)


DEPLOYMENT = ["deployment_name", "model_name", "deployment_mode"]


def deployment_rollup(priced: DataFrame, keys: Sequence[str] = DEPLOYMENT) -> DataFrame:
    """``slice_summary`` by deployment with each slice's share of requests and tokens.  Totals are an aggregation of their own, so no window gathers the slices."""
    out = slice_summary(priced, keys)
    tokens = F.coalesce(F.sum(F.when(F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull(), known_tokens())), F.lit(0))
    whole = priced.agg(F.count(F.lit(1)).alias("rl_requests"), tokens.alias("rl_tokens"))
    shares = {"request_share_percent": percent(F.col("requests"), F.col("rl_requests")), "token_share_percent": percent(F.col("total_tokens"), F.col("rl_tokens")), "canonical_model": canonical_model(F.col("model_name"))}
    return out.crossJoin(F.broadcast(whole)).withColumns(shares).drop("rl_requests", "rl_tokens")  # totals are one row


def model_rollup(deployments: DataFrame) -> DataFrame:
    """Deployments' rollup by canonical model and mode: sums, merged states and request-weighted coverage."""
    priced = F.col("requests") * F.col("pricing_coverage_requests_percent") / 100
    out = deployments.groupBy("canonical_model", "deployment_mode").agg(
        F.count(F.lit(1)).alias("deployments"),
        F.sum("requests").alias("requests"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        merged_state(F.col("total_tokens_state")).alias("total_tokens_state"),
        F.round(F.sum("estimated_cost_usd"), 6).alias("estimated_cost_usd"),
        F.round(F.sum(priced) / F.sum("requests") * 100, 1).alias("pricing_coverage_requests_percent"),
        one_or_mixed(F.col("pricing_source")).alias("pricing_source"),
        one_or_mixed(F.col("pricing_status")).alias("pricing_status"),
    )
    return out


def grouping_summary(priced: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Portfolio and slices in one pass by grouping sets; the portfolio's row has ``is_total`` 1."""
    c = F.col("cost")
    columns = [F.col(k) for k in keys]
    return priced.groupingSets([[], columns], *columns).agg(
        F.when(F.grouping_id() > 0, 1).otherwise(0).alias("is_total"),
        F.count(F.lit(1)).alias("requests"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.round(F.sum(F.when(c["resolved"], c["cost_usd"])), 6).alias("estimated_cost_usd"),
    )


def daily_cost(priced: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cost with components and coverage by UTC day (10 digits)."""
    c = F.col("cost")
    ok = c["resolved"] & c["cost_usd"].isNotNull()
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return priced.groupBy(*keys, day).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(ok).alias("priced_requests"),
        F.round(F.sum(F.when(ok, c["cost_usd"])), 10).alias("cost_usd"),
        F.round(F.sum(F.when(ok, c["fresh_cost"])), 10).alias("fresh_cost_usd"),
        F.round(F.sum(F.when(ok, c["cached_cost"])), 10).alias("cached_cost_usd"),
        F.round(F.sum(F.when(ok, c["output_cost"])), 10).alias("output_cost_usd"),
        percent(F.count_if(ok), F.count(F.lit(1))).alias("coverage_percent"),
    )


def unresolved_models(priced: DataFrame) -> DataFrame:
    """What isn't priced, by reason and by the key an override would need."""
    c = F.col("cost")
    rows = priced.where(~(c["resolved"] & c["cost_usd"].isNotNull()))
    return rows.groupBy(c["override_key"].alias("override_key"), c["reason"].alias("reason")).agg(F.count(F.lit(1)).alias("requests"), F.sum(known_tokens()).alias("tokens"))
