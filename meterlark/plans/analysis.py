"""The whole analysis: traces or buckets in, a report's sections out, all lazy DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import buckets as B
from ..operators import rollups as R
from ..operators import rules as Q
from ..operators import tasks as T
from ..operators import workloads as W
from ..operators.pricing import Catalog, price_traces


class MixedTelemetryError(ValueError):
    """Request rows and buckets usually describe the same traffic; adding them up would count it twice."""


def telemetry_kinds(records: DataFrame) -> list[str]:
    """FLT1, FLT2: which kinds of telemetry the records are."""
    kind = F.when(F.col("record_type") == "foundry_metric_bucket", "aggregate").otherwise("request")
    return sorted(r[0] for r in records.select(kind.alias("kind")).distinct().collect())  # two values at most


def data_quality(deployments: DataFrame) -> DataFrame:
    """DQ1: (deployment_name, issue, detail) of what keeps a deployment's numbers from being whole."""
    checks = [
        (F.col("pricing_status") == "identity_unresolved", "identity", F.lit("the model isn't named")),
        (F.col("input_tokens_state") != "measured", "input_tokens", F.col("input_tokens_state")),
        (F.col("output_tokens_state") != "measured", "output_tokens", F.col("output_tokens_state")),
        (F.col("cached_tokens_state") != "measured", "cached_tokens", F.col("cached_tokens_state")),
        (~F.col("pricing_complete"), "pricing", F.array_join("unresolved_reasons", ";")),
    ]
    each = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(i).alias("issue"), d.alias("detail"))) for c, i, d in checks]))
    return deployments.select("deployment_name", F.explode(each).alias("q")).select("deployment_name", "q.*")


def cost_state(models: DataFrame) -> DataFrame:
    """DQ4: one banner for the cost numbers, the first state that holds."""
    s = F.col("pricing_status")
    any_ = lambda v: F.coalesce(F.bool_or(s == v), F.lit(False))
    state = (
        F.when(F.count(F.lit(1)) == 0, "not_applicable").when(F.bool_and(s == "priced"), "complete").when(F.coalesce(F.sum("estimated_cost_usd"), F.lit(0.0)) > 0, "partial")
        .when(any_("identity_unresolved"), "identity_missing").when(any_("usage_incomplete"), "usage_missing").otherwise("setup_required")
    )
    return models.agg(state.alias("cost_state"))


def analyze(traces: DataFrame, catalogs: list[Catalog], mappings: DataFrame | None = None, currency: str = "USD", keys: Sequence[str] = ("deployment_name",), allow_mixed: bool = False) -> dict[str, DataFrame]:
    """Sections of a request analysis.  Fails on mixed telemetry unless ``allow_mixed``."""
    if "record_type" in traces.columns and not allow_mixed and len(telemetry_kinds(traces)) > 1:
        raise MixedTelemetryError("request rows and metric buckets in one analysis")
    priced = price_traces(traces, catalogs, currency)
    deployments = R.deployment_rollup(priced)
    models = R.model_rollup(deployments)
    out = {"portfolio": R.slice_summary(priced, []), "deployments": deployments, "models": models, "days": R.daily_cost(priced), "unresolved": R.unresolved_models(priced), "data_quality": data_quality(deployments), "cost_state": cost_state(models)}
    if "messages" in traces.columns:
        totals = traces.groupBy(*keys).agg(F.sum("input_tokens").alias("input_tokens"), F.count(F.lit(1)).alias("requests"))
        out["rules"] = Q.evaluate(traces, keys)
        out["findings"] = Q.top_findings(Q.with_impact(out["rules"], totals, keys), keys)
    if mappings is not None:
        attributed = W.attribute(priced, mappings)
        out |= {"technical_workloads": W.technical_workloads(attributed), "business_workloads": W.business_workloads(attributed)}
    return out


def analyze_buckets(buckets: DataFrame) -> dict[str, DataFrame]:
    """Sections of a bucket analysis."""
    summary = B.bucket_summary(buckets, ["deployment_name"])
    return {"portfolio": B.bucket_summary(buckets), "deployments": summary, "insights": B.insights(summary, ["deployment_name"]), "gaps": B.bucket_gaps(buckets, ["deployment_name"])}


def analyze_tasks(events: DataFrame, catalogs: list[Catalog]) -> dict[str, DataFrame]:
    """AGG24: cohorts and strategies of task events."""
    tasks = T.trajectories(T.price_events(events, catalogs))
    return {"task_types": T.cohorts(tasks), "strategies": T.pareto(T.strategies(tasks)), "workloads": T.tasks_by_workload(tasks)}


def savings_scenarios(findings: DataFrame) -> DataFrame:
    """AGG25: findings with savings as scenarios of their own; they overlap and are never added up."""
    unit = F.when(F.col("rule_id") == "TL007", "calls").otherwise("tokens")
    return findings.where("min_savings is not null").select("rule_id", unit.alias("unit"), F.col("min_savings").alias("min_value"), F.coalesce("max_savings", "min_savings").alias("max_value"))
