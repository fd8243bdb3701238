"""Task economics: steps to attempts to tasks to cohorts and strategies.

Events are one table with event_type model_call, tool_step, task_result or human_review.  Steps carry their ``cost``
struct (see pricing).  Two aggregations, by (task, attempt) and by task, rebuild trajectories in any file order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import beside, measured_percentiles
from ..functions.text import canonical_model
from ..sinks.tables import written
from .pricing import NAME, Catalog, resolve, with_price

CLOSED = ("solved", "failed", "abandoned")


def price_events(events: DataFrame, catalogs: list[Catalog], currency: str = "USD") -> DataFrame:
    """J3: ``events`` with ``cost``; a tool step without an observed cost is unresolved."""
    calls = F.col("event_type") == "model_call"
    out = events.withColumn(NAME, F.when(calls, canonical_model(F.col("model_name"))))
    for i, c in enumerate(catalogs):
        out = with_price(out, c, f"price_{i}", F.col("ts"), F.col("context_length"))
    out = resolve(out, catalogs, currency, {"cost": F.col("cached_tokens")}, fields=("resolved", "cost_usd", "source"))
    c = F.col("cost")
    open_ = (F.col("event_type") == "tool_step") & F.col("observed_cost_usd").isNull()
    step = calls | (F.col("event_type") == "tool_step")
    cost = F.struct(F.when(step, c["resolved"] & ~open_).alias("resolved"), F.when(step & ~open_, c["cost_usd"]).alias("cost_usd"), F.when(open_, "unresolved").when(step, c["source"]).alias("source"))
    return out.withColumn("cost", cost).drop(NAME, *[f"price_{i}" for i in range(len(catalogs))])


def trajectories(events: DataFrame) -> DataFrame:
    """AGG19, WIN12, WIN13: one row a task.

    Events are dealt by task once, which serves both aggregations.
    """
    step = F.col("event_type").isin("model_call", "tool_step")
    call, result, review = (F.col("event_type") == t for t in ("model_call", "task_result", "human_review"))
    c = F.col("cost")
    described = F.col("task_type").isNotNull() & F.col("execution_strategy").isNotNull() & F.col("strategy_version").isNotNull()
    attempts = events.repartition("task_id").groupBy("task_id", F.when(step | result, F.coalesce("attempt_id", F.lit("attempt-unknown"))).alias("attempt")).agg(
        F.count_if(step).alias("steps"),
        F.count_if(step & c["resolved"]).alias("resolved_steps"),
        *[F.count_if(step & c["resolved"] & (c["source"] == s)).alias(f"{s}_steps") for s in ("observed", "customer", "reference")],
        F.sum(F.when(step, c["cost_usd"])).alias("cost"),
        F.sum(F.when(call, F.col("input_tokens") + F.col("output_tokens"))).alias("tokens"),
        F.sum(F.when(call, F.col("input_tokens") - F.col("cached_tokens"))).alias("fresh_tokens"),
        F.sum(F.when(call, F.col("output_tokens"))).alias("output_tokens"),
        F.count_if(call).alias("model_calls"),
        F.sum(F.when(step & ~call, c["cost_usd"])).alias("tool_cost"),
        F.sum(F.when(step, F.col("duration_ms"))).alias("duration"),
        F.max_by("outcome", F.when(result, F.struct("ts", "seq"))).alias("outcome"),
        F.max(F.when(result, F.struct("ts", "seq", "outcome", "duration_ms"))).alias("result"),
        F.min(F.when(described, F.struct("seq", "task_type", "execution_strategy", "strategy_version"))).alias("about"),
        F.min(F.when(F.col("workload").isNotNull() & (F.col("workload") != ""), F.struct("seq", "workload"))).alias("label"),
        F.min("ts").alias("first_ts"),
        F.count_if(review).alias("reviews"),
        F.count_if(review & (F.col("review_outcome") == "correct") & ~F.coalesce("escaped_error", F.lit(False))).alias("passes"),
        F.coalesce(F.bool_or(review & F.coalesce("escaped_error", F.lit(False))), F.lit(False)).alias("escaped"),
        F.count(F.when(review, F.col("policy_compliant"))).alias("policy"),
        F.count_if(review & F.coalesce("policy_compliant", F.lit(False))).alias("compliant"),
        F.count(F.when(review, F.col("cleanup_cost_usd"))).alias("cleanups"),
        F.sum(F.when(review, F.col("cleanup_cost_usd"))).alias("cleanup"),
    )
    real = F.col("attempt").isNotNull()
    zero = lambda x: F.coalesce(F.sum(x), F.lit(0))
    tasks = attempts.groupBy("task_id").agg(
        F.min("about").alias("about"),
        F.min("label").alias("label"),
        F.min("first_ts").alias("first_ts"),
        F.max("result").alias("result"),
        F.count_if(real).alias("attempts"),
        F.count_if(real & (F.col("outcome") == "solved")).alias("solved_attempts"),
        F.coalesce(F.bool_and(F.when(real, F.col("steps") == F.col("resolved_steps"))), F.lit(True)).alias("resolved"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("all_cost"),
        *[zero(x).alias(x) for x in ("steps", "resolved_steps", "observed_steps", "customer_steps", "reference_steps", "tokens", "fresh_tokens", "output_tokens", "model_calls", "reviews", "passes", "policy", "compliant", "cleanups")],
        F.sum("tool_cost").alias("tool_cost"),
        F.sum("duration").alias("duration"),
        F.bool_or("escaped").alias("escaped"),
        F.sum("cleanup").alias("cleanup_cost"),
    )
    return tasks.select(
        "task_id",
        "about.task_type",
        "about.execution_strategy",
        "about.strategy_version",
        F.col("label.workload").alias("workload"),
        "first_ts",
        F.col("result.outcome").alias("outcome"),
        "attempts",
        "solved_attempts",
        F.greatest(F.lit(0), F.col("attempts") - 1).alias("retries"),
        "resolved",
        F.when(F.col("resolved"), F.col("all_cost")).alias("cost_usd"),
        "steps", "resolved_steps", "observed_steps", "customer_steps", "reference_steps", "tokens", "fresh_tokens", "output_tokens", "model_calls", "tool_cost",
        F.coalesce(F.col("duration"), F.col("result.duration_ms")).alias("duration_ms"),
        "reviews", "passes", "policy", "compliant", "escaped", "cleanup_cost",
        ((F.col("reviews") > 0) & (F.col("reviews") == F.col("cleanups"))).alias("cleanup_known"),
    )


def _mean_if_whole(value: Column, group: Column) -> Column:
    """Mean over a group's resolved rows, only if the whole group is resolved."""
    mine = F.when(group & F.col("resolved"), value)
    return F.when((F.count(mine) > 0) & (F.count(mine) == F.count_if(group)), F.round(F.avg(mine), 6))


def cohorts(tasks: DataFrame, keys: Sequence[str] = ("task_type",), percentile_digits: int = 6) -> DataFrame:
    """AGG20, AGG21, AGG22, PCT1, PCT5: completeness-gated measures of tasks by ``keys``."""
    closed = F.col("outcome").isNotNull()
    is_ = lambda *o: closed & F.col("outcome").isin(*o)
    cost, resolved = F.col("cost_usd"), F.col("resolved")
    n, total = F.count(F.lit(1)), lambda c: F.sum(c)
    rate = lambda a, b, d=1: F.when(b > 0, F.round(a / b * 100, d))
    failed = is_("failed", "abandoned")
    spend = F.when(failed & resolved, cost)
    cleaned = F.when(F.col("cleanup_known"), F.coalesce("cleanup_cost", F.lit(0.0)))
    corrected = F.when(F.col("cleanup_known") & F.col("escaped") & cost.isNotNull(), cost + F.coalesce("cleanup_cost", F.lit(0.0)))
    named = F.bool_and(F.when(closed, F.col("outcome").isin(*CLOSED)))
    level = F.when(F.sum("attempts") == 0, 0).when(~F.bool_or(closed) | ~named, 1).when(F.sum("reviews") == 0, 2).otherwise(3)
    tasks = written(tasks, "tasks")
    found = measured_percentiles(tasks, keys, {"tokens": F.col("tokens"), "cost": cost, "solved_cost": F.when(is_("solved"), cost), "latency": F.col("duration_ms")}, {"p50": 0.5, "p90": 0.9})
    wanted = ["tokens_p50", "tokens_p90", "cost_p50", "cost_p90", "solved_cost_p50", "latency_p90"]
    found = found.select(*keys, *[F.round(c, percentile_digits).alias(c) for c in wanted])
    sums = tasks.groupBy(*keys).agg(
        level.alias("maturity_level"),
        n.alias("attempted_tasks"),
        F.count_if(~closed).alias("open_tasks"),
        F.count_if(closed).alias("closed_tasks"),
        *[F.count_if(is_(o)).alias(f"{o}_tasks") for o in CLOSED],
        rate(F.count_if(is_("solved")), F.count_if(closed)).alias("success_rate"),
        F.count_if(resolved).alias("resolved_tasks"),
        F.count_if(~resolved).alias("unresolved_tasks"),
        F.round(F.avg(F.when(resolved, cost)), 6).alias("cost_per_observed_task_usd"),
        _mean_if_whole(cost, closed).alias("cost_per_closed_task_usd"),
        _mean_if_whole(cost, is_("solved")).alias("cost_per_solved_task_usd"),
        F.round(total("model_calls") / n, 3).alias("model_calls_per_task"),
        F.round(total("attempts") / n, 3).alias("attempts_per_task"),
        total("retries").alias("retries"),
        F.when((F.count(spend) > 0) & (F.count(spend) == F.count_if(failed)), F.round(F.sum(spend), 6)).alias("failed_spend_usd"),
        total("passes").alias("reviewed_passes"),
        F.count_if("escaped").alias("escaped_errors"),
        rate(F.count_if("escaped"), total("reviews")).alias("leak_rate"),
        rate(total("compliant"), total("policy")).alias("policy_compliance_rate"),
        F.round(F.sum(cleaned), 6).alias("cleanup_spend_usd"),
        F.when(F.count_if(is_("solved")) > 0, F.round(F.sum(cleaned) / F.count_if(is_("solved")), 6)).alias("cleanup_per_solved_usd"),
        F.round(F.avg(corrected), 6).alias("cost_per_corrected_usd"),
        total("resolved_steps").alias("resolved_events"),
        (total("steps") - total("resolved_steps")).alias("unresolved_events"),
        *[total(f"{s}_steps").alias(f"{s}_events") for s in ("observed", "customer", "reference")],
        F.when(total("steps") > 0, F.round(total("resolved_steps") / total("steps") * 100, 1)).otherwise(0.0).alias("coverage_percent"),
        total("fresh_tokens").alias("fresh_input_tokens"),
        total("output_tokens").alias("output_tokens"),
        F.round(F.sum("tool_cost"), 6).alias("tool_cost_usd"),
    )
    return beside(sums, found, keys)


def strategies(tasks: DataFrame, provisional: int = 30, ranked: int = 100, percentile_digits: int = 6) -> DataFrame:
    """AGG23: strategies of a task type with enough closed tasks."""
    closed, solved = F.col("outcome").isNotNull(), F.col("outcome") == "solved"
    keys = ["task_type", "execution_strategy", "strategy_version"]
    tasks = written(tasks.select(*keys, "outcome", "attempts", "solved_attempts", "resolved", "cost_usd"), "tasks")  # what isn't written isn't derived
    found = measured_percentiles(tasks, keys, {"cost": F.col("cost_usd")}, {"p50": 0.5, "p90": 0.9})
    found = found.select(*keys, *[F.round(f"cost_{p}", percentile_digits).alias(f"{p}_cost_usd") for p in ("p50", "p90")])
    out = tasks.groupBy(*keys).agg(
        F.count_if(closed).alias("closed_tasks"),
        F.count_if(solved).alias("solved_tasks"),
        F.round(F.count_if(solved) / F.greatest(F.lit(1), F.count_if(closed)) * 100, 1).alias("success_rate"),
        F.round(F.sum("solved_attempts") / F.greatest(F.lit(1), F.sum("attempts")) * 100, 1).alias("attempt_success_rate"),
        _mean_if_whole(F.col("cost_usd"), closed).alias("cost_per_task_usd"),
        _mean_if_whole(F.col("cost_usd"), solved).alias("cost_per_solved_task_usd"),
    )
    return beside(out, found, keys).where(F.col("closed_tasks") >= provisional).withColumn("recommendation_eligible", F.col("closed_tasks") >= ranked)


def pareto(compared: DataFrame) -> DataFrame:
    """J20: ``compared`` with pareto_frontier: no other strategy of the type is as good in cost and success and better in one.

    An anti-join of strategies, which are few, within their task type; they are written once for its sides.
    """
    compared = written(compared, "strategies")
    a, b = compared.alias("a"), compared.alias("b")
    better = (
        (F.col("a.task_type") == F.col("b.task_type"))
        & (F.col("b.cost_per_solved_task_usd") <= F.col("a.cost_per_solved_task_usd"))
        & (F.col("b.success_rate") >= F.col("a.success_rate"))
        & ((F.col("b.cost_per_solved_task_usd") < F.col("a.cost_per_solved_task_usd")) | (F.col("b.success_rate") > F.col("a.success_rate")))
    )
    keys = ["task_type", "execution_strategy", "strategy_version"]
    front = a.join(b, better, "left_anti").select(*keys, F.lit(True).alias("front"))
    return compared.join(front, keys, "left").withColumn("pareto_frontier", F.coalesce("front", F.lit(False))).drop("front")


def tasks_by_workload(tasks: DataFrame) -> DataFrame:
    """AGG18: closed, solved and cost of tasks by their workload label."""
    rows = tasks.where(F.col("workload").isNotNull())
    return rows.groupBy("workload").agg(
        F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("outcome").isNotNull()).alias("closed_tasks"), F.count_if(F.col("outcome") == "solved").alias("solved_tasks"), F.round(F.sum("cost_usd"), 6).alias("resolved_cost_usd"), F.count_if(~F.col("resolved")).alias("unresolved_tasks")
    )
