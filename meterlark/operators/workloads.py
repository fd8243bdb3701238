"""Usage and cost by workload: technical (by deployment), business (by label or mapping), and what is unassigned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import total_of, total_state
from ..functions.quantiles import counted_broadcast
from ..functions.text import deployment_workload, known_model, workload_slug
from .rollups import known_tokens

MAPPING = "id string, name string, allocation string, deployments array<string>"


def attribute(priced: DataFrame, mappings: DataFrame) -> DataFrame:
    """``priced`` with workload_id, workload_name and source: a request's own label, else its deployment's dedicated mapping.

    A label that names a mapping's id or name takes that mapping's id and name.  The last dedicated mapping of a
    deployment and the first mapping of a label win.  Mappings are configuration and are broadcast while they are few.
    """
    listed = mappings.withColumn("seq", F.monotonically_increasing_id())
    dedicated = listed.where("allocation = 'dedicated'").select("id", "name", "seq", F.explode("deployments").alias("d"))
    dedicated = dedicated.groupBy(workload_slug(F.col("d")).alias("m_deployment")).agg(F.max_by(F.struct("id", "name"), "seq").alias("mapping"))
    labels = listed.select("id", "name", F.col("seq"), F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("id").alias("l")), F.struct(F.lit(1).alias("k"), F.col("name").alias("l")))).alias("x"))
    labels = labels.groupBy(workload_slug(F.col("x.l")).alias("m_label")).agg(F.min_by(F.struct("id", "name"), F.struct("seq", "x.k")).alias("labelled"))
    own = F.when(F.trim(F.col("workload")) != "", F.col("workload"))
    out = priced.withColumns({"w_own": own, "w_dep": workload_slug(F.col("deployment_name")), "w_label": workload_slug(own)})
    out = out.join(counted_broadcast(dedicated), F.col("w_dep") == F.col("m_deployment"), "left").join(counted_broadcast(labels), F.col("w_own").isNotNull() & (F.col("w_label") == F.col("m_label")), "left")
    chosen = F.when(F.col("w_own").isNotNull(), F.col("labelled")).otherwise(F.col("mapping"))
    named = F.coalesce(chosen["name"], F.col("w_own"))
    return out.withColumns(
        {
            "workload_id": F.when(F.col("w_own").isNotNull() | F.col("mapping").isNotNull(), workload_slug(F.coalesce(chosen["id"], F.col("w_own")))),
            "workload_name": named,
            "workload_source": F.when(F.col("w_own").isNotNull(), "request_label").when(F.col("mapping").isNotNull(), "deployment_mapping"),
        }
    ).drop("w_own", "w_dep", "w_label", "m_deployment", "mapping", "m_label", "labelled")


def rollup(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tokens, states, cost and daily distribution of attributed rows by ``keys``: first by day, then over days."""
    c = F.col("cost")
    ok = c["resolved"] & c["cost_usd"].isNotNull()
    n = lambda cond: F.count_if(cond)
    measures = ("input_tokens", "cached_tokens", "output_tokens")
    daily = rows.groupBy(*keys, F.to_date("ts").alias("day")).agg(
        n(F.lit(True)).alias("requests"),
        *[F.sum(m).alias(m) for m in measures],
        *[F.count(m).alias(f"{m}_n") for m in measures],
        F.sum(F.when(ok, c["cost_usd"])).alias("cost"),
        n(ok).alias("priced"),
        F.sum(F.when(ok, known_tokens()).otherwise(0)).alias("priced_tokens"),
        F.sum(F.when(ok, 0).otherwise(known_tokens())).alias("unpriced_tokens"),
        F.sum(F.when(known_model(F.col("model_name")), 0).otherwise(known_tokens())).alias("identity_unresolved_tokens"),
        F.sum(F.when(F.col("workload_id").isNotNull(), known_tokens()).otherwise(0)).alias("business_tokens"),
    )
    day_cost = F.when((F.col("priced") > 0) & F.col("day").isNotNull(), F.round("cost", 6))
    state = lambda m: F.when(F.sum(f"{m}_n") == 0, "unavailable").when(F.sum(f"{m}_n") < F.sum("requests"), "partial").otherwise("measured")
    out = daily.groupBy(*keys).agg(
        F.sum("requests").alias("requests"),
        *[F.sum(m).alias(m) for m in measures],
        *[state(m).alias(f"{m}_state") for m in measures],
        F.sum("cost").alias("cost"),
        F.sum("priced").alias("priced"),
        *[F.sum(x).alias(x) for x in ("priced_tokens", "unpriced_tokens", "identity_unresolved_tokens", "business_tokens")],
        F.count(day_cost).alias("active_days"),
        F.round(F.avg(day_cost), 6).alias("average_daily_cost"),
        F.round(F.percentile(day_cost, F.lit(0.5)), 6).alias("p50_daily_cost"),
        F.round(F.percentile(day_cost, F.lit(0.9)), 6).alias("p90_daily_cost"),
    )
    total = total_state(F.col("input_tokens_state"), F.col("output_tokens_state"))
    tokens = F.coalesce(total_of(F.col("input_tokens"), F.col("output_tokens")), F.lit(0))
    share = lambda part: F.when(tokens > 0, F.round(F.col(part) / tokens * 100, 1)).otherwise(0.0)
    whole = (F.col("unpriced_tokens") == 0) & (F.col("priced_tokens") > 0) & (total == "measured") & (F.col("cached_tokens_state") == "measured")
    return out.select(
        *keys,
        "requests",
        *measures,
        total_of(F.col("input_tokens"), F.col("output_tokens")).alias("total_tokens"),
        *[f"{m}_state" for m in measures],
        total.alias("total_tokens_state"),
        F.when(F.col("priced") > 0, F.round("cost", 6)).alias("estimated_cost"),
        "priced_tokens",
        "unpriced_tokens",
        share("priced_tokens").alias("pricing_coverage_percent"),
        F.when((F.col("priced") > 0) & whole, F.round(F.col("cost") / F.col("requests"), 6)).alias("cost_per_request"),
        "active_days",
        "average_daily_cost",
        "p50_daily_cost",
        "p90_daily_cost",
        share("business_tokens").alias("business_identity_coverage_percent"),
        "identity_unresolved_tokens",
    )


def technical_workloads(attributed: DataFrame) -> DataFrame:
    """AGG15, AGG16: one workload a deployment."""
    name = F.coalesce("deployment_name", F.lit("unknown"))
    return rollup(attributed.withColumns({"technical_id": deployment_workload(name), "technical_name": name}), ["technical_id", "technical_name"])


def business_workloads(attributed: DataFrame) -> DataFrame:
    """AGG17, J13, J15: labelled or mapped workloads, and one row ``unassigned`` for the rest if anything is labelled or mapped.

    Both kinds together add up to the technical workloads.
    """
    rows = attributed.withColumns({"business_id": F.coalesce("workload_id", F.lit("unassigned")), "assigned": F.col("workload_id").isNotNull()})
    return rollup(rows, ["business_id", "assigned"])


def mapping_problems(mappings: DataFrame) -> DataFrame:
    """Mappings that contradict: a deployment dedicated to several workloads, or dedicated and shared at once; ids used twice."""
    each = mappings.select("id", "allocation", F.explode("deployments").alias("d")).withColumn("deployment", workload_slug(F.col("d")))
    by = each.groupBy("deployment").agg(F.count_distinct(F.when(F.col("allocation") == "dedicated", F.col("id"))).alias("dedicated"), F.count_if(F.col("allocation") == "shared").alias("shared"))
    twice = mappings.groupBy(workload_slug(F.col("id")).alias("subject")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("subject", F.lit("duplicate-id").alias("problem"))
    many = by.where("dedicated > 1").select(F.col("deployment").alias("subject"), F.lit("dedicated-to-several").alias("problem"))
    both = by.where("dedicated > 0 and shared > 0").select(F.col("deployment").alias("subject"), F.lit("dedicated-and-shared").alias("problem"))
    return twice.unionByName(many).unionByName(both)


def shared_without_tags(attributed: DataFrame, mappings: DataFrame) -> DataFrame:
    """SET8: deployments that are shared by mapping but have no labelled traffic."""
    shared = mappings.where("allocation = 'shared'").select(F.explode("deployments").alias("d")).select(workload_slug(F.col("d")).alias("deployment")).distinct()
    tagged = attributed.where(F.trim(F.col("workload")) != "").select(workload_slug(F.col("deployment_name")).alias("deployment")).distinct()
    return shared.join(tagged, "deployment", "left_anti")


def merge_identities(previous: DataFrame, current: DataFrame, enrichment: Sequence[str]) -> DataFrame:
    """J14: a full outer join by workload_id; enrichment of before is kept, what is gone is stale."""
    old, new = previous.alias("o"), current.alias("n")
    kept = [F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) for c in enrichment]
    return new.join(old, F.col("n.workload_id") == F.col("o.workload_id"), "full_outer").select(F.coalesce("n.workload_id", "o.workload_id").alias("workload_id"), *kept, F.col("n.workload_id").isNull().alias("stale"))


def unresolved_identity(rows: DataFrame) -> Column:
    """FLT5."""
    return ~known_model(F.col("model_name"))


