"""What models, deployments and metrics are known to be: exact names only, everything else stays unknown."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import fixed
from ..functions.text import known_model, publisher_of, workload_slug

FACTS = ["modality", "usage_bases", "commerce_type", "ptu_eligible"]


def alias_key(name: Column) -> Column:
    """A name without case and punctuation."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def capabilities(spark: SparkSession) -> DataFrame:
    """One row for each alias."""
    rows = [(a, m, *facts) for m, aliases, *facts in fixed.CAPABILITIES for a in aliases]
    table = spark.createDataFrame(rows, "alias string, canonical string, modality string, usage_bases array<string>, commerce_type string, ptu_eligible boolean")
    return table.withColumn("alias_key", alias_key(F.col("alias"))).dropDuplicates(["alias_key"])


def with_capability(rows: DataFrame, model: str = "model_name") -> DataFrame:
    """PRJ16, PRJ17, VAL8: ``rows`` with what their exact model name stands for.

    Rows whose ``capability_status`` is verified or whose ``modality`` is known keep what they say (columns that are
    missing count as unknown).  The table is a few dozen fixed rows and is broadcast.
    """
    empty = {"modality": F.lit("unknown"), "usage_bases": F.array().cast("array<string>"), "commerce_type": F.lit("unknown"), "ptu_eligible": F.lit(None).cast("boolean"), "capability_status": F.lit("unknown"), "capability_version": F.lit(None).cast("string")}
    rows = rows.withColumns({n: v for n, v in empty.items() if n not in rows.columns})
    found = capabilities(rows.sparkSession).select("alias_key", F.struct(*FACTS).alias("cp_found"))
    open_ = (F.coalesce("capability_status", F.lit("unknown")) != "verified") & (F.coalesce("modality", F.lit("unknown")) == "unknown")
    out = rows.withColumn("cp_key", F.when(open_, alias_key(F.col(model)))).join(F.broadcast(found), F.col("cp_key") == F.col("alias_key"), "left")
    hit = F.col("cp_found").isNotNull()
    facts = {n: F.when(hit, F.col(f"cp_found.{n}")).otherwise(F.col(n)) for n in FACTS}
    facts |= {"capability_status": F.when(hit, "verified").otherwise(F.col("capability_status")), "capability_version": F.when(hit, fixed.CAPABILITY_VERSION).otherwise(F.col("capability_version"))}
    return out.withColumns(facts).drop("cp_key", "alias_key", "cp_found")


def offer_mode(offer: Column) -> Column:
    """PRJ22: the mode of a deployment offer; one that isn't recognised is ``unknown``, never global."""
    name = F.regexp_replace(F.lower(F.coalesce(offer, F.lit(""))), r"[\s_-]+", "")
    whole = [(name == n, m) for n, m in fixed.OFFER_MODES]
    part = [(F.startswith(name, F.lit(n)) | F.endswith(name, F.lit(n)), m) for n, m in fixed.OFFER_MODES]
    return reduce(lambda rest, rule: F.when(rule[0], F.lit(rule[1])).otherwise(rest), reversed(whole + part), F.lit("unknown"))


def provider_family(model: Column, publisher: Column | None = None) -> Column:
    """PRJ23: the provider family of a model by its publisher."""
    known = F.create_map(*[F.lit(x) for pair in fixed.FAMILIES.items() for x in pair])
    of = publisher_of(model) if publisher is None else F.coalesce(F.when(publisher != "", publisher), publisher_of(model))
    return F.coalesce(F.try_element_at(known, F.lower(of)), F.lit("unknown"))


def account_scope(account: Column, group: Column | None = None) -> Column:
    """PRJ29: a label of an account without subscription or tenant."""
    parts = [F.when(p != "", workload_slug(p)) for p in ((group,) if group is not None else ()) + (account,)]
    return F.coalesce(F.nullif(F.concat_ws("/", *parts), F.lit("")), F.lit("account"))


def internal_key(scope: Column, deployment: Column) -> Column:
    """PRJ29: the key by which workloads of an account are reconciled."""
    return F.concat_ws("/", scope, workload_slug(deployment))


def configuration_status(name: Column, environment: Column, purpose: Column) -> Column:
    """HLP15: how far a workload mapping is configured."""
    filled = lambda c: F.coalesce(c != "", F.lit(False))
    return F.when(filled(environment) & filled(purpose), "configured").when(filled(name) & ~filled(environment), "partially_configured").when(filled(name), "configured").otherwise("needs_configuration")


def default_workloads(deployments: DataFrame, name: str = "deployment_name", scope: str = "account") -> DataFrame:
    """HLP16: the technical workload that each deployment is without any mapping."""
    d = F.col(name)
    return deployments.select(
        F.concat(F.lit("deployment:"), workload_slug(d)).alias("workload_id"), d.alias("workload_name"), F.lit("technical").alias("workload_scope"), F.lit("ai_deployment").alias("workload_type"), F.lit("system_default").alias("source"),
        F.lit("needs_configuration").alias("configuration_status"), F.lit("deployment_total").alias("allocation"), F.array(d).alias("deployment_names"), internal_key(F.lit(scope), d).alias("internal_key"),
    )


def resolved_deployment(dimension: Column, requested: Sequence[str]) -> Column:
    """HLP22: the deployment of a metric series: its own, else the only one that was asked for, else an error."""
    own = F.when(dimension != "", dimension)
    return F.coalesce(own, F.lit(requested[0])) if len(requested) == 1 else F.coalesce(own, F.raise_error(F.lit("a series without a deployment can't be told from others")).cast("string"))


def merged_identity(series: DataFrame, keys: Sequence[str] = ("deployment_name",), order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """HLP23: (identities, conflicts) of metric series (keys, model, version, seq): the first stated model and version of each key, and (keys, kind, first, other) for those that disagree."""
    values = F.explode(F.array(F.struct(F.lit("model").alias("kind"), F.col("model").alias("value")), F.struct(F.lit("version").alias("kind"), F.col("version").alias("value"))))
    flat = series.select(*keys, order, values.alias("x")).select(*keys, order, "x.*").where("value <> ''")
    firsts = flat.groupBy(*keys, "kind").agg(F.min_by("value", order).alias("first"))
    wide = firsts.groupBy(*keys).agg(F.max(F.when(F.col("kind") == "model", F.col("first"))).alias("model"), F.max(F.when(F.col("kind") == "version", F.col("first"))).alias("version"))
    conflicts = flat.select(*keys, "kind", F.col("value").alias("other")).distinct().join(firsts, [*keys, "kind"]).where("other <> first").select(*keys, "kind", "first", "other")
    return wide, conflicts


def inventory_conflicts(buckets: DataFrame, inventory: DataFrame) -> DataFrame:
    """J12: (deployment_name, kind, listed, measured) where metrics and the inventory (name, model, model_version) disagree.

    The last inventory row of a name (any case) counts, by ``seq``; an unknown measured model or a missing version isn't a disagreement.
    """
    last = inventory.groupBy(F.lower("name").alias("i_name")).agg(F.max_by(F.struct("model", "model_version"), "seq").alias("i"))
    seen = buckets.select("deployment_name", "model_name", "model_version").distinct()
    both = seen.join(last, F.lower("deployment_name") == F.col("i_name"))
    model = F.when((F.col("i.model") != "") & known_model(F.col("model_name")) & (F.col("model_name") != F.col("i.model")), F.struct(F.lit("model").alias("kind"), F.col("i.model").alias("listed"), F.col("model_name").alias("measured")))
    version = F.when((F.col("i.model_version") != "") & (F.col("model_version") != F.col("i.model_version")), F.struct(F.lit("version").alias("kind"), F.col("i.model_version").alias("listed"), F.col("model_version").alias("measured")))
    return both.select("deployment_name", F.explode(F.array_compact(F.array(model, version))).alias("c")).select("deployment_name", "c.*").distinct()


def metric_choices(definitions: DataFrame, deployment_filtered: bool = True) -> DataFrame:
    """J18, HLP27: for each resource and metric that is a candidate (resource, field, metric, priority, reason, chosen).

    ``definitions``: resource, name, dimensions (null: not stated, so what is documented counts).  A candidate that can't
    be filtered by deployment is excluded with a reason; of the rest the first by priority is chosen.
    """
    table = definitions.sparkSession.createDataFrame(fixed.METRICS, "metric string, field string, aggregation string, priority int, filterable boolean, has_status boolean")
    rows = definitions.join(F.broadcast(table), F.lower("name") == F.lower("metric"))
    stated = F.col("dimensions").isNotNull()
    can = F.when(stated, F.array_contains("dimensions", "ModelDeploymentName")).otherwise(F.col("filterable"))
    rows = rows.withColumns({"can": can, "status_dimensioned": stated & F.coalesce(F.array_contains("dimensions", "StatusCode"), F.lit(False))})
    usable = F.col("can") if deployment_filtered else F.lit(True)
    first = F.min(F.when(usable, F.col("priority"))).over(Window.partitionBy("resource", "field"))
    reason = F.when(~usable, "metric definition does not support a ModelDeploymentName filter")
    return rows.withColumn("first", first).select("resource", "field", "metric", "aggregation", "priority", "status_dimensioned", reason.alias("reason"), F.coalesce(usable & (F.col("priority") == F.col("first")), F.lit(False)).alias("chosen"))


def error_category(error_type: Column, failed: Column) -> Column:
    """STR13: category of a span's error: by its type, ``unknown`` for other failures, else null."""
    known = F.create_map(*[F.lit(x) for pair in fixed.ERROR_TYPES.items() for x in pair])
    return F.when(error_type != "", F.coalesce(F.try_element_at(known, F.lower(error_type)), F.lit("unknown"))).when(failed, "unknown")
