"""Whether models, workloads and deployments can be priced, from what, and what is wrong with the catalogs."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_model, known_model
from .pricing import Catalog, candidates
from .validation import currency_shape

NATIVE_UNITS = ["text_to_speech", "speech_to_text", "image", "video", "managed_compute"]
NATIVE_WORKLOADS = ["text_to_speech", "speech_to_text", "audio", "image", "video"]


def _first(rules: list[tuple[Column, str, str]], otherwise: tuple[str, str]) -> Column:
    """(status, label) of the first rule that holds."""
    pair = lambda s, t: F.struct(F.lit(s).alias("status"), F.lit(t).alias("label"))
    return reduce(lambda rest, rule: F.when(F.coalesce(rule[0], F.lit(False)), pair(*rule[1:])).otherwise(rest), reversed(rules), pair(*otherwise))


def model_pricing_states(summaries: DataFrame) -> DataFrame:
    """DQ5: ``summaries`` (see ``rollups.slice_summary``, with model_name and modality) with pricing_state (status, label)."""
    cost, status = F.col("estimated_cost_usd"), F.col("pricing_status")
    no_tokens = F.col("total_tokens_state") == "unavailable"
    rules = [
        (~known_model(F.col("model_name")), "missing_blocking", "Model identity missing"),
        (F.col("modality").isin(*NATIVE_UNITS) & no_tokens, "not_applicable", "Token pricing not applicable"),
        (no_tokens, "missing_actionable", "Token usage unavailable"),
        (cost.isNotNull() & (F.col("unresolved_requests") == 0), "available", "Priced"),
        (cost.isNotNull(), "partial", "Partly priced"),
        (status == "usage_incomplete", "partial", "Exact rate found; usage incomplete"),
        (status == "currency_mismatch", "missing_actionable", "Currency mismatch"),
    ]
    return summaries.withColumn("pricing_state", _first(rules, ("missing_actionable", "Exact rate missing")))


def workload_pricing_states(workloads: DataFrame) -> DataFrame:
    """DQ6: ``workloads`` (see ``workloads.rollup``, with modality) with pricing_state (status, label)."""
    total, cost, asked = F.coalesce("total_tokens", F.lit(0)), F.col("estimated_cost"), F.coalesce("requests", F.lit(0)) > 0
    none = F.col("total_tokens_state") == "unavailable"
    rules = [
        ((total > 0) & (F.col("identity_unresolved_tokens") >= total), "missing_blocking", "Model identity missing"),
        (F.col("total_tokens_state") == "partial", "missing_actionable", "Usage metrics incomplete"),
        (cost.isNotNull() & (F.col("unpriced_tokens") == 0), "available", "Priced"),
        (cost.isNotNull(), "partial", "Partly priced"),
        (none & F.col("modality").isin(*NATIVE_WORKLOADS), "not_applicable", "Token pricing not applicable"),
        (none & asked, "missing_actionable", "Usage metric unavailable"),
        (none, "not_measured", "Token usage unavailable"),
        ((total == 0) & ~asked, "not_measured", "No traffic in this window"),
        (total == 0, "available", "Requests observed, zero measured tokens"),
    ]
    return workloads.withColumn("pricing_state", _first(rules, ("missing_actionable", "Exact rate missing")))


def matches(deployments: DataFrame, catalog: Catalog, out: str, tier: str = "standard") -> DataFrame:
    """FLT18: ``deployments`` (model, deployment_mode) with a catalog's entry as struct ``out``: in the deployment's mode (unknown: global), else one without a mode; by rank, then the latest."""
    table = candidates(catalog.prices).where(F.col("p_tier") == tier.lower()).groupBy("p_model").agg(F.flatten(F.collect_list("found")).alias("found"))
    stated = F.lower(F.trim(F.coalesce("deployment_mode", F.lit("unknown"))))
    mode = F.when(stated.isin("", "unknown", "none"), "global").otherwise(stated)
    rows = deployments.withColumns({"rd_name": canonical_model(F.col("model")), "rd_mode": mode}).join(table, F.col("rd_name") == F.col("p_model"), "left")
    exact = F.filter("found", lambda c: F.lower(F.coalesce(c["region"], F.lit(""))) == F.col("rd_mode"))
    pool = F.when(F.size(exact) > 0, exact).otherwise(F.filter("found", lambda c: F.coalesce(c["region"], F.lit("")) == ""))
    best = F.get(F.array_sort(F.transform(pool, lambda c: F.struct(c["source_rank"].alias("rank"), c["recent"].alias("recent"), c["listed"].alias("listed"), c.alias("c")))), F.lit(0))
    return rows.withColumn(out, F.when(F.size("found") > 0, best["c"])).drop("rd_name", "rd_mode", "p_model", "found")


def pricing_readiness(deployments: DataFrame, customer: Catalog | None, reference: Catalog | None, currency: str = "USD") -> DataFrame:
    """J23, HLP46: deployments (deployment, model, model_version, deployment_mode) with state, catalog_name, currency, billing_basis, override_key; all but customer_override and exact_public_rate are unresolved."""
    out, chain = deployments, []
    for i, (c, state) in enumerate([(customer, "customer_override"), (reference, "exact_public_rate")]):
        if c is not None:
            out = matches(out, c, f"rd_{i}")
            chain.append((F.col(f"rd_{i}"), c, state))
    known = known_model(F.col("model"))
    own = currency.upper()
    facts = F.lit(None).cast("struct<state:string,catalog_name:string,currency:string,billing_basis:string>")
    for entry, c, state in reversed(chain):
        same = c.currency.upper() == own
        hit = F.struct(F.lit(state if same else "currency_mismatch").alias("state"), F.lit(c.name).alias("catalog_name"), F.lit(c.currency.upper()).alias("currency"), (entry["billing_basis"] if same else F.lit(None).cast("string")).alias("billing_basis"))
        facts = F.when(entry.isNotNull(), hit).otherwise(facts)
    out = out.withColumn("rd_facts", F.when(known, facts))
    f = lambda n: F.col(f"rd_facts.{n}")
    return out.select(
        "deployment", "model", "model_version", "deployment_mode", F.when(~known, "identity_unresolved").otherwise(F.coalesce(f("state"), F.lit("rate_unavailable"))).alias("state"), f("catalog_name").alias("catalog_name"),
        F.coalesce(f("currency"), F.lit(own)).alias("currency"), f("billing_basis").alias("billing_basis"), F.when(known & f("state").isNull(), canonical_model(F.col("model"))).alias("override_key"), F.array(*[F.lit(c.name) for _, c, _ in chain]).alias("catalogs_consulted"),
    )


def pricing_provenance(summaries: DataFrame, catalogs: list[Catalog], currency: str = "USD") -> DataFrame:
    """DQ3: for each summary the catalogs that were consulted and the one that was selected, with its date and basis only where something was priced."""
    facts = {c.name: c for c in catalogs}
    priced = F.col("estimated_cost_usd").isNotNull()
    of = lambda get: reduce(lambda rest, c: F.when(F.col("pricing_catalog_name") == c.name, F.lit(get(c))).otherwise(rest), facts.values(), F.lit(None).cast("string"))
    return summaries.withColumns(
        {
            "currency": F.lit(currency),
            "catalogs_consulted": F.array(*[F.lit(c.name) for c in catalogs]).cast("array<string>"),
            "catalog_selected": F.when(priced, F.col("pricing_catalog_name")),
            "retrieved_at": F.when(priced, of(lambda c: c.retrieved_at)),
            "pricing_basis": of(lambda c: c.basis),
            "estimate_only": F.lit(True),
        }
    )


def catalog_problems(catalogs: list[Catalog], today: date, currency: str = "USD") -> DataFrame:
    """VAL5, VAL12: (catalog, problem, model) of what is wrong: an entry that has expired, a currency that differs or isn't one, a customer's entry that isn't labelled as such."""
    out = None
    for c in catalogs:
        expired = c.prices.where(F.col("effective_to") < F.lit(today)).select(F.lit(c.name).alias("catalog"), F.lit("expired").alias("problem"), "model")
        spark = c.prices.sparkSession
        coin = spark.range(1).select(F.lit(c.name).alias("catalog"), F.when(currency_shape(F.lit(c.currency)).isNull(), "currency-malformed").when(currency_shape(F.lit(c.currency)) != currency.upper(), "currency-differs").alias("problem"), F.lit(None).cast("string").alias("model")).where("problem is not null")
        found = expired.unionByName(coin)
        if c.kind == "customer":
            found = found.unionByName(c.prices.where("confidence <> 'customer_override'").select(F.lit(c.name).alias("catalog"), F.lit("not-labelled-customer").alias("problem"), "model"))
        out = found if out is None else out.unionByName(found)
    return out


def catalog_status(catalogs: list[Catalog]) -> DataFrame:
    """HLP45: entries, currency and date of each catalog."""
    parts = [c.prices.agg(F.count(F.lit(1)).alias("entries")).select(F.lit(c.name).alias("catalog"), F.lit(c.kind).alias("kind"), F.lit(c.currency.upper()).alias("currency"), F.lit(c.retrieved_at).cast("string").alias("retrieved_at"), "entries") for c in catalogs]
    return reduce(DataFrame.unionByName, parts)
