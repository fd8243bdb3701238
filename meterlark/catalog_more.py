"""Queries of validation, capabilities, readiness, dashboards, manifests and published prices; registered with the others."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import catalog as K
from . import catalog_sql as S
from . import fixed
from .functions.text import canonical_model
from .functions.tokens import tokenizer_provenance
from .operators import capabilities as L
from .operators import capacity as C
from .operators import dashboard as H
from .operators import manifests as M
from .operators import pricing as P
from .operators import readiness as R
from .operators import rollups
from .operators import rules as Q
from .operators import validation as G
from .operators import workloads as W
from .sources import prices as Y
from .sources import snapshots as N
from .sources import views as V

query, KEY = K.query, K.KEY


def values(rows, names: str) -> str:
    """Rows as a table of SQL values."""
    text = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else repr(x) if isinstance(x, (int, float)) else "[" + ", ".join(map(text, x)) + "]" if isinstance(x, list) else "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + f") t({names})"


# Validation


@query(
    "WITH e AS (SELECT l_orderkey || CASE WHEN l_partkey % 97 = 0 THEN chr(10) ELSE '/' END || l_linenumber AS event_id, l_partkey % 97 = 0 AS broken, l_suppkey % 4 = 0 AS bare, CAST(round(l_quantity * 10) AS BIGINT) AS i, CAST(round(l_discount * 1000) AS BIGINT) AS c, CAST(round(l_tax * 1000) AS BIGINT) AS w, l_linenumber * 2 AS o, CAST(round(l_quantity / 5) AS BIGINT) AS r, l_suppkey % 100 = 3 AS split FROM lineitem) "
    "SELECT event_id, unnest(list_filter([CASE WHEN c + w > i THEN 'cached-exceeds-input' END, CASE WHEN r > o THEN 'reasoning-exceeds-output' END, CASE WHEN bare THEN 'timestamp-without-zone' END, CASE WHEN broken THEN 'newline-in-event-id' END, CASE WHEN split THEN 'newline-in-attempt-id' END], lambda x: x IS NOT NULL)) AS problem FROM e"
)
def event_usage_violations(spark, folder):
    """VAL1 to VAL3: lines as events, of which some break the rules of usage."""
    n = lambda c: c.cast("long")
    line = V.table(spark, folder, "lineitem")
    events = line.select(
        F.concat(F.col("l_orderkey"), F.when(F.col("l_partkey") % 97 == 0, "\n").otherwise("/"), F.col("l_linenumber")).alias("event_id"), F.concat(F.lit("t"), F.col("l_orderkey")).alias("task_id"), F.when(F.col("l_suppkey") % 100 == 3, "a\r1").otherwise("a1").alias("attempt_id"),
        F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T00:00:00"), F.element_at(F.array(F.lit(""), F.lit("Z"), F.lit("+02:00"), F.lit("-0530")), (F.col("l_suppkey") % 4 + 1).cast("int"))).alias("stamp"),
        n(F.round(F.col("l_quantity") * 10)).alias("input_tokens"), n(F.round(F.col("l_discount") * 1000)).alias("cached_tokens"), n(F.round(F.col("l_tax") * 1000)).alias("cache_write_tokens"), n(F.col("l_linenumber") * 2).alias("output_tokens"), n(F.round(F.col("l_quantity") / 5)).alias("reasoning_tokens"),
    )
    return G.event_problems(events)


RECORD_SQL = (
    """'{"id": ' || event_id || ', "usage": {"input_tokens": 1}, "fingerprints": {"system_prompt": "hmac-sha256:0"}, "content_features": {"prompt": {"headers": 3}}' """
    """|| CASE WHEN event_id % 7 = 0 THEN ', "scope": {"tenant_id": "x"}' ELSE '' END || ', "note": "say \\\\"prompt\\\\": {"' || CASE WHEN event_id % 13 = 0 THEN ', "prompt": "secret"' ELSE '' END """
    """|| ', "steps": ' || repeat('[{"deep": ', CAST(event_id % 50 AS INTEGER)) || CASE WHEN event_id % 11 = 0 THEN '{"headers": [], "content_features": [{"api_key": 1}]}' ELSE '1' END || repeat('}]', CAST(event_id % 50 AS INTEGER)) || '}'"""
)


@query(
    f"SELECT DISTINCT event_id AS id, t.key AS found FROM (SELECT event_id, {RECORD_SQL.replace(chr(92) * 2, chr(92))} AS record FROM events) e, json_tree(record) t WHERE t.key IN ({', '.join(map(repr, fixed.FORBIDDEN_KEYS))}) AND NOT regexp_matches(t.path, '[.]({'|'.join(fixed.MEASUREMENT_PARTS)})([.]|\\[|$)')"
)
def contentless_check(spark, folder):
    """PRJ19, VAL13: names that a stored record must not have, at any depth but below measurements; records nest up to 100 levels."""
    return G.forbidden_keys(V.table(spark, folder, "events").select("event_id", F.parse_json(F.expr(RECORD_SQL)).alias("v")), "event_id")


_PADS = ["".join(f"\\x{b ^ x:02X}" for b in b"house key".ljust(64, b"\0")) for x in (0x36, 0x5C)]


@query(f"SELECT doc_id, CASE WHEN text <> '' THEN 'hmac-sha256:' || sha256('{_PADS[1]}'::BLOB || unhex(sha256('{_PADS[0]}'::BLOB || encode(text)))) END AS fingerprint FROM documents")
def keyed_fingerprints(spark, folder):
    """HLP34, VAL6: whole texts as keyed fingerprints."""
    out = V.table(spark, folder, "documents").select("doc_id", G.keyed_fingerprint(F.col("text"), b"house key").alias("fingerprint"))
    return out.where(G.is_keyed(F.col("fingerprint")))


# Capabilities and identity

NAMES = ["GPT 4.1", "claude_sonnet-4", "Whisper-1", "nobody", "grok 4.6", "Flux.1 Kontext Pro", "text-embedding-3-small", ""]


@query(
    f"WITH known AS (SELECT regexp_replace(lower(alias), '[^a-z0-9]+', '', 'g') AS k, modality, ptu_eligible, bases FROM {values([(a, m, p, b) for _, aliases, m, b, _, p in fixed.CAPABILITIES for a in aliases], 'alias, modality, ptu_eligible, bases')} QUALIFY row_number() OVER (PARTITION BY k) = 1), "
    f"asked AS (SELECT p_partkey, ({NAMES!r})[p_partkey % 8 + 1] AS model_name, CASE WHEN p_size % 10 = 0 THEN 'video' ELSE 'unknown' END AS own FROM part) "
    "SELECT p_partkey, CASE WHEN own <> 'unknown' THEN own ELSE coalesce(modality, 'unknown') END AS modality, CASE WHEN own = 'unknown' THEN ptu_eligible END AS ptu_eligible, CASE WHEN own = 'unknown' AND modality IS NOT NULL THEN 'verified' ELSE 'unknown' END AS capability_status, CASE WHEN own = 'unknown' THEN len(bases) ELSE NULL END AS bases FROM asked LEFT JOIN known ON regexp_replace(lower(model_name), '[^a-z0-9]+', '', 'g') = k"
)
def model_capabilities(spark, folder):
    """PRJ16, PRJ17, VAL8: exact names only; what a row says itself stays."""
    rows = V.table(spark, folder, "part").select("p_partkey", V.pick(NAMES, F.col("p_partkey") % 8).alias("model_name"), F.when(F.col("p_size") % 10 == 0, "video").otherwise("unknown").alias("modality"))
    out = L.with_capability(rows)
    return out.select("p_partkey", "modality", "ptu_eligible", "capability_status", F.nullif(F.size("usage_bases"), F.lit(0)).cast("long").alias("bases"))


OFFERS = ["GlobalStandard", "Data Zone Standard", "standard", "Provisioned-Managed", "global_provisioned managed", "My Batch", "StandardPlus", "odd"]
MAKERS = ["gpt-5", "Claude Opus 4", "mistral-large", "nobody", "Meta Llama 3"]
_STARTS = "CASE " + " ".join(f"WHEN o = '{n}' THEN '{m}'" for n, m in fixed.OFFER_MODES) + " " + " ".join(f"WHEN starts_with(o, '{n}') OR ends_with(o, '{n}') THEN '{m}'" for n, m in fixed.OFFER_MODES) + " ELSE 'unknown' END"
_FAMILY = "CASE p " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.FAMILIES.items()) + " ELSE 'unknown' END"


@query(
    f"WITH a AS (SELECT s_suppkey, regexp_replace(lower(({OFFERS!r})[s_suppkey % 9 + 1]), '[\\s_-]+', '', 'g') AS o, regexp_replace(lower(({MAKERS!r})[s_suppkey % 5 + 1]), '[\\s_-]+', '-', 'g') AS canonical FROM supplier), b AS (SELECT *, {S.PUBLISHER_SQL} AS p FROM a) "
    f"SELECT s_suppkey, CASE WHEN o IS NULL OR o = '' THEN 'unknown' ELSE {_STARTS} END AS mode, {_FAMILY} AS family FROM b"
)
def offer_modes(spark, folder):
    """PRJ22, PRJ23, VAL9: offers that aren't recognised stay unknown."""
    s = V.table(spark, folder, "supplier")
    offer = F.get(F.array(*[F.lit(x) for x in OFFERS]), (F.col("s_suppkey") % 9).cast("int"))
    return s.select("s_suppkey", G.stated_mode(L.offer_mode(offer)).alias("mode"), L.provider_family(V.pick(MAKERS, F.col("s_suppkey") % 5)).alias("family"))


@query(
    f"WITH {S.REQUEST_TRACES_SQL}, seen AS (SELECT DISTINCT deployment_name, model_name, CASE WHEN ingest_seq % 2 = 0 THEN 'v1' ELSE 'v2' END AS model_version FROM traces), "
    "listed AS (SELECT 'DEP-' || (n_nationkey % 6) AS name, n_nationkey AS seq, CASE WHEN n_nationkey % 2 = 0 THEN 'phi-4' ELSE 'gpt-4.1' END AS model, CASE WHEN n_nationkey % 3 = 0 THEN 'v1' END AS model_version FROM nation QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY n_nationkey DESC) = 1) "
    "SELECT deployment_name, 'model' AS kind, l.model AS listed, s.model_name AS measured FROM seen s JOIN listed l ON lower(l.name) = s.deployment_name WHERE s.model_name <> 'unknown' AND s.model_name <> l.model GROUP BY ALL "
    "UNION ALL SELECT deployment_name, 'version', l.model_version, s.model_version FROM seen s JOIN listed l ON lower(l.name) = s.deployment_name WHERE s.model_version <> l.model_version GROUP BY ALL"
)
def inventory_conflicts(spark, folder):
    """J12: the metrics' model and version against an inventory."""
    seen = V.request_traces(spark, folder).select("deployment_name", "model_name", F.when(F.col("ingest_seq") % 2 == 0, "v1").otherwise("v2").alias("model_version"))
    n = F.col("n_nationkey")
    listed = V.table(spark, folder, "nation").select(F.concat(F.lit("DEP-"), n % 6).alias("name"), n.alias("seq"), F.when(n % 2 == 0, "phi-4").otherwise("gpt-4.1").alias("model"), F.when(n % 3 == 0, "v1").alias("model_version"))
    return L.inventory_conflicts(seen, listed)


@query(
    "WITH s AS (SELECT 'dep-' || (user_id % 5) AS deployment_name, event_id AS seq, CASE WHEN event_id % 4 <> 1 THEN event_type END AS model, CASE WHEN event_id % 3 = 0 THEN 'v' || (event_id % 2) END AS version FROM events), "
    "f AS (SELECT deployment_name, arg_min(model, seq) FILTER (model <> '') AS model, arg_min(version, seq) FILTER (version <> '') AS version FROM s GROUP BY 1) "
    "SELECT DISTINCT s.deployment_name, 'model' AS kind, f.model AS first, s.model AS other FROM s JOIN f USING (deployment_name) WHERE s.model <> f.model UNION ALL SELECT DISTINCT s.deployment_name, 'version', f.version, s.version FROM s JOIN f USING (deployment_name) WHERE s.version <> f.version"
)
def identity_conflicts(spark, folder):
    """HLP22, HLP23: the first stated model and version of each deployment, and what disagrees."""
    n = F.col("event_id")
    rows = V.table(spark, folder, "events").select(L.resolved_deployment(F.concat(F.lit("dep-"), F.col("user_id") % 5), ["a", "b"]).alias("deployment_name"), n.alias("seq"), F.when(n % 4 != 1, F.col("event_type")).alias("model"), F.when(n % 3 == 0, F.concat(F.lit("v"), n % 2)).alias("version"))
    return L.merged_identity(rows)[1]


_METRIC_ROWS = values(fixed.METRICS, "metric, field, aggregation, priority, filterable, has_status")


@query(
    f"WITH m AS (SELECT *, row_number() OVER (ORDER BY field, priority) - 1 AS nth FROM {_METRIC_ROWS}), d AS (SELECT s_suppkey AS resource, m.*, CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ['ModelDeploymentName', 'StatusCode'] ELSE ['StatusCode'] END AS dims FROM supplier, m WHERE (s_suppkey + nth) % 3 <> 0), "
    "u AS (SELECT *, CASE WHEN dims IS NULL THEN filterable ELSE list_contains(dims, 'ModelDeploymentName') END AS can FROM d) "
    "SELECT resource, field, metric, aggregation, CAST(priority AS INTEGER) AS priority, dims IS NOT NULL AND list_contains(dims, 'StatusCode') AS status_dimensioned, CASE WHEN NOT can THEN 'metric definition does not support a ModelDeploymentName filter' END AS reason, "
    "can AND priority = min(priority) FILTER (can) OVER (PARTITION BY resource, field) AS chosen FROM u"
)
def metric_choices(spark, folder):
    """J18, HLP26, HLP27: what each resource offers against what is wanted; the first candidate by priority wins."""
    order = sorted(fixed.METRICS, key=lambda m: (m[1], m[3]))
    s = V.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("resource"))
    dims = F.when(F.col("resource") % 3 == 1, F.array(F.lit("ModelDeploymentName"), F.lit("StatusCode"))).when(F.col("resource") % 3 == 2, F.array(F.lit("StatusCode")))
    offered = s.select("resource", dims.alias("dimensions"), F.explode(F.array(*[F.struct(F.lit(i).alias("nth"), F.lit(m[0]).alias("name")) for i, m in enumerate(order)])).alias("o")).select("resource", "dimensions", "o.*").where((F.col("resource") + F.col("nth")) % 3 != 0)
    return L.metric_choices(offered.drop("nth"))


@query(
    "SELECT 'deployment:' || lower(replace(s_name, '#', '-')) AS workload_id, s_name AS workload_name, 'technical' AS workload_scope, 'needs_configuration' AS configuration_status, 'house-1/' || lower(replace(s_name, '#', '-')) AS internal_key, CASE WHEN s_suppkey % 3 = 0 AND s_nationkey % 2 = 0 THEN 'configured' WHEN s_suppkey % 3 = 0 THEN 'configured' ELSE 'partially_configured' END AS mapped_status FROM supplier"
)
def default_workloads(spark, folder):
    """HLP15, HLP16, PRJ29: suppliers as deployments without mappings."""
    s = V.table(spark, folder, "supplier")
    out = L.default_workloads(s, "s_name", "house-1")
    status = L.configuration_status(F.col("s_name"), F.when(F.col("s_suppkey") % 3 == 0, "prod"), F.when(F.col("s_nationkey") % 2 == 0, "sales"))
    mapped = s.select(F.col("s_name").alias("workload_name"), status.alias("mapped_status"))
    return out.join(mapped, "workload_name").select("workload_id", "workload_name", "workload_scope", "configuration_status", "internal_key", "mapped_status")


@query("SELECT DISTINCT p_brand AS model, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'o200k' ELSE 'utf8_bytes' END AS encoding, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'bpe' ELSE 'utf8_byte_heuristic' END AS method, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'exact' ELSE 'low' END AS confidence FROM part")
def token_provenance(spark, folder):
    """TOK7: how the tokens of each model are counted."""
    return tokenizer_provenance(V.table(spark, folder, "part").select("p_brand").distinct(), {"brand#1": "o200k", "brand#2": "o200k"}, "p_brand")


# Readiness

_SLICES = S.slice_sql("deployment_name, model_name, deployment_mode, canonical")


@query(
    f"WITH {S.PRICED_SQL}{_SLICES}, m AS (SELECT *, CASE WHEN deployment_name = 'dep-1' THEN 'video' ELSE 'text' END AS modality FROM summary) SELECT deployment_name, deployment_mode, "
    "CASE WHEN lower(trim(model_name)) IN ('', 'unknown', 'none') THEN 'missing_blocking' WHEN modality = 'video' AND total_tokens_state = 'unavailable' THEN 'not_applicable' WHEN total_tokens_state = 'unavailable' THEN 'missing_actionable' WHEN estimated_cost_usd IS NOT NULL AND unresolved_requests = 0 THEN 'available' WHEN estimated_cost_usd IS NOT NULL OR pricing_status = 'usage_incomplete' THEN 'partial' ELSE 'missing_actionable' END AS status, "
    "CASE WHEN lower(trim(model_name)) IN ('', 'unknown', 'none') THEN 'Model identity missing' WHEN modality = 'video' AND total_tokens_state = 'unavailable' THEN 'Token pricing not applicable' WHEN total_tokens_state = 'unavailable' THEN 'Token usage unavailable' WHEN estimated_cost_usd IS NOT NULL AND unresolved_requests = 0 THEN 'Priced' WHEN estimated_cost_usd IS NOT NULL THEN 'Partly priced' "
    "WHEN pricing_status = 'usage_incomplete' THEN 'Exact rate found; usage incomplete' WHEN pricing_status = 'currency_mismatch' THEN 'Currency mismatch' ELSE 'Exact rate missing' END AS label FROM m"
)
def model_pricing_states(spark, folder):
    """DQ5: identity, usage and rates are told apart."""
    rows = rollups.deployment_rollup(K.priced(spark, folder)).withColumn("modality", F.when(F.col("deployment_name") == "dep-1", "video").otherwise("text"))
    return R.model_pricing_states(rows).select("deployment_name", "deployment_mode", "pricing_state.*")


@query(
    "WITH " + S.ATTRIBUTED_SQL + S.workloads_sql("business_id, assigned", "coalesce(workload_id, 'unassigned') AS business_id, workload_id IS NOT NULL AS assigned") + ", j AS (SELECT *, coalesce(total_tokens, 0) AS t, requests > 0 AS asked FROM workload_rollup) SELECT business_id, "
    "CASE WHEN t > 0 AND identity_unresolved_tokens >= t THEN 'missing_blocking' WHEN total_tokens_state = 'partial' THEN 'missing_actionable' WHEN estimated_cost IS NOT NULL AND unpriced_tokens = 0 THEN 'available' WHEN estimated_cost IS NOT NULL THEN 'partial' WHEN total_tokens_state = 'unavailable' AND asked THEN 'missing_actionable' WHEN total_tokens_state = 'unavailable' THEN 'not_measured' WHEN t = 0 AND NOT asked THEN 'not_measured' WHEN t = 0 THEN 'available' ELSE 'missing_actionable' END AS status, "
    "CASE WHEN t > 0 AND identity_unresolved_tokens >= t THEN 'Model identity missing' WHEN total_tokens_state = 'partial' THEN 'Usage metrics incomplete' WHEN estimated_cost IS NOT NULL AND unpriced_tokens = 0 THEN 'Priced' WHEN estimated_cost IS NOT NULL THEN 'Partly priced' WHEN total_tokens_state = 'unavailable' AND asked THEN 'Usage metric unavailable' WHEN total_tokens_state = 'unavailable' THEN 'Token usage unavailable' WHEN t = 0 AND NOT asked THEN 'No traffic in this window' WHEN t = 0 THEN 'Requests observed, zero measured tokens' ELSE 'Exact rate missing' END AS label FROM j"
)
def workload_pricing_states(spark, folder):
    """DQ6."""
    rows = W.business_workloads(K.attributed(spark, folder)).withColumn("modality", F.lit("text"))
    return R.workload_pricing_states(rows).select("business_id", "pricing_state.*")


ASKED = ["phi-4", "MAI Thinking_1", "mai-ds-r1", "gpt-4.1", "unknown", "thinking house", "nobody"]
MODES = ["global", "regional", "unknown", None]


@query(
    f"WITH prices(kind, catalog, name, match, seq, confidence, region, starts, ends, context_min, context_max, input_rate, cached_rate, output_rate, source_rank) AS (VALUES {S._rows()}), "
    f"asked AS (SELECT s_suppkey, ({ASKED!r})[s_suppkey % 7 + 1] AS model, (['global', 'regional', 'unknown', NULL])[s_suppkey % 4 + 1] AS mode FROM supplier), "
    "a AS (SELECT *, regexp_replace(lower(model), '[\\s_-]+', '-', 'g') AS canonical, CASE WHEN coalesce(mode, 'unknown') = 'unknown' THEN 'global' ELSE mode END AS wanted FROM asked), "
    "hits AS (SELECT a.s_suppkey, p.kind, p.catalog FROM a JOIN prices p ON a.canonical = p.name AND (p.region = a.wanted OR p.region IS NULL)) "
    "SELECT 'd' || a.s_suppkey AS deployment, CASE WHEN model = 'unknown' THEN 'identity_unresolved' WHEN bool_or(kind = 'customer') THEN 'customer_override' WHEN bool_or(kind = 'reference') THEN 'exact_public_rate' ELSE 'rate_unavailable' END AS state, "
    "CASE WHEN model <> 'unknown' THEN coalesce(min(catalog) FILTER (kind = 'customer'), min(catalog)) END AS catalog_name, CASE WHEN model <> 'unknown' AND count(kind) = 0 THEN any_value(canonical) END AS override_key FROM a LEFT JOIN hits h ON a.s_suppkey = h.s_suppkey GROUP BY a.s_suppkey, model"
)
def pricing_readiness(spark, folder):
    """J23, FLT18, HLP46: can each deployment be priced, before anything is collected."""
    n = F.col("s_suppkey")
    rows = V.table(spark, folder, "supplier").select(F.concat(F.lit("d"), n).alias("deployment"), V.pick(ASKED, n % 7).alias("model"), F.lit(None).cast("string").alias("model_version"), F.get(F.array(*[F.lit(m).cast("string") for m in MODES]), (n % 4).cast("int")).alias("deployment_mode"))
    own, reference = K.catalogs(spark)
    return R.pricing_readiness(rows, own, reference).select("deployment", "state", "catalog_name", "override_key")


@query(
    f"WITH {S.PRICED_SQL}{_SLICES} SELECT deployment_name, deployment_mode, 'house;{fixed.REFERENCE_CATALOG['name']}' AS catalogs_consulted, CASE WHEN estimated_cost_usd IS NOT NULL THEN pricing_catalog_name END AS catalog_selected, "
    f"CASE WHEN estimated_cost_usd IS NOT NULL AND pricing_catalog_name = '{fixed.REFERENCE_CATALOG['name']}' THEN '{fixed.REFERENCE_CATALOG['retrieved_at']}' END AS retrieved_at, CASE WHEN pricing_catalog_name = '{fixed.REFERENCE_CATALOG['name']}' THEN '{fixed.REFERENCE_CATALOG['basis']}' WHEN pricing_catalog_name = 'house' THEN 'effective_period' END AS pricing_basis FROM summary"
)
def pricing_provenance(spark, folder):
    """DQ3: catalogs consulted against the one selected."""
    out = R.pricing_provenance(rollups.deployment_rollup(K.priced(spark, folder)), K.catalogs(spark))
    return out.select("deployment_name", "deployment_mode", F.array_join("catalogs_consulted", ";").alias("catalogs_consulted"), "catalog_selected", "retrieved_at", "pricing_basis")


@query(
    "WITH p AS (SELECT 'part ' || p_partkey AS model, CASE WHEN p_partkey % 4 = 0 THEN DATE '2026-01-01' + CAST(p_size AS INTEGER) END AS ends, p_partkey % 5 = 0 AS bare FROM part) "
    "SELECT 'parts' AS catalog, 'expired' AS problem, model FROM p WHERE ends < DATE '2026-01-20' UNION ALL SELECT 'parts', 'not-labelled-customer', model FROM p WHERE bare UNION ALL SELECT 'parts', 'currency-differs', NULL"
)
def catalog_problems(spark, folder):
    """VAL5, VAL12: parts as a customer's catalog in another currency, some of its entries expired or unlabelled."""
    n = F.col("p_partkey")
    part = V.table(spark, folder, "part")
    entries = part.select(F.concat(F.lit("part "), n).alias("model"), F.when(n % 4 == 0, F.date_add(F.lit("2026-01-01").cast("date"), F.col("p_size"))).alias("effective_to"), F.when(n % 5 != 0, "customer_override").otherwise("verified").alias("confidence"))
    return R.catalog_problems([P.Catalog("parts", "customer", entries, " eur ")], date(2026, 1, 20))


# Capacity dashboard


def capacity_rows(spark, folder) -> DataFrame:
    """One row a deployment with all that the dashboard needs."""
    traces = V.request_traces(spark, folder)
    summary = rollups.slice_summary(K.priced(spark, folder), ["deployment_name"]).select("deployment_name", "input_tokens_state", "output_tokens_state", "pricing_status", "total_tokens")
    models = traces.groupBy("deployment_name").agg(F.min("model_name").alias("model_name"), F.min("deployment_mode").alias("deployment_mode"))
    facts = L.with_capability(models).join(F.broadcast(C.capacities(spark)), canonical_model(F.col("model_name")) == F.col("canonical"), "left").select("deployment_name", "model_name", "deployment_mode", "ptu_eligible", "quota")
    shape = C.series_shape(K.usage_series(spark, folder), KEY)
    advice = C.dimensions(shape.join(facts.select("deployment_name", "quota"), "deployment_name"), C.latency_shape(traces, KEY), KEY).select("deployment_name", "recommendation")
    days = H.usage_days(V.metric_buckets(spark, folder), KEY).drop("active_buckets")
    return facts.join(summary, "deployment_name").join(advice, "deployment_name").join(days, "deployment_name").join(shape.select("deployment_name", F.col("active").alias("active_buckets")), "deployment_name")


_DIMENSIONS = K.ORACLE_SQL["capacity_dimensions"]
_ALIASES = values([(a, m, p) for m, aliases, _, _, _, p in fixed.CAPABILITIES for a in aliases], "alias, canonical, ptu")
DASHBOARD_SQL = (
    f"WITH {S.PRICED_SQL}{S.slice_sql('deployment_name')}, advice AS ({_DIMENSIONS}), models AS (SELECT deployment_name, min(model_name) AS model_name, min(deployment_mode) AS mode FROM traces GROUP BY 1), "
    "active AS (SELECT deployment_name, count(DISTINCT floor(epoch(ts) / 300)) AS active FROM traces GROUP BY 1), "
    f"known AS (SELECT m.*, CASE WHEN deployment_name = 'dep-3' THEN 720000 END AS quota, ptu, regexp_replace(lower(trim(model_name)), '[\\s_-]+', '-', 'g') AS canonical FROM models m LEFT JOIN (SELECT regexp_replace(lower(alias), '[^a-z0-9]+', '', 'g') AS k, ptu FROM {_ALIASES}) a ON a.k = regexp_replace(lower(model_name), '[^a-z0-9]+', '', 'g')), "
    f"j AS (SELECT k.*, s.*EXCLUDE deployment_name, a.recommendation AS advice, c.active, {S.PUBLISHER_SQL} AS publisher, lower(trim(model_name)) NOT IN ('', 'unknown', 'none') AS identified, input_tokens_state = 'measured' AND output_tokens_state = 'measured' AS whole FROM known k JOIN summary s USING (deployment_name) JOIN advice a USING (deployment_name) JOIN active c USING (deployment_name)), "
    "e AS (SELECT *, coalesce(NOT ptu, false) AS barred, coalesce(publisher <> 'microsoft', false) AS other, active >= 100 AND whole AS enough FROM j), "
    "f AS (SELECT *, CASE WHEN NOT identified THEN 'collection_identity_error' WHEN barred OR (quota IS NULL AND other) THEN 'ptu_not_applicable' WHEN quota IS NULL THEN 'model_capacity_unavailable' WHEN mode NOT IN ('global', 'regional') THEN 'deployment_mode_unavailable' WHEN NOT enough THEN 'eligible_insufficient_evidence' WHEN pricing_status <> 'priced' THEN 'pricing_unavailable' ELSE 'eligible_sufficient_evidence' END AS eligibility_status, "
    "CASE WHEN NOT identified THEN 'Collection identity error' WHEN barred OR (quota IS NULL AND other) THEN 'PTU not applicable' ELSE advice END AS recommendation FROM e), "
    "g AS (SELECT *, CASE WHEN NOT identified THEN 'collection_identity_error' WHEN eligibility_status = 'ptu_not_applicable' THEN 'ptu_not_applicable' WHEN NOT enough THEN 'insufficient_evidence' WHEN eligibility_status = 'model_capacity_unavailable' THEN 'capacity_unavailable' WHEN eligibility_status = 'pricing_unavailable' THEN 'pricing_unavailable' WHEN eligibility_status = 'deployment_mode_unavailable' THEN 'insufficient_evidence' "
    "WHEN recommendation = 'PTU recommended' THEN 'ptu_recommended' WHEN recommendation = 'Borderline' THEN 'borderline' WHEN recommendation = 'PAYG recommended' THEN 'payg_recommended' ELSE 'insufficient_evidence' END AS state, "
    "array_to_string(list_filter([CASE WHEN quota IS NULL AND identified AND eligibility_status <> 'ptu_not_applicable' THEN 'Capacity data required' END, CASE WHEN NOT whole AND eligibility_status <> 'ptu_not_applicable' THEN 'Token usage data required' END, CASE WHEN pricing_status <> 'priced' AND eligibility_status <> 'ptu_not_applicable' THEN 'Pricing required' END], lambda x: x IS NOT NULL), ';') AS secondary_blockers FROM f)"
)


@query(DASHBOARD_SQL + " SELECT deployment_name, eligibility_status, state, recommendation, secondary_blockers FROM g")
def capacity_dashboard(spark, folder):
    """CAP1, CAP4, J21: eligibility, headline and blockers of each deployment."""
    return H.assessments(capacity_rows(spark, folder)).select("deployment_name", "eligibility_status", "state", "recommendation", F.array_join("secondary_blockers", ";").alias("secondary_blockers"))


@query(
    DASHBOARD_SQL + " SELECT count(*) FILTER (recommendation = 'PTU recommended') AS recommended_deployments, count(*) FILTER (recommendation = 'Borderline') AS borderline_deployments, count(*) FILTER (recommendation = 'PAYG recommended') AS payg_deployments, "
    "count(*) FILTER (recommendation IN ('Insufficient evidence', 'Capacity data required', 'PTU not applicable', 'Collection identity error')) AS insufficient_deployments FROM g"
)
def capacity_portfolio(spark, folder):
    """AGG31."""
    return H.portfolio(H.assessments(capacity_rows(spark, folder)))


@query(
    f"WITH {S.METRIC_BUCKETS_SQL}, slots AS (SELECT deployment_name, bucket, bucket // 86400 AS day, sum(input_tokens) AS i, sum(output_tokens) AS o, sum(requests) AS n, sum(throttled_requests) AS limited, sum(successful_requests) AS ok, sum(failed_requests) AS bad, bool_or(coalesce(input_tokens, 0) + coalesce(output_tokens, 0) > 0 OR requests > 0) AS busy, bool_and(input_tokens + output_tokens IS NOT NULL) AS whole FROM buckets GROUP BY 1, 2, 3), "
    "span AS (SELECT deployment_name, min(bucket) AS a, max(bucket) + 300 AS z, bool_and(whole) AS all_whole FROM slots GROUP BY 1), "
    "days AS (SELECT deployment_name, day, count(*) FILTER (busy) AS busy, count(*) FILTER (whole) AS whole, sum(i + o) FILTER (whole) AS tokens, a > day * 86400 OR z < (day + 1) * 86400 - 300 AS partial, all_whole FROM slots JOIN span USING (deployment_name) GROUP BY ALL), "
    "totals AS (SELECT deployment_name, CAST(sum(n) AS BIGINT) AS total_requests, CAST(sum(limited) AS BIGINT) AS rate_limited_requests, CAST(sum(ok) AS BIGINT) AS successful_requests, CAST(sum(bad) AS BIGINT) AS other_failed_requests FROM slots GROUP BY 1), "
    "counted AS (SELECT deployment_name, count(*) FILTER (busy > 0) AS active_days, count(*) FILTER (whole > 0 AND NOT partial) AS complete_days, count(*) FILTER (whole > 0 AND partial) AS partial_days, CASE WHEN bool_and(all_whole) THEN round(sum(tokens) / count(*) FILTER (whole > 0), 1) END AS daily_average_tokens FROM days GROUP BY 1) "
    "SELECT *, round(rate_limited_requests / total_requests * 100, 2) AS rate_limit_percent FROM totals JOIN counted USING (deployment_name)"
)
def capacity_usage_days(spark, folder):
    """AGG29, AGG30, FLT13, HLP50: totals of requests and outcomes, complete and partial days."""
    out = H.usage_days(V.metric_buckets(spark, folder), KEY)
    return out.select("deployment_name", "total_requests", "rate_limited_requests", "successful_requests", "other_failed_requests", "active_days", "complete_days", "partial_days", "daily_average_tokens", "rate_limit_percent")


# Manifests and findings

A, Z = 1704067200, 1704067200 + 20 * 86400


@query(
    f"WITH {S.METRIC_BUCKETS_SQL}, kept AS (SELECT * FROM buckets WHERE bucket >= {A} AND bucket < {Z}), n AS (SELECT deployment_name, " + ", ".join(f"count({f}) AS {f}" for f in M.FIELDS) + f" FROM kept GROUP BY 1), flat AS (UNPIVOT n ON {', '.join(M.FIELDS)} INTO NAME field VALUE points_reported) "
    f"SELECT deployment_name, field, points_reported, CAST({(Z - A) // 300} AS BIGINT) AS expected_points, round(least(100, points_reported / {(Z - A) // 300} * 100), 1) AS percent, CASE WHEN points_reported >= {(Z - A) // 300} THEN 'complete' ELSE 'partial' END AS state FROM flat WHERE points_reported > 0"
)
def manifest_field_coverage(spark, folder):
    """AGG32: points of each field in a window of twenty days."""
    return M.field_coverage(V.metric_buckets(spark, folder), KEY, A, Z)


@query(
    f"WITH {S.METRIC_BUCKETS_SQL} SELECT deployment_name, CAST({(Z - A) // 300} AS BIGINT) AS expected_buckets, count(DISTINCT bucket) AS observed_buckets, count(*) FILTER (coalesce(input_tokens, 0) + coalesce(output_tokens, 0) > 0 OR requests > 0) AS active_buckets, count(DISTINCT bucket // 86400) AS observed_days, min(bucket) AS returned_start, max(bucket) + 300 AS returned_end FROM buckets WHERE bucket >= {A} AND bucket < {Z} GROUP BY 1"
)
def deployment_manifest(spark, folder):
    """AGG32, HLP1: what a collection's window has brought."""
    return M.deployment_manifest(V.metric_buckets(spark, folder), KEY, A, Z)


@query(f"WITH {S.METRIC_BUCKETS_SQL} SELECT count(*) AS buckets, count(*) FILTER (coalesce(input_tokens, 0) + coalesce(output_tokens, 0) > 0 OR requests > 0) AS active_buckets, CAST(5760 AS BIGINT) AS expected_buckets, CASE WHEN bool_and(outcome_coverage = 'complete') THEN 'complete' WHEN bool_or(outcome_coverage = 'complete') THEN 'partial' ELSE 'unavailable' END AS outcome_coverage FROM buckets")
def collection_summary(spark, folder):
    """AGG43."""
    return M.collection_summary(V.metric_buckets(spark, folder), 5760)


@query(f"WITH {S.REQUEST_TRACES_SQL}, mapped AS (SELECT *, CAST(ingest_seq % 4000 AS VARCHAR) AS event_id FROM traces WHERE model_name <> 'unknown') SELECT (SELECT count(*) FROM traces) AS records_seen, count(*) AS records_mapped, (SELECT count(*) FROM traces) - count(*) AS records_skipped, count(*) - count(DISTINCT event_id) AS duplicates_skipped, epoch_us(min(ts)) AS requested_start, epoch_us(max(ts)) AS requested_end FROM mapped")
def request_manifest(spark, folder):
    """AGG35, SRT9: an import's counts."""
    seen = V.request_traces(spark, folder)  # all of it: a cap is a caller's choice (manifests.capped)
    mapped = seen.where("model_name <> 'unknown'").withColumn("event_id", (F.col("ingest_seq") % 4000).cast("string"))
    return M.request_manifest(seen, mapped).withColumns({"requested_start": F.unix_micros("requested_start"), "requested_end": F.unix_micros("requested_end")})


_CATEGORY = "CASE WHEN impact_max_percent IS NULL THEN 'Evaluation opportunity' WHEN rule_id <> 'TL007' AND coalesce(nullif(max_savings, 0), min_savings, 0) < 1000 THEN 'Low absolute volume' WHEN impact_max_percent >= 10 THEN 'Major' WHEN impact_max_percent >= 5 THEN 'High' WHEN impact_max_percent >= 1 THEN 'Moderate' ELSE 'Low materiality' END"


@query(f"WITH {K.impact_sql()} SELECT rule_id, impact_max_percent, {_CATEGORY} AS impact_category FROM judged")
def impact_categories(spark, folder):
    """TLCAT: the category of each finding's impact."""
    return M.impact_category(K.impacts(spark, folder)).select("rule_id", "impact_max_percent", "impact_category")


@query(f"WITH {K.impact_sql(30, 10_000_000)} SELECT rule_id, severity, CAST(row_number() OVER (ORDER BY {K.FINDING_ORDER}) AS INTEGER) AS place FROM judged WHERE NOT material")
def immaterial_findings(spark, folder):
    """SRT4, with a bar of 30 % so that some are below it."""
    return M.immaterial_findings(K.impacts(spark, folder, min_percent=30, min_tokens=10_000_000)).select("rule_id", "severity", "place")


_SERVICE = {"TL001": "cache", "TL005": "gateway", "TL007": "cache", "TL006": "limits", "TL002": "memory", "TL003": "limits", "TL004": "search", "TL008": "router"}


@query(
    f"WITH {K.impact_sql()}, s AS (SELECT *, CASE rule_id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SERVICE.items()) + f" END AS service FROM judged), one AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY service ORDER BY {K.FINDING_ORDER}) = 1) SELECT service, rule_id, CAST(row_number() OVER (ORDER BY {K.FINDING_ORDER}) AS INTEGER) AS place FROM one QUALIFY place <= 3"
)
def top_recommendations(spark, folder):
    """SRT5: the first findings, one for each service."""
    service = F.element_at(F.create_map(*[F.lit(x) for pair in _SERVICE.items() for x in pair]), F.col("rule_id"))
    return M.top_recommendations(K.impacts(spark, folder).withColumn("service", service), "service").select("service", "rule_id", "place")


def opportunity_sql(requests: str) -> str:
    return (
        f"(WITH found AS ({K.run_sql().replace(V.CONVERSATIONS_SQL, requests)}), t AS (WITH {requests} SELECT deployment_name, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens FROM requests GROUP BY 1), "
        "b AS (SELECT * FROM found WHERE status = 'finding' AND rule_id <> 'TL007' AND min_savings IS NOT NULL QUALIFY row_number() OVER (PARTITION BY deployment_name ORDER BY coalesce(max_savings, min_savings) DESC, rule_id) = 1) "
        "SELECT deployment_name, input_tokens, least(coalesce(min_savings, 0), input_tokens) AS lo, least(coalesce(max_savings, min_savings, 0), input_tokens) AS hi FROM t LEFT JOIN b USING (deployment_name))"
    )


def opportunities(rows: DataFrame) -> DataFrame:
    totals = rows.groupBy(*KEY).agg(F.sum("input_tokens").alias("input_tokens"), F.count(F.lit(1)).alias("requests"))
    return M.largest_opportunity(Q.with_impact(Q.evaluate(rows, KEY), totals, KEY).drop("input_tokens"), totals, KEY)


@query(f"SELECT deployment_name, lo AS addressable_min_tokens, greatest(lo, hi) AS addressable_max_tokens, round(greatest(lo, hi) / greatest(1, input_tokens) * 100, 1) AS addressable_max_percent FROM {opportunity_sql(V.CONVERSATIONS_SQL)}")
def largest_opportunity(spark, folder):
    """AGG26: the largest single saving of each deployment."""
    return opportunities(K.raw_requests(spark, folder))


_EVEN = V.CONVERSATIONS_SQL.replace("FROM sent)", "FROM sent WHERE conv_id % 2 = 0)")
_ODD = V.CONVERSATIONS_SQL.replace("FROM sent)", "FROM sent WHERE conv_id % 2 = 1)")
_PERCENT = "deployment_name, round(greatest(lo, hi) / greatest(1, input_tokens) * 100, 1) AS p"


@query(
    f"WITH b AS (SELECT {_PERCENT} FROM {opportunity_sql(_EVEN)}), c AS (SELECT {_PERCENT} FROM {opportunity_sql(_ODD)}) SELECT coalesce(b.deployment_name, c.deployment_name) AS deployment_name, coalesce(b.p, 0) AS baseline_percent, coalesce(c.p, 0) AS candidate_percent, round(coalesce(c.p, 0) - coalesce(b.p, 0), 1) AS change_points, round(coalesce(c.p, 0) - coalesce(b.p, 0), 1) > 5 AS regression FROM b FULL JOIN c ON b.deployment_name = c.deployment_name"
)
def regression_compare(spark, folder):
    """Two sets of requests compared: conversations with even numbers as the baseline, those with odd ones as the candidate."""
    rows = K.raw_requests(spark, folder)
    number = F.floor(F.col("ingest_seq") / 2)
    return M.compared(opportunities(rows.where(number % 2 == 0)), opportunities(rows.where(number % 2 == 1)), KEY, 5.0)


# Published prices


def price_pages(spark, folder) -> DataFrame:
    """The pages of the table, and pages of twenty parts each with a table of their prices."""
    n = F.col("p_partkey")
    money = lambda c: F.concat(F.lit("$"), (F.floor(c / 100)).cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"), F.lit(" / MTok"))
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    row = F.concat(F.lit("<tr><td> Part  "), n, F.lit("</td><td>"), money(cents), F.lit("</td><td>"), money(cents * 4), F.lit("</td></tr>"))
    parts = V.table(spark, folder, "part").groupBy(F.floor(n / 20).alias("page")).agg(F.array_sort(F.collect_list(F.struct(n, row.alias("row")))).alias("rows"))
    html = F.concat(F.lit("<html><table><tr><th>Model</th><th>Input</th><th>Output</th></tr>"), F.array_join(F.transform("rows", lambda r: r["row"]), ""), F.lit("</table><table><tr><th>Other</th></tr><tr><td>x</td></tr></table></html>"))
    return V.table(spark, folder, "pages").select(F.concat(F.lit("page "), F.col("page_id")).alias("page_id"), "html").unionByName(parts.select(F.concat(F.lit("parts "), F.col("page")).alias("page_id"), html.alias("html")))


def table_of_prices(spark, folder) -> DataFrame:
    rows = Y.html_tables(price_pages(spark, folder), ["Model", "Input", "Output"])
    return rows.select("key", F.col("cells")[0].alias("model"), Y.dollars(F.col("cells")[1]).alias("input"), Y.dollars(F.col("cells")[2]).alias("output"))


@query("SELECT 'parts ' || (p_partkey // 20) AS key, 'Part ' || p_partkey AS model, round(p_retailprice * 100) / 100 AS input, round(p_retailprice * 100) * 4 / 100 AS output FROM part")
def html_price_tables(spark, folder):
    """SRC28, SRC29: all pages read, and the price tables found among them."""
    return table_of_prices(spark, folder)


@query(
    "WITH p AS (SELECT p_partkey, (['Global ', 'Data Zone ', 'Regional ', 'Ministral 3B '])[p_partkey % 4 + 1] || p_partkey AS label, CASE WHEN p_partkey % 5 = 0 THEN 'flat' WHEN p_partkey % 7 = 0 THEN 'none' ELSE 'both' END AS kind, p_size FROM part) "
    "SELECT CASE WHEN p_partkey % 4 = 3 THEN 'ministral-3b' ELSE label END AS model, label AS alias, (['global', 'data_zone', 'regional', NULL])[p_partkey % 4 + 1] AS region, CAST(p_size AS DOUBLE) AS input_rate, p_size + 0.5e0 AS output_rate, '/ 1M Tokens' AS unit FROM p WHERE kind = 'both'"
)
def page_price_components(spark, folder):
    """CST10, HLP42: price cells in words; only those with input and output become entries."""
    n = F.col("p_partkey")
    label = F.concat(V.pick(["Global ", "Data Zone ", "Regional ", "Ministral 3B "], n % 4), n)
    cell = F.when(n % 5 == 0, F.concat(F.lit("$"), F.col("p_size"), F.lit(" / 1K Pages"))).when(n % 7 == 0, "on request").otherwise(F.concat(F.lit("Input:  $"), F.col("p_size"), F.lit("\nOutput: $"), F.col("p_size"), F.lit(".5 / 1M Tokens")))
    return N.page_prices(V.table(spark, folder, "part").select(label.alias("label"), N.page_components(cell).alias("components")))


@query(
    "WITH m AS (SELECT 'part ' || p_partkey AS alias, 'part-' || p_partkey AS model, p_size + 0.0e0 AS rate FROM part), e AS (SELECT *, unnest([{'asked': NULL, 'region': 'global', 'f': 1.0e0, 'assumed': 'deployment=global;purchase_model=payg;service_tier=standard'}, {'asked': 'Data Zone', 'region': 'data_zone', 'f': 1.1e0, 'assumed': 'purchase_model=payg;service_tier=standard'}]) AS x FROM m) "
    "SELECT model, x.region AS region, round(rate * x.f, 9) AS input_rate, round(rate * x.f * 100, 6) AS input_units, x.assumed AS assumed FROM e"
)
def published_mode_prices(spark, folder):
    """CST7, CST8, CST11, CST12, HLP38: a table's rates for the modes that are published."""
    part = V.table(spark, folder, "part")
    size = F.col("p_size").cast("double")
    table = part.select(F.concat(F.lit("part "), F.col("p_partkey")).alias("model"), size.alias("input"), (size / 10).alias("cached"), size.alias("write"), (size * 4).alias("output"))
    entries, _ = N.table_prices(table, [None, "Data Zone", "regional"])
    return entries.select("model", "region", F.round("input_rate", 9).alias("input_rate"), F.round("input_units", 6).alias("input_units"), F.array_join("assumed", ";").alias("assumed"))


@query(
    f"SELECT 'deployment-mode-not-published' AS reason, 'part ' || p_partkey AS subject, map {{{', '.join(f'{a!r}: {b!r}' for a, b in fixed.DEPLOYMENT_SPELLINGS.items())}}}[replace(lower(trim(asked)), '-', '_')] AS detail FROM part, (VALUES ('global'), ('Regional-Standard'), ('data zone')) t(asked) "
    f"WHERE map {{{', '.join(f'{a!r}: {b!r}' for a, b in fixed.DEPLOYMENT_SPELLINGS.items())}}}[replace(replace(lower(trim(asked)), '-', '_'), ' ', '_')] NOT IN ({', '.join(map(repr, fixed.MODE_MULTIPLIERS))})"
)
def unpublished_modes(spark, folder):
    """HLP38: what a mode without published rates costs: its own entries alone."""
    part = V.table(spark, folder, "part")
    table = part.select(F.concat(F.lit("part "), F.col("p_partkey")).alias("model"), *[F.col("p_size").cast("double").alias(n) for n in ("input", "cached", "write", "output")])
    return N.table_prices(table, ["global", "Regional-Standard", "data zone"])[1]


def snapshots(spark, folder) -> DataFrame:
    """Fifty parts each as one source's prices, every third in euros."""
    source = F.floor(F.col("p_partkey") / 50).cast("long")
    parts = V.table(spark, folder, "part").groupBy(source.alias("n")).agg(F.collect_list(F.struct(F.concat(F.lit("part "), F.col("p_partkey")).alias("model"), F.col("p_retailprice").alias("input_rate"))).alias("prices"))
    day = F.make_dt_interval(days=(F.col("n") % 20).cast("int"))
    return parts.select(F.concat(F.lit("source "), F.col("n")).alias("source"), (F.lit("2026-09-01").cast("timestamp") + day).alias("retrieved_at"), F.lit("-").alias("content_hash"), F.when(F.col("n") % 3 == 0, "eur").otherwise("usd").alias("currency"), "prices")


@query("SELECT 'source ' || (p_partkey // 50) AS source, 'part ' || p_partkey AS model, p_retailprice AS input_rate FROM part WHERE p_partkey // 50 % 3 <> 0")
def snapshot_union(spark, folder):
    """SET3: the prices of all snapshots in one currency."""
    return N.public_prices(snapshots(spark, folder), "USD")


@query(
    "SELECT 'source ' || (p_partkey // 50) AS source, CASE WHEN p_partkey // 50 % 3 = 0 THEN 'EUR' ELSE 'USD' END AS currency, CAST(count(*) AS INTEGER) AS entries, p_partkey // 50 % 3 <> 0 AS included, CASE WHEN p_partkey // 50 % 3 = 0 THEN 'currency EUR differs from USD' END AS excluded_reason, p_partkey // 50 % 20 < 8 AS stale FROM part GROUP BY p_partkey // 50"
)
def snapshot_provenance(spark, folder):
    """SET4, FLT16, HLP40: which snapshots take part, which are kept out and why, and which are older than a week."""
    from datetime import datetime

    out = N.provenance(snapshots(spark, folder), "usd")
    return out.select("source", "currency", "entries", "included", "excluded_reason", N.stale(F.col("retrieved_at"), datetime(2026, 9, 15, 12)).alias("stale"))


#: Spellings of price dimensions made from an event's columns, as expressions that both engines read.
SPELT = {
    "mode": "CASE WHEN event_type = 'view' THEN CASE WHEN user_id % 2 = 0 THEN ' Global Standard' ELSE 'glbl' END WHEN event_type = 'click' THEN CASE WHEN user_id % 3 = 0 THEN 'Data-Zone' ELSE 'DZ' END WHEN event_type = 'error' THEN 'Regional_Standard' WHEN user_id % 5 = 0 THEN 'Unknown' WHEN user_id % 5 = 1 THEN '' ELSE 'reg' END",
    "context": "CASE WHEN value > 50 THEN CASE WHEN user_id % 2 = 0 THEN 'Long Context' ELSE 'loco' END ELSE 'short' END",
    "tier": "CASE WHEN event_id % 2 = 0 THEN 'STD' ELSE 'standard ' END",
    "inference": "CASE WHEN event_id % 3 = 0 THEN 'Normal-Inference' ELSE 'normal' END",
}


def spelt_sql(column: str, known: dict) -> str:
    """A canonical spelling looked up by its text."""
    return f"map {{{', '.join(f'{a!r}: {b!r}' for a, b in known.items())}}}[regexp_replace(lower(trim({SPELT[column]})), '[ -]+', '_', 'g')] AS {column}"


@query(
    "SELECT event_id, "
    + ", ".join(spelt_sql(n, known) for n, known in [("mode", fixed.DEPLOYMENT_SPELLINGS), ("context", fixed.CONTEXT_SPELLINGS), ("tier", fixed.TIER_SPELLINGS), ("inference", fixed.INFERENCE_SPELLINGS)])
    + " FROM events"
)
def dimension_spellings(spark, folder):
    """CST11 to CST13: spellings of price dimensions; an unstated mode is null."""
    e = V.table(spark, folder, "events")
    of = {"mode": N.optional_deployment, "context": N.canonical_context, "tier": N.canonical_tier, "inference": N.canonical_inference}
    return e.select("event_id", *[canonical(F.expr(SPELT[n])).alias(n) for n, canonical in of.items()])


