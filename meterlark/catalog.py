"""Every query over the driver's tables, by operator, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog_sql as S
from . import fixed
from .operators import buckets as B
from .operators import capacity as C
from .operators import dedupe as D
from .operators import pricing as P
from .operators import rollups as R
from .operators import rules as Q
from .operators import samples as Z
from .operators import tasks as T
from .operators import workloads as W
from .functions.text import canonical_model, sampled
from .plans import analysis as A
from .sources import prices as Y
from .sources import records as X
from .sources import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "deployment_rollup"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def catalogs(spark: SparkSession) -> list[P.Catalog]:
    own = S.customer_entries()
    return [P.Catalog("house", "customer", P.price_rows(spark, own), rows=len(own)), P.reference_catalog(spark)]


def priced(spark: SparkSession, folder: str) -> DataFrame:
    return P.price_traces(V.request_traces(spark, folder), catalogs(spark))


def joined(df: DataFrame, *names: str) -> DataFrame:
    """List columns as text, for comparison by value."""
    return df.withColumns({n: F.array_join(n, ";") for n in names})


LISTS = ("unresolved_reasons", "suggested_override_keys")
RATES = ["input_price_per_million", "cached_input_price_per_million", "output_price_per_million"]

# Pricing


@query(f"WITH {S.PRICED_SQL} SELECT ingest_seq, kind AS catalog_kind, catalog, starts AS effective_from, input_rate, cached_rate, output_rate FROM chosen WHERE kind IS NOT NULL")
def price_asof(spark, folder):
    """J1, J4, J5, FLT3: the entry that prices each trace, if any."""
    out = V.request_traces(spark, folder)
    found = catalogs(spark)
    for i, c in enumerate(found):
        out = P.with_price(out, c, f"p{i}", F.col("ts"), F.col("input_tokens"))
    own = F.col("p0").isNotNull()
    pick = lambda name: F.when(own, F.col(f"p0.{name}")).otherwise(F.col(f"p1.{name}"))
    names = [c.name for c in found]
    return out.where(own | F.col("p1").isNotNull()).select("ingest_seq", F.when(own, "customer").otherwise("reference").alias("catalog_kind"), F.when(own, "house").otherwise(names[1]).alias("catalog"), pick("effective_from").cast("string").alias("effective_from"), pick("input_rate").alias("input_rate"), pick("cached_rate").alias("cached_rate"), pick("output_rate").alias("output_rate"))


@query(f"WITH {S.PRICED_SQL} SELECT ingest_seq, source, reason, override_key FROM costed WHERE reading = 'a'")
def price_resolution_reasons(spark, folder):
    """J2, CST4: how each trace is priced or why it isn't."""
    return priced(spark, folder).select("ingest_seq", "cost.source", "cost.reason", "cost.override_key")


@query(f"WITH {S.PRICED_SQL} SELECT ingest_seq, round(cost_usd, 9) AS cost_usd, round(fresh_cost, 9) AS fresh_cost, round(cached_cost, 9) AS cached_cost, round(output_cost, 9) AS output_cost FROM costed WHERE reading = 'a' AND source <> 'unresolved'")
def cost_components(spark, folder):
    """CST1, CST2: total and parts of each priced trace."""
    out = priced(spark, folder).where("cost.resolved")
    return out.select("ingest_seq", *[F.round(f"cost.{n}", 9).alias(n) for n in ("cost_usd", "fresh_cost", "cached_cost", "output_cost")])


@query(
    f"WITH {S.PRICED_SQL}{S.slice_sql('deployment_name, model_name, deployment_mode, canonical')} SELECT * EXCLUDE canonical, canonical AS canonical_model, "
    "round(requests / greatest(CAST(sum(requests) OVER () AS BIGINT), 1) * 100, 1) AS request_share_percent, round(total_tokens / greatest(CAST(sum(total_tokens) OVER () AS BIGINT), 1) * 100, 1) AS token_share_percent FROM summary"
)
def deployment_rollup(spark, folder):
    """AGG1, AGG2, AGG7, AGG10, AGG11, DQ2, FLT6: the flagship."""
    return joined(R.deployment_rollup(priced(spark, folder)), *LISTS).drop(*RATES)


@query(f"WITH {S.PRICED_SQL}{S.slice_sql('')} SELECT * FROM summary")
def portfolio_summary(spark, folder):
    """AGG1 over everything."""
    return joined(R.slice_summary(priced(spark, folder), []), *LISTS).drop(*RATES)


@query(f"WITH {S.PRICED_SQL}{S.slice_sql('tenant, model_name')} SELECT * FROM summary")
def tenant_model_slices(spark, folder):
    """AGG1 at another grain, with slices small enough for the 1,024-token rule."""
    return joined(R.slice_summary(priced(spark, folder), ["tenant", "model_name"]), *LISTS).drop(*RATES)


@query(f"WITH {S.PRICED_SQL}{S.slice_sql('ingest_seq, model_name', 9)} SELECT ingest_seq, estimated_cost_usd, pricing_status, unresolved_reasons FROM summary")
def single_request_slices(spark, folder):
    """Q1: each request as a slice of its own; below 1,024 tokens unmeasured cached input is zero."""
    return joined(R.slice_summary(priced(spark, folder), ["ingest_seq", "model_name"], 9), *LISTS).select("ingest_seq", "estimated_cost_usd", "pricing_status", "unresolved_reasons")


@query(
    f"WITH {S.PRICED_SQL} SELECT CAST(grouping(deployment_name) AS INTEGER) AS is_total, deployment_name, model_name, count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, "
    "round(sum(CASE WHEN source <> 'unresolved' THEN cost_usd END), 6) AS estimated_cost_usd FROM costed WHERE reading = 'a' GROUP BY GROUPING SETS ((), (deployment_name, model_name))"
)
def portfolio_grouping_sets(spark, folder):
    """Portfolio and deployments in one pass."""
    return R.grouping_summary(priced(spark, folder), ["deployment_name", "model_name"])


@query(
    f"WITH {S.PRICED_SQL}{S.slice_sql('deployment_name, model_name, deployment_mode, canonical')} SELECT canonical AS canonical_model, deployment_mode, count(*) AS deployments, CAST(sum(requests) AS BIGINT) AS requests, "
    "CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, "
    "CASE WHEN min(total_tokens_state) = max(total_tokens_state) THEN min(total_tokens_state) ELSE 'partial' END AS total_tokens_state, round(sum(estimated_cost_usd), 6) AS estimated_cost_usd, "
    "round(sum(requests * pricing_coverage_requests_percent / 100) / sum(requests) * 100, 1) AS pricing_coverage_requests_percent, "
    "CASE WHEN min(pricing_source) = max(pricing_source) THEN min(pricing_source) ELSE 'mixed' END AS pricing_source, CASE WHEN min(pricing_status) = max(pricing_status) THEN min(pricing_status) ELSE 'mixed' END AS pricing_status FROM summary GROUP BY ALL"
)
def model_rollup(spark, folder):
    """AGG12, AGG13, AGG14, SRT8: models over deployments."""
    return R.model_rollup(R.deployment_rollup(priced(spark, folder)))


@query(
    f"WITH {S.PRICED_SQL} SELECT deployment_name, strftime(ts, '%Y-%m-%d') AS day, count(*) AS requests, count(*) FILTER (source <> 'unresolved') AS priced_requests, round(sum(cost_usd) FILTER (source <> 'unresolved'), 10) AS cost_usd, "
    "round(sum(fresh_cost), 10) AS fresh_cost_usd, round(sum(cached_cost), 10) AS cached_cost_usd, round(sum(output_cost), 10) AS output_cost_usd, round(count(*) FILTER (source <> 'unresolved') / count(*) * 100, 1) AS coverage_percent "
    "FROM costed WHERE reading = 'a' GROUP BY 1, 2"
)
def daily_cost(spark, folder):
    """AGG28: cost by deployment and day."""
    return R.daily_cost(priced(spark, folder), ["deployment_name"])


@query(f"WITH {S.PRICED_SQL} SELECT override_key, reason, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens FROM costed WHERE reading = 'a' AND source = 'unresolved' GROUP BY 1, 2")
def unresolved_models(spark, folder):
    """What isn't priced, by reason and override key."""
    return R.unresolved_models(priced(spark, folder))


# Buckets


@query(f"WITH {S.METRIC_BUCKETS_SQL}{S.bucket_sql('deployment_name')} SELECT * FROM bucket_summary")
def bucket_summary(spark, folder):
    """AGG3, AGG4, AGG5, AGG41: buckets by deployment."""
    return B.bucket_summary(V.metric_buckets(spark, folder), ["deployment_name"])


@query(f"WITH {S.METRIC_BUCKETS_SQL}{S.bucket_sql('')} SELECT * FROM bucket_summary")
def bucket_portfolio(spark, folder):
    """AGG3 over everything."""
    return B.bucket_summary(V.metric_buckets(spark, folder))


@query(
    f"WITH {S.METRIC_BUCKETS_SQL}{S.bucket_sql('deployment_name')} SELECT deployment_name, input_tokens IS NOT NULL AS input_tokens, cached_tokens IS NOT NULL AS cached_tokens, output_tokens IS NOT NULL AS output_tokens, requests_observed IS NOT NULL AS requests, "
    "outcome_coverage <> 'unavailable' AS request_outcomes, latency_coverage_percent > 0 AS latency, false AS retries FROM bucket_summary"
)
def bucket_field_coverage(spark, folder):
    """AGG6."""
    return B.field_coverage(B.bucket_summary(V.metric_buckets(spark, folder), ["deployment_name"]), ["deployment_name"])


@query(
    f"WITH {S.METRIC_BUCKETS_SQL}, slots AS (SELECT DISTINCT deployment_name, bucket // 300 AS slot FROM buckets), stepped AS (SELECT *, lag(slot) OVER (PARTITION BY deployment_name ORDER BY slot) AS prev FROM slots), "
    "gaps AS (SELECT deployment_name, (prev + 1) * 300 AS gap_start, slot - prev - 1 AS missing_buckets FROM stepped WHERE slot > prev + 1) "
    "SELECT *, CAST(row_number() OVER (PARTITION BY deployment_name ORDER BY gap_start) AS INTEGER) AS gap_number, count(*) OVER (PARTITION BY deployment_name) AS gaps FROM gaps QUALIFY gap_number <= 200"
)
def bucket_gaps(spark, folder):
    """WIN7: missing runs of buckets."""
    return B.bucket_gaps(V.metric_buckets(spark, folder), ["deployment_name"])


@query(
    f"WITH {S.METRIC_BUCKETS_SQL}, per_day AS (SELECT deployment_name, bucket // 86400 AS day, count(DISTINCT bucket) AS n FROM buckets GROUP BY 1, 2), "
    "calendar AS (SELECT deployment_name, unnest(range(min(day), max(day) + 1)) AS day FROM per_day GROUP BY 1) "
    "SELECT deployment_name, count(*) AS days, count(*) FILTER (n >= 288) AS days_complete, count(*) FILTER (n > 0 AND n < 288) AS days_partial, count(*) FILTER (n IS NULL) AS days_missing FROM calendar LEFT JOIN per_day USING (deployment_name, day) GROUP BY 1"
)
def bucket_day_coverage(spark, folder):
    """AGG34, AGG33."""
    return B.day_coverage(V.metric_buckets(spark, folder), ["deployment_name"])


INSIGHTS_SQL = (
    f"WITH {S.METRIC_BUCKETS_SQL}{S.bucket_sql('deployment_name')}, b AS (SELECT *, greatest(0, failed_requests - coalesce(rate_limited_requests, 0)) AS other FROM bucket_summary) "
    "SELECT deployment_name, 'AGG-COVERAGE' AS insight_id, 'data_quality' AS category, 0 AS priority, 'material' AS materiality, round(observed_buckets / elapsed_buckets * 100, 1) AS value FROM b WHERE observed_buckets < elapsed_buckets "
    "UNION ALL SELECT deployment_name, 'AGG-RATE-LIMIT', 'reliability', 1, CASE WHEN rate_limited_requests / requests_observed >= .1 THEN 'material' ELSE 'advisory' END, round(rate_limited_requests / requests_observed * 100, 1) FROM b WHERE rate_limited_requests / requests_observed * 100 >= 5 "
    "UNION ALL SELECT deployment_name, 'AGG-FAILURE-RATE', 'reliability', 1, CASE WHEN other / requests_observed >= .1 THEN 'material' ELSE 'advisory' END, round(other / requests_observed * 100, 1) FROM b WHERE other > 0 "
    "UNION ALL SELECT deployment_name, 'AGG-TOKENS-PER-REQUEST', 'token_efficiency', 2, 'observation', round(total_tokens / requests_observed, 2) FROM b WHERE total_tokens IS NOT NULL "
    "UNION ALL SELECT deployment_name, 'AGG-NATIVE-USAGE-GAP', 'data_quality', 1, 'observation', NULL FROM b WHERE total_tokens IS NULL "
    "UNION ALL SELECT deployment_name, 'AGG-CACHED-TOKEN-GAP', 'pricing_readiness', 2, 'observation', NULL FROM b WHERE cached_tokens_state = 'unavailable' AND total_tokens IS NOT NULL "
    "UNION ALL SELECT deployment_name, 'AGG-OUTCOME-GAP', 'data_quality', 1, 'observation', NULL FROM b WHERE outcome_coverage = 'unavailable' "
    "UNION ALL SELECT deployment_name, 'DQ-LATENCY-GAP', 'data_quality', 1, 'observation', NULL FROM b WHERE latency_coverage_percent = 0"
)


@query(INSIGHTS_SQL)
def aggregate_insights(spark, folder):
    """INS1, SRT6."""
    return B.insights(B.bucket_summary(V.metric_buckets(spark, folder), ["deployment_name"]), ["deployment_name"])


# Diagnostics


def raw_requests(spark, folder) -> DataFrame:
    return V.conversation_traces(spark, folder)


KEY = ["deployment_name"]


@query(
    f"WITH {V.CONVERSATIONS_SQL}, prompts AS (SELECT deployment_name, ingest_seq, trim(array_to_string(list_transform(list_filter(turns, lambda t: t.role = 'system'), lambda t: t.text), chr(10))) AS prompt FROM requests), "
    "grouped AS (SELECT deployment_name, prompt, count(*) AS n, min(ingest_seq) AS first FROM prompts WHERE prompt <> '' GROUP BY 1, 2), "
    "top AS (SELECT * FROM grouped QUALIFY row_number() OVER (PARTITION BY deployment_name ORDER BY n DESC, first) = 1) "
    "SELECT deployment_name, 'TL001' AS rule_id, n AS affected, strlen(prompt) * (n - 1) AS measured, CAST(floor(strlen(prompt) * (n - 1) * 0.72) AS BIGINT) AS min_savings, strlen(prompt) * (n - 1) AS max_savings FROM top WHERE n >= 2 AND strlen(prompt) * (n - 1) >= 100"
)
def tl001_repeated_prefix(spark, folder):
    """TL001, SRT11."""
    return Q.repeated_prefix(raw_requests(spark, folder), KEY)


def fingerprint_sql(key: str) -> str:
    return (
        f"WITH {V.CONVERSATIONS_SQL}, open AS (SELECT * FROM requests WHERE {key} NOT IN (SELECT {key} FROM requests WHERE len(list_filter(turns, lambda t: t.role = 'system' AND trim(t.text) <> '')) > 0)), "
        f"grouped AS (SELECT {key}, fingerprint, count(*) AS n, arg_max(prefix_tokens, ingest_seq) AS tokens, min(ingest_seq) AS first FROM open WHERE fingerprint IS NOT NULL GROUP BY 1, 2), "
        f"top AS (SELECT *, tokens * (n - 1) AS repeated FROM grouped QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY n DESC, first) = 1) "
        f"SELECT {key}, 'TL001' AS rule_id, n AS affected, repeated AS measured, CAST(floor(repeated * 0.72) AS BIGINT) AS min_savings, repeated AS max_savings FROM top WHERE n >= 2 AND repeated >= 100"
    )


@query(fingerprint_sql("team"))
def tl001b_fingerprint_prefix(spark, folder):
    """TL001b: teams without any system prompt, by their fingerprints."""
    return Q.fingerprint_prefix(raw_requests(spark, folder), ["team"])


@query(
    f"WITH {V.CONVERSATIONS_SQL}, long AS (SELECT deployment_name, count(*) AS n, CAST(sum(context) AS BIGINT) AS total FROM requests WHERE len(turns) >= 5 GROUP BY 1) "
    "SELECT deployment_name, 'TL002' AS rule_id, n AS affected, total AS measured, CAST(round_even(round_even(total * 0.15e0, 0) * 0.6e0, 0) AS BIGINT) AS min_savings, CAST(round_even(total * 0.15e0, 0) AS BIGINT) AS max_savings FROM long WHERE n >= 2"
)
def tl002_history_growth(spark, folder):
    """TL002, TOK4."""
    return Q.history_growth(raw_requests(spark, folder), KEY)


@query(
    f"WITH {V.CONVERSATIONS_SQL}, defined AS (SELECT DISTINCT deployment_name, unnest(tools) AS name FROM requests), used AS (SELECT DISTINCT deployment_name, unnest(called) AS name FROM requests), "
    "counts AS (SELECT d.deployment_name, count(*) AS tools, count(*) FILTER (u.name IS NULL) AS unused FROM defined d LEFT JOIN used u ON d.deployment_name = u.deployment_name AND d.name = u.name GROUP BY 1), "
    "tokens AS (SELECT deployment_name, CAST(sum(CASE WHEN len(tools) > 0 THEN tools_bytes ELSE 0 END) AS BIGINT) AS tokens FROM requests GROUP BY 1) "
    "SELECT deployment_name, 'TL003' AS rule_id, unused AS affected, tokens AS measured, CAST(round_even(round_even(tokens * unused / tools, 0) * 0.6e0, 0) AS BIGINT) AS min_savings, CAST(round_even(tokens * unused / tools, 0) AS BIGINT) AS max_savings FROM counts JOIN tokens USING (deployment_name) WHERE unused > 0 AND tokens >= 100"
)
def tl003_unused_tools(spark, folder):
    """TL003, TL003u."""
    return Q.unused_tools(raw_requests(spark, folder), KEY)


@query(
    f"WITH {V.CHUNKS_SQL} SELECT deployment_name, 'TL004' AS rule_id, n AS affected, coalesce(total, 0) AS measured, CAST(round_even(coalesce(total, 0) * 0.5e0, 0) AS BIGINT) AS min_savings, coalesce(total, 0) AS max_savings FROM counts LEFT JOIN redundant USING (deployment_name) WHERE n >= 2 AND total >= 100"
)
def tl004_chunk_redundancy(spark, folder):
    """TL004, TL004w, J19, SET6."""
    return Q.redundant_chunk_rows(V.document_chunks(spark, folder), KEY)


@query(
    f"WITH {V.CONVERSATIONS_SQL}, texts AS (SELECT deployment_name, retry_count > 0 AS explicit, coalesce(input_tokens, context) AS cost, trim(array_to_string(list_transform(turns, lambda t: t.text), chr(10))) AS text FROM requests), "
    "counted AS (SELECT *, count(*) OVER (PARTITION BY deployment_name, text) AS n, bool_or(explicit) OVER (PARTITION BY deployment_name) AS any_explicit FROM texts), "
    "chosen AS (SELECT deployment_name, count(*) AS n, CAST(sum(cost) AS BIGINT) AS total FROM counted WHERE CASE WHEN any_explicit THEN explicit ELSE text <> '' AND n > 1 END GROUP BY 1) "
    "SELECT deployment_name, 'TL005' AS rule_id, n AS affected, total AS measured, CAST(round_even(total * 0.6e0, 0) AS BIGINT) AS min_savings, total AS max_savings FROM chosen"
)
def tl005_retry_amplification(spark, folder):
    """TL005."""
    return Q.retry_amplification(raw_requests(spark, folder), KEY)


@query(
    f"WITH {V.CONVERSATIONS_SQL}, p AS (SELECT deployment_name, count(*) AS n, quantile_disc(max_output_tokens, 0.99) AS top, quantile_disc(output_tokens, 0.99) AS used FROM requests WHERE max_output_tokens IS NOT NULL AND output_tokens IS NOT NULL GROUP BY 1) "
    "SELECT deployment_name, 'TL006' AS rule_id, n AS affected, top - used AS measured, CAST(round_even((top - used) * n * 0.1e0, 0) AS BIGINT) AS min_savings, (top - used) * n AS max_savings FROM p WHERE n >= 2 AND top > used * 2"
)
def tl006_output_budget(spark, folder):
    """TL006, PCT4."""
    return Q.output_budget(raw_requests(spark, folder), KEY)


@query(
    f"WITH {V.CONVERSATIONS_SQL}, asked AS (SELECT deployment_name, tenant, coalesce(workload, 'default') AS w, lower(trim(regexp_replace(list_filter(turns, lambda t: t.role = 'user')[-1].text, '\\s+', ' ', 'g'))) AS prompt FROM requests), "
    "grouped AS (SELECT deployment_name, tenant, w, prompt, count(*) AS n FROM asked WHERE prompt <> '' GROUP BY ALL HAVING count(*) > 1) "
    "SELECT deployment_name, 'TL007' AS rule_id, count(*) AS affected, CAST(sum(n - 1) AS BIGINT) AS measured, CAST(sum(n - 1) AS BIGINT) AS min_savings, CAST(sum(n - 1) AS BIGINT) AS max_savings FROM grouped GROUP BY 1"
)
def tl007_repeated_intents(spark, folder):
    """TL007."""
    return Q.repeated_intents(raw_requests(spark, folder), KEY)


@query(
    f"WITH {V.CONVERSATIONS_SQL}, judged AS (SELECT deployment_name, output_tokens, model, lower(array_to_string(list_transform(list_filter(turns, lambda t: t.role = 'user'), lambda t: t.text), ' ')) AS text, lower(coalesce(task_type, '')) AS shape FROM requests WHERE model_name <> 'unknown'), "
    "counts AS (SELECT deployment_name, count(*) AS n, count(*) FILTER (regexp_matches(text, 'classify|extract|format as json|yes or no|categorize') OR regexp_matches(shape, 'classify|extract|format as json|yes or no|categorize') OR (length(text) < 120 AND coalesce(output_tokens < 160, false))) AS bounded, "
    "count(*) FILTER (NOT regexp_matches(lower(model), 'mini|nano')) AS large FROM judged WHERE trim(text) <> '' OR shape <> '' GROUP BY 1) "
    "SELECT deployment_name, 'TL008' AS rule_id, bounded AS affected, n AS measured, CAST(NULL AS BIGINT) AS min_savings, CAST(NULL AS BIGINT) AS max_savings FROM counts WHERE bounded / n >= 0.2 AND large / n >= 0.2"
)
def tl008_model_sizing(spark, folder):
    """TL008, FLT4."""
    return Q.model_sizing(raw_requests(spark, folder), KEY)


EVIDENCE_SQL = (
    f"WITH {V.CONVERSATIONS_SQL}, flags AS (SELECT deployment_name, count(*) AS n, bool_or(len(tools) > 0) AS tools, bool_or(max_output_tokens > 0) AS max_output_tokens, bool_or(output_tokens IS NOT NULL) AS output_tokens, bool_or(retry_count > 0) AS retry_count, "
    "bool_or(prefix_tokens IS NOT NULL) AS system_prompt_tokens, bool_or(fingerprint IS NOT NULL) AS system_prompt_fingerprint, bool_or(model_name <> 'unknown') AS model_identity FROM requests GROUP BY 1), "
    "held AS (SELECT deployment_name, list_sort(list_filter(['messages', 'task_shape_evidence', 'request_fingerprint', CASE WHEN tools THEN 'tools' END, CASE WHEN max_output_tokens THEN 'max_output_tokens' END, CASE WHEN output_tokens THEN 'output_tokens' END, "
    "CASE WHEN retry_count THEN 'retry_count' END, CASE WHEN system_prompt_tokens THEN 'system_prompt_tokens' END, CASE WHEN system_prompt_fingerprint THEN 'system_prompt_fingerprint' END, CASE WHEN model_identity THEN 'model_identity' END], lambda x: x IS NOT NULL)) AS available FROM flags)"
)


@query(EVIDENCE_SQL + " SELECT deployment_name, array_to_string(available, ',') AS available, false AS only_buckets FROM held")
def rule_evidence(spark, folder):
    """FLT7."""
    return Q.evidence(raw_requests(spark, folder), KEY).withColumn("available", F.array_join("available", ","))


def applicability_sql(chunks: bool = False) -> str:
    """Which rules can run, by evidence; with ``chunks``, documents' lines are evidence of their deployments too."""
    both = f", {V.CHUNKS_SQL}, every AS (SELECT deployment_name, list_sort(list_distinct(flatten(list(available)))) AS available FROM (SELECT * FROM held UNION ALL SELECT DISTINCT deployment_name, ['retrieved_chunks'] FROM worded) GROUP BY 1)"
    return (
        EVIDENCE_SQL
        + (both if chunks else ", every AS (SELECT * FROM held)")
        + ", rules(rule_id, title, sets) AS (VALUES "
        + ", ".join(f"('{r}', '{t}', {[[*s] for s in sets]!r})" for r, t, _, sets in fixed.RULES)
        + "), unmet AS (SELECT deployment_name, rule_id, title, list_transform(sets, lambda s: list_filter(s, lambda x: NOT list_contains(available, x))) AS unmet FROM every, rules), "
        "closest AS (SELECT *, list_filter(unmet, lambda u: len(u) = list_min(list_transform(unmet, lambda v: len(v))))[1] AS missing FROM unmet) "
        "SELECT deployment_name, rule_id, title, array_to_string(missing, ',') AS missing, len(missing) = 0 AS runs FROM closest"
    )


@query(applicability_sql())
def rule_applicability(spark, folder):
    """FLT8, FLT9, SET7."""
    return Q.applicability(Q.evidence(raw_requests(spark, folder), KEY), KEY).withColumn("missing", F.array_join("missing", ","))


RULE_NAMES = ["tl001_repeated_prefix", "tl002_history_growth", "tl003_unused_tools", "tl005_retry_amplification", "tl006_output_budget", "tl007_repeated_intents", "tl008_model_sizing"]


def run_sql(chunks: bool = False) -> str:
    """Status of all rules by deployment; with ``chunks``, documents' lines are what the deployments retrieved, else TL004 has nothing to find."""
    found = " UNION ALL ".join(f"SELECT * FROM ({x})" for x in [*(ORACLE_SQL[n] for n in [*RULE_NAMES, *["tl004_chunk_redundancy"] * chunks]), fingerprint_sql("deployment_name")])
    return (
        f"WITH found AS ({found}), can AS ({applicability_sql(chunks)}) SELECT deployment_name, rule_id, CASE WHEN NOT runs THEN 'not_evaluated' WHEN affected IS NOT NULL THEN 'finding' ELSE 'no_issue' END AS status, missing, "
        "CASE WHEN runs THEN affected END AS affected, CASE WHEN runs THEN measured END AS measured, CASE WHEN runs THEN min_savings END AS min_savings, CASE WHEN runs THEN max_savings END AS max_savings FROM can LEFT JOIN found USING (deployment_name, rule_id)"
    )


def impact_sql(min_percent: float = 1.0, min_tokens: int = 100_000) -> str:
    """Findings of the whole portfolio with their impact."""
    severity = "CASE rule_id " + " ".join(f"WHEN '{r}' THEN '{x}'" for r, x in fixed.SEVERITY.items()) + " END"
    whole = run_sql().replace(V.CONVERSATIONS_SQL, V.WHOLE_SQL)
    return (
        f"impact AS (SELECT r.* EXCLUDE deployment_name, t.*, least(100, round(min_savings / greatest(1, base) * 100, 1)) AS impact_min_percent, least(100, round(max_savings / greatest(1, base) * 100, 1)) AS impact_max_percent, {severity} AS severity "
        f"FROM (SELECT * FROM ({whole}) WHERE status = 'finding') r, (WITH {V.WHOLE_SQL} SELECT CAST(sum(input_tokens) AS BIGINT) AS input_tokens, count(*) AS requests FROM requests) t, LATERAL (SELECT CASE WHEN r.rule_id = 'TL007' THEN t.requests ELSE coalesce(t.input_tokens, 0) END AS base) b), "
        f"judged AS (SELECT *, coalesce(impact_max_percent, 0) >= {min_percent} OR (rule_id = 'TL007' AND max_savings > 0) OR (rule_id <> 'TL007' AND coalesce(max_savings, 0) >= {min_tokens}) AS material FROM impact)"
    )


FINDING_ORDER = "coalesce(impact_max_percent, 0) DESC, coalesce(max_savings, 0) DESC, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, rule_id"


@query(run_sql(chunks=True))
def rule_run(spark, folder):
    """TLRUN, TLALL: all rules over deployments; documents' lines are what they retrieved."""
    return Q.evaluate(raw_requests(spark, folder), KEY, V.document_chunks(spark, folder))


def impacts(spark, folder, **config) -> DataFrame:
    rows = raw_requests(spark, folder)
    totals = rows.agg(F.sum("input_tokens").alias("input_tokens"), F.count(F.lit(1)).alias("requests"))
    return Q.with_impact(Q.evaluate(rows), totals, **config)


@query(f"WITH {impact_sql()} SELECT *, CAST(row_number() OVER (ORDER BY {FINDING_ORDER}) AS INTEGER) AS place FROM judged WHERE material QUALIFY place <= 3")
def material_findings_topk(spark, folder):
    """TLIMP, FLT10, SRT1 to SRT3 over the whole portfolio."""
    return Q.top_findings(impacts(spark, folder))


# Workloads


def attributed(spark, folder) -> DataFrame:
    return W.attribute(priced(spark, folder), V.mappings(spark))


@query("WITH " + S.ATTRIBUTED_SQL + S.workloads_sql("technical_id, technical_name", "'deployment:' || deployment_name AS technical_id, deployment_name AS technical_name") + " SELECT * FROM workload_rollup")
def technical_workloads(spark, folder):
    """AGG15, AGG16, PRJ27, PCT2."""
    return W.technical_workloads(attributed(spark, folder))


@query("WITH " + S.ATTRIBUTED_SQL + S.workloads_sql("business_id, assigned", "coalesce(workload_id, 'unassigned') AS business_id, workload_id IS NOT NULL AS assigned") + " SELECT * FROM workload_rollup")
def business_workloads(spark, folder):
    """AGG17, J13, J15, SRT7: with the unassigned rest."""
    return W.business_workloads(attributed(spark, folder))


@query("WITH " + S.ATTRIBUTED_SQL + " SELECT count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost_usd) FILTER (source <> 'unresolved'), 6) AS cost FROM attributed WHERE workload_id IS NULL")
def unassigned_workload(spark, folder):
    """What no label or dedicated mapping claims."""
    rows = attributed(spark, folder).where("workload_id is null")
    return rows.agg(F.count(F.lit(1)).alias("requests"), F.sum(R.known_tokens()).alias("tokens"), F.round(F.sum(F.when(F.col("cost.resolved"), F.col("cost.cost_usd"))), 6).alias("cost"))


_MAPPINGS = "m AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{a}', {d!r})" for i, _, a, d in V.MAPPINGS) + ") t(id, allocation, deployments)), each AS (SELECT id, allocation, unnest(deployments) AS d FROM m)"


@query(
    "WITH m AS (SELECT 'wl ' || (s_suppkey % 70) AS id, CASE WHEN n_regionkey % 2 = 0 THEN 'dedicated' ELSE 'shared' END AS allocation, ['Dep ' || s_nationkey, 'dep-' || (s_suppkey % 60)] AS deployments FROM supplier JOIN nation ON s_nationkey = n_nationkey), "
    "slug AS (SELECT replace(id, ' ', '-') AS id, allocation, list_transform(deployments, lambda d: replace(lower(d), ' ', '-')) AS deployments FROM m), each AS (SELECT id, allocation, unnest(deployments) AS d FROM slug), "
    "n AS (SELECT d, count(DISTINCT id) FILTER (allocation = 'dedicated') AS own, count(*) FILTER (allocation = 'shared') AS shared FROM each GROUP BY 1) "
    "SELECT d AS subject, 'dedicated-to-several' AS problem FROM n WHERE own > 1 UNION ALL SELECT d, 'dedicated-and-shared' FROM n WHERE own > 0 AND shared > 0 UNION ALL SELECT id, 'duplicate-id' FROM slug GROUP BY 1 HAVING count(*) > 1"
)
def workload_mapping_problems(spark, folder):
    """VAL4: contradictions of mappings: suppliers as workloads, dedicated or shared by their nation's region."""
    supplier = V.table(spark, folder, "supplier").join(V.table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    dedicated = F.when(F.col("n_regionkey") % 2 == 0, "dedicated").otherwise("shared")
    deployments = F.array(F.concat(F.lit("Dep "), F.col("s_nationkey")), F.concat(F.lit("dep-"), F.col("s_suppkey") % 60))
    return W.mapping_problems(supplier.select(F.concat(F.lit("wl "), F.col("s_suppkey") % 70).alias("id"), dedicated.alias("allocation"), deployments.alias("deployments")))


@query(f"WITH {S.REQUEST_TRACES_SQL}, {_MAPPINGS} SELECT DISTINCT d AS deployment FROM each WHERE allocation = 'shared' AND d NOT IN (SELECT deployment_name FROM traces WHERE trim(workload) <> '')")
def shared_without_tags(spark, folder):
    """SET8."""
    return W.shared_without_tags(V.request_traces(spark, folder), V.mappings(spark))


@query(
    f"WITH {S.REQUEST_TRACES_SQL}, cur AS (SELECT DISTINCT 'deployment:' || deployment_name AS workload_id, deployment_name AS name FROM traces WHERE deployment_name <> 'dep-3'), "
    "old AS (SELECT DISTINCT 'deployment:' || deployment_name AS workload_id, 'old ' || deployment_name AS name FROM traces WHERE deployment_name <> 'dep-0') "
    "SELECT coalesce(c.workload_id, o.workload_id) AS workload_id, coalesce(o.name, c.name) AS name, c.workload_id IS NULL AS stale FROM cur c FULL JOIN old o ON c.workload_id = o.workload_id"
)
def identity_merge_full_outer(spark, folder):
    """J14."""
    names = V.request_traces(spark, folder).select("deployment_name").distinct()
    as_identity = lambda df, name: df.select(F.concat(F.lit("deployment:"), F.col("deployment_name")).alias("workload_id"), name.alias("name"))
    current = as_identity(names.where("deployment_name <> 'dep-3'"), F.col("deployment_name"))
    previous = as_identity(names.where("deployment_name <> 'dep-0'"), F.concat(F.lit("old "), F.col("deployment_name")))
    return W.merge_identities(previous, current, ["name"])


# Records and events


@query(
    "WITH doubled AS (SELECT event_id % 4000 AS k, event_id, value FROM events) SELECT CASE WHEN k % 10 = 0 THEN NULL ELSE k END AS event_key, event_id AS ingest_seq, value FROM doubled QUALIFY k % 10 = 0 OR row_number() OVER (PARTITION BY k ORDER BY event_id) = 1"
)
def event_dedupe(spark, folder):
    """WIN1, WIN2: the first row of each key; rows without one stay."""
    e = V.table(spark, folder, "events").withColumn("k", F.col("event_id") % 4000)
    rows = e.select(F.when(F.col("k") % 10 != 0, F.col("k")).alias("event_key"), F.col("event_id").alias("ingest_seq"), "value")
    return D.dedupe_records(rows, "event_key")


@query(
    f"WITH {S.REQUEST_TRACES_SQL}, keyed AS (SELECT ingest_seq, CASE WHEN ingest_seq % 2 = 0 THEN CAST(ingest_seq % 3000 AS VARCHAR) WHEN ingest_seq % 3 = 0 THEN 'e' || (ingest_seq % 500) ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '|' || deployment_name || '|' || model_name END AS stream_key FROM traces) "
    "SELECT stream_key, min(ingest_seq) AS ingest_seq FROM keyed GROUP BY 1"
)
def stream_key_dedupe(spark, folder):
    """SRC4, Q9."""
    n = F.col("ingest_seq")
    rows = V.request_traces(spark, folder).withColumns({"request_id": F.when(n % 2 == 0, (n % 3000).cast("string")), "event_id": F.when((n % 2 != 0) & (n % 3 == 0), F.concat(F.lit("e"), n % 500))})
    return D.stream_dedupe(rows).select("stream_key", "ingest_seq")


VIOLATIONS_SQL = (
    "WITH steps AS (SELECT CAST(l_orderkey AS VARCHAR) AS task, 'a' || (l_suppkey % 3) AS attempt, l_linenumber AS step, concat_ws('/', l_orderkey, CASE WHEN (l_suppkey + l_linenumber) % 4 <> 0 THEN 'model_call' ELSE 'tool_step' END, 'a' || (l_suppkey % 3), l_linenumber) AS id, "
    "CASE WHEN (l_suppkey + l_linenumber) % 4 <> 0 THEN CAST(round(l_quantity * 100) AS BIGINT) END AS input, l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey), "
    "same AS (SELECT id, any_value(task) AS task, any_value(attempt) AS attempt, any_value(step) AS step, count(DISTINCT (input, q)) AS forms FROM steps GROUP BY id), "
    "again AS (SELECT DISTINCT task FROM same GROUP BY task, attempt, step HAVING count(*) > 1) "
    "SELECT 'conflicting-duplicate' AS rule, id AS subject FROM same WHERE forms > 1 UNION ALL SELECT 'duplicate-step', task FROM again UNION ALL SELECT 'review-of-unknown-task', 'ghost' WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderstatus <> 'O' AND o_orderkey % 4 = 0) "
    "UNION ALL SELECT 'conflicting-outcome', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 700 = 3"
)


@query(VIOLATIONS_SQL)
def event_stream_violations(spark, folder):
    """WIN3 to WIN6, J22 over the task view, in which some things were made wrong."""
    events = V.task_events(spark, folder).withColumn("payload", F.concat_ws("|", "outcome", "input_tokens", "duration_ms"))
    wrong = events.where("event_type = 'task_result' and cast(task_id as long) % 700 = 3 and outcome = 'solved'").withColumns({"outcome": F.lit("failed"), "event_id": F.concat("event_id", F.lit("/again")), "ts": F.col("ts") + F.make_dt_interval(days=F.lit(1))})
    ghost = events.where("event_type = 'human_review'").limit(1).withColumns({"task_id": F.lit("ghost"), "event_id": F.lit("ghost")})
    return D.stream_violations(events.unionByName(wrong).unionByName(ghost))


# Tasks


def trajectories(spark, folder) -> DataFrame:
    return T.trajectories(T.price_events(V.task_events(spark, folder), catalogs(spark)))


@query(f"WITH {S.TASKS_SQL} SELECT task_id, outcome, attempts, solved_attempts, retries, resolved, round(cost_usd, 9) AS cost_usd, steps, resolved_steps, tokens, model_calls, duration_ms, CAST(reviews AS BIGINT) AS reviews, escaped FROM tasks")
def task_trajectories(spark, folder):
    """AGG19, J3, J4, WIN12 to WIN14."""
    return trajectories(spark, folder).select("task_id", "outcome", "attempts", "solved_attempts", "retries", "resolved", F.round("cost_usd", 9).alias("cost_usd"), "steps", "resolved_steps", "tokens", "model_calls", "duration_ms", "reviews", "escaped")


@query(f"WITH {S.TASKS_SQL} {S.COHORTS_SQL}")
def task_cohorts(spark, folder):
    """AGG20 to AGG22, PCT1, PCT5."""
    return T.cohorts(trajectories(spark, folder), percentile_digits=12)


@query(f"WITH {S.TASKS_SQL}, {S.STRATEGIES_SQL} SELECT *, closed_tasks >= 100 AS recommendation_eligible FROM compared")
def strategy_comparison(spark, folder):
    """AGG23."""
    return T.strategies(trajectories(spark, folder), percentile_digits=12)


@query(
    f"WITH {S.TASKS_SQL}, {S.STRATEGIES_SQL}, c2 AS (SELECT *, p50_cost_usd AS price FROM compared) SELECT task_type, execution_strategy, strategy_version, NOT EXISTS (SELECT 1 FROM c2 b WHERE b.task_type = a.task_type AND b.price <= a.price AND b.success_rate >= a.success_rate AND (b.price < a.price OR b.success_rate > a.success_rate)) AS pareto_frontier FROM c2 a"
)
def strategy_pareto(spark, folder):
    """J20, with the median cost as price, which every strategy has here."""
    compared = T.strategies(trajectories(spark, folder)).withColumn("cost_per_solved_task_usd", F.col("p50_cost_usd"))
    return T.pareto(compared).select("task_type", "execution_strategy", "strategy_version", "pareto_frontier")


@query(f"WITH {S.TASKS_SQL} SELECT workload, count(*) AS tasks, count(outcome) AS closed_tasks, count(*) FILTER (outcome = 'solved') AS solved_tasks, round(sum(cost_usd), 6) AS resolved_cost_usd, count(*) FILTER (NOT resolved) AS unresolved_tasks FROM tasks WHERE workload IS NOT NULL GROUP BY 1")
def task_metrics_by_workload(spark, folder):
    """AGG18."""
    return T.tasks_by_workload(trajectories(spark, folder))


# Capacity


def usage_series(spark, folder) -> DataFrame:
    return C.series(C.usage_buckets(V.request_traces(spark, folder), KEY), KEY)


@query(f"WITH {S.SERIES_SQL} SELECT deployment_name, slot, input_tpm, output_tpm, tpm, observed, active FROM series")
def capacity_series(spark, folder):
    """WIN8, WIN9, CAP5, CAP7, AGG27, STR7."""
    return usage_series(spark, folder)


@query(f"WITH {S.SERIES_SQL} SELECT * FROM shape")
def capacity_shape(spark, folder):
    """STA1 to STA3, PCT3."""
    return C.series_shape(usage_series(spark, folder), KEY)


@query(f"WITH {S.REQUEST_TRACES_SQL} SELECT deployment_name, count(*) AS requests, count(*) FILTER (status_code = 429) AS throttled, round(quantile_cont(latency_ms, 0.5), 6) AS p50_latency, round(quantile_cont(latency_ms, 0.95), 6) AS p95_latency, round(quantile_cont(latency_ms, 0.99), 6) AS p99_latency FROM traces GROUP BY 1")
def latency_percentiles(spark, folder):
    """STA4, PCT3."""
    return C.latency_shape(V.request_traces(spark, folder), KEY)


@query(
    f"WITH {S.SERIES_SQL}, lat AS (SELECT deployment_name, count(*) FILTER (status_code = 429) / count(*) AS rate, quantile_cont(latency_ms, 0.5) AS p50, quantile_cont(latency_ms, 0.95) AS p95, quantile_cont(latency_ms, 0.99) AS p99 FROM traces GROUP BY 1), "
    "j AS (SELECT *, CASE WHEN deployment_name = 'dep-3' THEN 720000 END AS quota, coalesce(p95_tpm / CASE WHEN deployment_name = 'dep-3' THEN 720000 END, 0) AS used, greatest(0.5, coalesce(daily_similarity, 0), coalesce(weekly_similarity, 0)) AS alike FROM shape JOIN lat USING (deployment_name)), "
    "v AS (SELECT *, CASE WHEN active < 100 THEN 'insufficient' WHEN cv < 0.3 THEN 'positive' WHEN cv > 0.7 THEN 'negative' ELSE 'neutral' END AS workload_shape, CASE WHEN active < 100 THEN 'insufficient' WHEN rate > 0.05 OR used > 0.85 THEN 'positive' WHEN rate < 0.01 AND used < 0.5 THEN 'negative' ELSE 'neutral' END AS capacity_pressure, "
    "CASE WHEN active < 100 THEN 'insufficient' WHEN p95 > 5000 OR p99 / p50 > 4 THEN 'positive' WHEN p95 < 2000 AND p99 / p50 < 2 THEN 'negative' ELSE 'neutral' END AS latency_sensitivity, CASE WHEN active < 100 THEN 'insufficient' WHEN sustained >= 0.6 AND alike >= 0.7 THEN 'positive' WHEN sustained < 0.3 THEN 'negative' ELSE 'neutral' END AS load_predictability FROM j) "
    "SELECT deployment_name, workload_shape, capacity_pressure, latency_sensitivity, load_predictability, round(rate, 6) AS throttle_rate, CASE WHEN quota IS NULL THEN 'Capacity data required' WHEN active < 100 THEN 'Insufficient evidence' WHEN (workload_shape = 'positive')::INT + (capacity_pressure = 'positive')::INT + (latency_sensitivity = 'positive')::INT + (load_predictability = 'positive')::INT >= 3 THEN 'PTU recommended' "
    "WHEN (workload_shape = 'positive')::INT + (capacity_pressure = 'positive')::INT + (latency_sensitivity = 'positive')::INT + (load_predictability = 'positive')::INT >= 2 THEN 'Borderline' ELSE 'PAYG recommended' END AS recommendation FROM v"
)
def capacity_dimensions(spark, folder):
    """CAP2, CAP3, J11."""
    traces = V.request_traces(spark, folder)
    models = traces.groupBy("deployment_name").agg(F.min("model_name").alias("model_name"))
    quota = models.join(F.broadcast(C.capacities(spark)), canonical_model(F.col("model_name")) == F.col("canonical"), "left").select("deployment_name", "quota")
    shape = C.series_shape(usage_series(spark, folder), KEY).join(quota, "deployment_name")
    return C.dimensions(shape, C.latency_shape(traces, KEY), KEY)


def plans(spark) -> DataFrame:
    rows = [(f"dep-{i}", 50 + 20 * i, 4, 15, 5, 1.0, 50.0 + 200 * i) for i in range(5)]
    return spark.createDataFrame(rows, "deployment_name string, tpm_per_unit long, output_ratio int, least long, step long, hourly_rate double, blended double")


PLANS_SQL = "plans AS (SELECT 'dep-' || i AS deployment_name, 50 + 20 * i AS tpm_per_unit, 4 AS output_ratio, 15 AS least, 5 AS step, 1.0e0 AS hourly_rate, 50.0e0 + 200 * i AS blended FROM range(5) t(i))"
SWEEP_SQL = (
    f"WITH {S.SERIES_SQL}, {PLANS_SQL}, weighted AS (SELECT *, input_tpm + output_ratio * output_tpm AS weighted FROM series JOIN plans USING (deployment_name)), "
    "facts AS (SELECT deployment_name, count(*) AS n, quantile_cont(weighted, 0.95) AS p95, max(weighted) AS peak, avg(tpm) AS mean_tpm FROM weighted GROUP BY 1), "
    "sized AS (SELECT *, greatest(least, CAST(ceil(p95 * 1.2 / tpm_per_unit / step) AS BIGINT) * step) AS p95_units, greatest(least, CAST(ceil(p95 * 1.2 / tpm_per_unit / step) AS BIGINT) * step, CAST(ceil(peak * 1.2 / tpm_per_unit / step) AS BIGINT) * step) AS upper FROM facts JOIN plans USING (deployment_name)), "
    "grid AS (SELECT *, unnest(range(least, upper + 1, step)) AS units FROM sized), "
    "tried AS (SELECT g.deployment_name, g.units, any_value(g.p95_units) AS p95_units, any_value(g.tpm_per_unit) AS tpu, any_value(g.hourly_rate) AS hr, any_value(g.blended) AS blended, any_value(g.n) AS n, any_value(g.mean_tpm) AS mean_tpm, sum(greatest(0, weighted - g.units * g.tpm_per_unit)) AS overflow, count(*) FILTER (weighted > g.units * g.tpm_per_unit) AS over FROM grid g JOIN weighted w ON g.deployment_name = w.deployment_name GROUP BY 1, 2), "
    "costed AS (SELECT *, units * hr * 720 * 0.35 AS reserved, units * hr * 720 * 0.35 + overflow / n * 43200 / 1000000 * blended AS hybrid, mean_tpm * 43200 / 1000000 * blended AS payg FROM tried), "
    "best AS (SELECT * FROM costed QUALIFY row_number() OVER (PARTITION BY deployment_name ORDER BY round(hybrid, 9), units) = 1) "
)


@query(
    SWEEP_SQL
    + "SELECT deployment_name, p95_units, units AS suggested_units, units * tpu AS capacity_tpm, round(reserved, 4) AS reserved_monthly, round(units * hr * 720, 4) AS hourly_monthly, round(hybrid, 6) AS hybrid_monthly, round(payg, 6) AS payg_monthly, round(over / n * 100, 4) AS spillover_percent, "
    "round(CASE WHEN reserved * 1000000 / (43200 * blended) <= units * tpu THEN reserved * 1000000 / (43200 * blended) END, 4) AS break_even_tpm, CASE WHEN round(hybrid, 9) < round(payg, 9) THEN 'PTU lower' ELSE 'PAYG lower' END AS economic_result FROM best"
)
def capacity_sweep(spark, folder):
    """SRT10, CAP1."""
    return C.sweep(usage_series(spark, folder), plans(spark), KEY)


@query(
    SWEEP_SQL
    + ", chosen AS (SELECT b.deployment_name, f.peak, f.mean_tpm AS avg_tpm, b.units * b.tpu AS cap, round(b.reserved, 4) AS reserved, b.blended, 43200 / 1000000 * b.blended AS rate FROM best b JOIN facts f USING (deployment_name)), "
    "pts AS (SELECT *, unnest(range(0, 61)) AS i, greatest(peak, cap, avg_tpm, 1) * 1.2 AS top FROM chosen), lines AS (SELECT *, top * i / 60 AS x, top * i / 60 * rate AS p, reserved + greatest(0, top * i / 60 - cap) * rate AS h FROM pts), "
    "steps AS (SELECT *, h - p AS gap, lag(h - p) OVER w AS g0, lag(x) OVER w AS x0 FROM lines WINDOW w AS (PARTITION BY deployment_name ORDER BY i)) "
    "SELECT deployment_name, CAST(i AS INTEGER) AS i, round(x, 2) AS sustained_tpm, round(p, 4) AS payg_monthly, round(h, 4) AS hybrid_monthly, round(CASE WHEN g0 = 0 THEN x0 WHEN (g0 < 0) <> (gap < 0) THEN x0 + abs(g0) / (abs(g0) + abs(gap)) * (x - x0) END, 2) AS crossing_tpm FROM steps"
)
def capacity_cost_curve(spark, folder):
    """CAP6, WIN10."""
    points = usage_series(spark, folder)
    best = C.sweep(points, plans(spark), KEY)
    rows = points.join(F.broadcast(plans(spark)), KEY)
    facts = rows.groupBy("deployment_name").agg(F.max(F.col("input_tpm") + F.col("output_ratio") * F.col("output_tpm")).alias("peak"), F.avg("tpm").alias("average_tpm"), F.max("blended").alias("blended"))
    return C.cost_curve(best.join(facts, KEY), KEY)


@query(
    f"WITH {S.SERIES_SQL}, lat AS (SELECT deployment_name, count(latency_ms) / count(*) AS latency_share, count(status_code) / count(*) AS outcome_share FROM traces GROUP BY 1), "
    "s AS (SELECT deployment_name, round((0.3e0 * least(1, active / 100) + 0.18e0 * least(1, elapsed * 5 / 1440 / 7) + 0.15e0 * least(1, observed / elapsed) + 0.1e0 * outcome_share + 0.1e0 * latency_share + 0.1e0 * 0.5e0 + CASE WHEN deployment_name <> 'dep-4' THEN 0.02e0 ELSE 0 END + CASE WHEN deployment_name = 'dep-3' THEN 0.03e0 ELSE 0 END + 0.02e0) * 100, 1) AS confidence_score FROM shape JOIN lat USING (deployment_name)) "
    "SELECT *, CASE WHEN confidence_score >= 90 THEN 'High confidence' WHEN confidence_score >= 70 THEN 'Moderate confidence' WHEN confidence_score >= 50 THEN 'Low confidence' ELSE 'Insufficient evidence' END AS confidence_label FROM s"
)
def capacity_confidence(spark, folder):
    """STA5, STA6."""
    shares = V.request_traces(spark, folder).groupBy("deployment_name").agg((F.count("latency_ms") / F.count(F.lit(1))).alias("latency_share"), (F.count("status_code") / F.count(F.lit(1))).alias("outcome_share"))
    name = F.col("deployment_name")
    rows = C.series_shape(usage_series(spark, folder), KEY).join(shares, KEY).withColumns({"observed_days": F.col("elapsed") * 5 / 1440, "pricing_share": F.lit(0.5), "identity_known": name != "dep-4", "capacity_known": name == "dep-3", "mode_known": F.lit(True)})
    return C.confidence(rows, KEY)


# Sources, price sources, samples


@query(
    f"WITH {S.REQUEST_TRACES_SQL} SELECT deployment_name, model_name, provider, service_tier, input_tokens, output_tokens, cached_tokens, round(latency_ms, 3) AS latency_ms, CAST(CASE WHEN status_code = 200 THEN 200 ELSE status_code END AS INTEGER) AS status_code, status_code <> 200 AS failed, CASE WHEN status_code <> 200 THEN CASE WHEN ingest_seq % 3 = 0 THEN 'rate_limited' ELSE 'unknown' END END AS error_category, 1 AS content_dropped FROM traces"
)
def otel_spans_flatten(spark, folder):
    """SRC7, PRJ8 to PRJ10, PRJ18, AGG40: the traces written as OTLP documents and read back as spans."""
    t = V.request_traces(spark, folder).repartition(spark.sparkContext.defaultParallelism)  # parsing is far dearer than dealing the rows out
    attribute = lambda k, v, kind: F.struct(F.lit(k).alias("key"), F.struct(v.cast("string").alias(kind)).alias("value"))
    pairs = [
        ("gen_ai.system", F.lit("az.ai.inference"), "stringValue"), ("gen_ai.response.model", F.col("model_name"), "stringValue"), ("gen_ai.azure.deployment_name", F.col("deployment_name"), "stringValue"), ("gen_ai.usage.input_tokens", F.col("input_tokens"), "intValue"), ("gen_ai.usage.completion_tokens", F.col("output_tokens"), "intValue"),
        ("gen_ai.usage.cached_input_tokens", F.col("cached_tokens"), "intValue"), ("gen_ai.prompt", F.lit("secret words"), "stringValue"), ("http.response.status_code", F.when(F.col("status_code") != 200, F.col("status_code")), "intValue"), ("thread.id", F.lit("7"), "intValue"),
        ("error.type", F.when((F.col("status_code") != 200) & (F.col("ingest_seq") % 3 == 0), "RateLimitError"), "stringValue"),
    ]
    listed = F.concat_ws(",", *[F.when(v.isNotNull(), F.to_json(attribute(k, v, kind))) for k, v, kind in pairs])
    start = F.unix_micros("ts") * 1000
    code = F.when(F.col("status_code") != 200, "STATUS_CODE_ERROR").otherwise("STATUS_CODE_OK")
    end = F.when(F.col("latency_ms").isNotNull(), F.concat(F.lit(',"endTimeUnixNano":"'), (start + F.round(F.col("latency_ms") * 1_000_000).cast("long")).cast("string"), F.lit('"'))).otherwise("")
    span = F.concat(F.lit('{"name":"chat","spanId":"'), F.col("ingest_seq"), F.lit('","startTimeUnixNano":"'), start.cast("string"), F.lit('"'), end, F.lit(',"status":{"code":"'), code, F.lit('"},"attributes":['), listed, F.lit("]}"))
    document = F.concat(F.lit('{"resourceSpans":[{"scopeSpans":[{"spans":['), span, F.lit("]}]}]}"))
    spans = X.map_spans(X.spans_of(X.parsed(t.select(F.lit("-").alias("file"), document.alias("value")))))
    return spans.select("deployment_name", "model_name", "provider", "service_tier", "input_tokens", "output_tokens", "cached_tokens", "latency_ms", "status_code", "failed", "error_category", "content_dropped")


@query(
    f"WITH {S.REQUEST_TRACES_SQL} SELECT deployment_name, model_name, provider, 'standard' AS service_tier, CAST(epoch_us(ts) // 1000 AS BIGINT) AS millis, input_tokens, output_tokens, CASE WHEN status_code = 429 THEN 'rate_limit' END AS error_category FROM traces WHERE model_name <> 'unknown'"
)
def generic_mapping(spark, folder):
    """SRC15, SRC16, PRJ11 to PRJ13, AGG39: application logs by a declared mapping."""
    t = V.request_traces(spark, folder)
    line = F.to_json(F.struct((F.floor(F.unix_micros("ts") / 1000)).alias("ts"), F.struct(F.col("deployment_name").alias("name"), F.when(F.col("model_name") != "unknown", F.col("model_name")).alias("model")).alias("target"), F.struct(F.col("input_tokens").alias("prompt_tokens"), F.col("output_tokens").alias("completion_tokens")).alias("usage"), F.when(F.col("status_code") == 429, "rate_limit").when(F.col("status_code") == 500, "odd").alias("error")))
    mapping = {"fields": {"timestamp": "ts", "deployment_name": "target.name", "model_name": "target.model", "error_category": "error"}, "usage": {"input_tokens": "usage.prompt_tokens", "output_tokens": "usage.completion_tokens"}, "defaults": {"provider": "azure_foundry", "service_tier": "standard"}, "timestamp_format": "auto"}
    rows = X.mapped_rows(X.parsed(t.select(F.lit("-").alias("file"), line.alias("value"))), mapping)
    return rows.select("deployment_name", "model_name", "provider", "service_tier", F.unix_millis("ts").alias("millis"), "input_tokens", "output_tokens", "error_category")


@query(
    "WITH slots AS (SELECT CAST(floor(epoch(ts) / 300) * 300 AS BIGINT) AS bucket, 'dep-' || (user_id % 5) AS deployment_name, event_type, value, CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 429 ELSE 500 END ELSE 200 END AS code FROM events) "
    "SELECT bucket, deployment_name, CAST(sum(round(value)) FILTER (event_type IN ('view', 'click')) AS BIGINT) AS input_tokens, count(*) AS requests, count(*) FILTER (code = 200) AS successful_requests, count(*) FILTER (code = 429) AS throttled_requests, count(*) FILTER (code = 500) AS failed_requests FROM slots GROUP BY 1, 2"
)
def status_code_pivot(spark, folder):
    """AGG8, SRC18, PRJ15, FLT17: long metric series to wide buckets; every series is given twice and counted once."""
    e = V.table(spark, folder, "events")
    code = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, "429").otherwise("500")).otherwise("200")
    at = (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 300) * 300).cast("long")
    base = e.select(at.alias("ts"), F.concat(F.lit("dep-"), F.col("user_id") % 5).alias("d"), "event_type", "value", code.alias("code"))
    asked = base.groupBy("ts", "d", "code").agg(F.count(F.lit(1)).cast("double").alias("total")).select(F.lit("ModelRequests").alias("metric_name"), F.create_map(F.lit("MODELDEPLOYMENTNAME"), F.col("d"), F.lit("statuscode"), F.col("code")).alias("dimensions"), "ts", "total", F.lit(None).cast("double").alias("average"))
    tokens = base.where(F.col("event_type").isin("view", "click")).groupBy("ts", "d", "event_type").agg(F.sum(F.round("value")).alias("total")).select(F.lit("ProcessedPromptTokens").alias("metric_name"), F.create_map(F.lit("DeploymentName"), F.col("d"), F.lit("ContextLength"), F.col("event_type")).alias("dimensions"), "ts", "total", F.lit(None).cast("double").alias("average"))
    series = asked.unionByName(tokens)
    wide = B.pivot_points(X.metric_points(series.unionByName(series)))
    return wide.select(F.col("ts").alias("bucket"), "deployment_name", "input_tokens", "requests", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("successful_requests", "throttled_requests", "failed_requests")])


#: A meter of each part, as expressions that both engines read: its label's words come from the part's columns.
METER_NAME = (
    "'m' || (p_partkey % 40) || '.' || (p_partkey % 3) || CASE WHEN p_partkey % 5 = 0 THEN ' Luna' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN ' ShortCo' WHEN p_size % 3 = 1 THEN ' LongCo' ELSE '' END || CASE WHEN p_size % 16 = 5 THEN ' ShCo' ELSE '' END"
    " || CASE p_size % 4 WHEN 0 THEN ' Inp' WHEN 1 THEN ' Cache Input' WHEN 2 THEN ' Opt' ELSE ' output' END || CASE WHEN p_size % 13 = 7 THEN ' Inp' ELSE '' END || CASE p_partkey % 7 WHEN 0 THEN ' Gl' WHEN 1 THEN ' Dz' WHEN 2 THEN ' REG' WHEN 3 THEN ' Gl-Dz' ELSE '' END"
    " || CASE WHEN p_partkey % 11 = 0 THEN ' ' || p_type WHEN p_partkey % 11 = 1 THEN ' Batch' ELSE '' END || CASE WHEN p_partkey % 17 = 3 THEN ' Calls' ELSE ' 1M Tokens' END"
)
METER_COLUMNS = {
    "meterName": METER_NAME,
    "skuName": "CASE WHEN p_partkey % 19 = 4 THEN 'luna-in-FT' ELSE p_brand END",
    "type": "CASE WHEN p_partkey % 23 = 5 THEN 'Reservation' ELSE 'Consumption' END",
    "unitOfMeasure": "CASE WHEN p_partkey % 29 = 6 THEN '1/Hour' WHEN p_partkey % 2 = 0 THEN '1M' ELSE '1K' END",
    "armRegionName": "CASE WHEN p_partkey % 6 = 0 THEN 'westus' ELSE 'eastus' END",
    "tierMinimumUnits": "CASE WHEN p_partkey % 31 = 7 THEN 5e0 ELSE 0e0 END",
}
#: Labels of meters' models: those of even numbers, and their longer forms.
CROSSWALK_SQL = "SELECT DISTINCT 'model-' || (p_partkey % 40) || '.' || (p_partkey % 3) AS model, 'microsoft' AS publisher, 'M' || (p_partkey % 40) || '.' || (p_partkey % 3) AS label FROM part WHERE p_partkey % 40 % 2 = 0 UNION ALL SELECT DISTINCT 'model-' || (p_partkey % 40) || '.' || (p_partkey % 3) || '-luna', 'microsoft', 'm' || (p_partkey % 40) || '.' || (p_partkey % 3) || '-LUNA' FROM part WHERE p_partkey % 40 % 4 = 0"


def meters(spark, folder) -> DataFrame:
    text = {"armSkuName": "''", "productName": "'p'", "serviceName": "'Foundry Models'", "effectiveStartDate": "'2026-01-01'", "reservationTerm": "CAST(NULL AS STRING)"}
    return V.table(spark, folder, "part").select(F.concat(F.lit("m"), F.col("p_partkey")).alias("meterId"), *[F.expr(e).alias(n) for n, e in {**METER_COLUMNS, **text}.items()], F.col("p_retailprice").alias("retailPrice"))


def crosswalk(spark, folder) -> DataFrame:
    return spark.sql(CROSSWALK_SQL.replace("FROM part", "FROM {part}"), part=V.table(spark, folder, "part"))


def parsed_meters(spark, folder) -> DataFrame:
    return Y.parse_meters(meters(spark, folder), crosswalk(spark, folder))


def _meter_sql() -> str:
    """Meters taken apart word by word, and the first reason against each."""
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    of = {kind: [w for w, k in fixed.METER_WORDS.items() if k == kind] for kind in dict.fromkeys(fixed.METER_WORDS.values())}
    has = lambda kind: f"list_has_any(rest, {listed(of[kind])})"
    why = "map {" + ", ".join(f"'{w}': '{r}'" for w, r in fixed.METER_EXCLUDED.items()) + "}"
    words = lambda x: f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^a-z0-9.]+'), lambda w: w <> '')"
    return (
        f"WITH x AS ({CROSSWALK_SQL}), labels AS (SELECT model, {words('label')} AS l FROM x), "
        f"raw AS (SELECT 'm' || p_partkey AS \"meterId\", p_retailprice AS price, {METER_COLUMNS['meterName']} AS name, {METER_COLUMNS['skuName']} AS sku, {METER_COLUMNS['type']} AS kind, {METER_COLUMNS['unitOfMeasure']} AS unit, {METER_COLUMNS['armRegionName']} AS region, {METER_COLUMNS['tierMinimumUnits']} AS least FROM part), "
        f"m AS (SELECT *, {words('name')} AS t, {words('sku')} AS k FROM raw), "
        "n AS (SELECT m.*, len(l) AS prefix, model AS of_model FROM m LEFT JOIN labels ON t[1:len(l)] = l QUALIFY row_number() OVER (PARTITION BY \"meterId\" ORDER BY len(l) DESC NULLS LAST) = 1), r AS (SELECT *, CASE WHEN prefix IS NOT NULL THEN t[prefix + 1:] END AS rest FROM n), "
        f"f AS (SELECT *, list_filter(list_transform(list_concat(t, k), lambda w: {why}[w]), lambda x: x IS NOT NULL)[1] AS barred, {has('global')}::INT + {has('data_zone')}::INT + {has('regional')}::INT AS modes, "
        f"len(list_filter(rest, lambda w: NOT list_contains({listed([*fixed.METER_WORDS, *fixed.METER_EXCLUDED])}, w))) AS strange, CASE WHEN {has('cache')} AND {has('write')} THEN 'cache_write' WHEN {has('cache')} AND {has('input')} THEN 'cached_input' WHEN {has('output')} AND NOT {has('input')} THEN 'output' WHEN {has('input')} AND NOT {has('output')} THEN 'input' END AS dimension, "
        "CASE regexp_extract(unit, '(?i)^\\s*(\\d+)\\s*([km])$', 2) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 END * try_cast(regexp_extract(unit, '^\\s*(\\d+)', 1) AS DOUBLE) AS units FROM r), "
        "j AS (SELECT *, CASE WHEN kind <> 'Consumption' THEN 'non-consumption-meter' WHEN least <> 0 THEN 'tiered-meter' WHEN t[-1] NOT IN ('token', 'tokens') THEN 'non-token-meter' WHEN prefix IS NULL THEN 'model-not-in-crosswalk' WHEN barred IS NOT NULL THEN 'excluded-' || barred WHEN strange > 0 THEN 'unrecognized-meter-token' "
        f"WHEN dimension IS NULL THEN 'dimension-ambiguous' WHEN modes > 1 THEN 'deployment-ambiguous' WHEN {has('short')} AND {has('long')} THEN 'context-ambiguous' WHEN units IS NULL THEN 'unit-of-measure-unsupported' END AS rejected FROM f), "
        f"parsed AS (SELECT \"meterId\", region, rejected, CASE WHEN rejected IS NULL THEN of_model END AS model, CASE WHEN rejected IS NULL THEN dimension END AS dimension, CASE WHEN rejected IS NULL THEN CASE WHEN {has('data_zone')} THEN 'data_zone' WHEN {has('regional')} THEN 'regional' ELSE 'global' END END AS deployment, "
        f"CASE WHEN rejected IS NULL THEN CASE WHEN {has('long')} THEN 'long' ELSE 'short' END END AS context, CASE WHEN rejected IS NULL THEN round(price * 1000000 / units, 10) END AS per_million FROM j)"
    )


@query(_meter_sql() + ' SELECT "meterId", rejected, dimension, deployment, context, per_million FROM parsed')
def meter_parse(spark, folder):
    """FLT15, J16, CST5, CST6: retail meters, accepted or with the first reason against."""
    return parsed_meters(spark, folder).select("meterId", "rejected", "dimension", "deployment", "context", "per_million")


@query(_meter_sql() + " SELECT model, deployment, context, dimension, CASE WHEN min(per_million) = max(per_million) THEN min(per_million) END AS per_million, CASE WHEN min(per_million) <> max(per_million) THEN 'region-rate-conflict' END AS rejected FROM parsed WHERE rejected IS NULL GROUP BY ALL")
def meter_candidates(spark, folder):
    """AGG36, AGG37: one rate a dimension, or a conflict between regions."""
    return Y.resolve_meters(parsed_meters(spark, folder)).select("model", "deployment", "context", "dimension", "per_million", "rejected")


def billing_rows(spark, folder) -> DataFrame:
    """Lines as billed components: part number as model, odd lines as input and even lines as output."""
    line = V.table(spark, folder, "lineitem")
    return line.select(F.concat(F.lit("m"), F.col("l_partkey") % 400).alias("model"), F.col("l_returnflag").alias("processing_scope"), F.when(F.col("l_linenumber") % 2 == 1, "input_tokens").otherwise("output_tokens").alias("component"), (F.col("l_extendedprice") / 1000).alias("unit_price"), F.lit(1000.0).alias("unit_multiplier"), F.when(F.col("l_quantity") > 5, F.col("l_quantity")).alias("quantity"), F.lit("USD").alias("currency"), F.to_date("l_shipdate").alias("effective_from"), F.date_add(F.to_date("l_shipdate"), 40).alias("effective_to"))


BILLING_SQL = "billed AS (SELECT 'm' || (l_partkey % 400) AS model, l_returnflag AS processing_scope, CASE WHEN l_linenumber % 2 = 1 THEN 'input_tokens' ELSE 'output_tokens' END AS component, l_extendedprice / 1000 AS unit_price, CASE WHEN l_quantity > 5 THEN l_quantity END AS quantity, CAST(l_shipdate AS DATE) AS a, CAST(l_shipdate AS DATE) + 40 AS z FROM lineitem), asked AS (SELECT o_orderkey AS request, 'm' || (o_custkey % 500) AS model, 'A' AS processing_scope, 'input_tokens' AS component, CAST(o_orderdate AS DATE) AS asked_at FROM orders)"
FOUND_SQL = f"WITH {BILLING_SQL}, found AS (SELECT request, count(b.model) AS n, min(unit_price) AS p, min(quantity) AS q FROM asked LEFT JOIN billed b ON b.model = asked.model AND b.processing_scope = asked.processing_scope AND b.component = asked.component AND asked_at BETWEEN a AND z GROUP BY 1)"


def imported(spark, folder) -> DataFrame:
    asked = V.table(spark, folder, "orders").select(F.col("o_orderkey").alias("request"), F.concat(F.lit("m"), F.col("o_custkey") % 500).alias("model"), F.lit("A").alias("processing_scope"), F.lit("input_tokens").alias("component"), F.to_date("o_orderdate").alias("at"))
    return Y.imported_prices(billing_rows(spark, folder), asked)


@query(FOUND_SQL + " SELECT request, CASE WHEN n = 0 THEN 'NO_PRICE' WHEN n > 1 THEN 'AMBIGUOUS' WHEN q IS NULL THEN 'RATE_VERIFIED_USAGE_MISSING' ELSE 'RESOLVED' END AS state, round(CASE WHEN n = 1 THEN p / 1000 END, 9) AS rate FROM found")
def imported_price_ambiguity(spark, folder):
    """J7."""
    return imported(spark, folder).select("request", "state", F.round("rate", 9).alias("rate"))


@query(FOUND_SQL + " SELECT request, round(CASE WHEN n = 1 THEN p / 1000 WHEN request % 3 = 0 THEN 0.5e0 END, 9) AS rate, CASE WHEN n = 1 THEN 0 WHEN request % 3 = 0 THEN 1 END AS layer FROM found")
def layered_price(spark, folder):
    """J6, J8, J9: imported rows first, then a static list."""
    first = imported(spark, folder)
    second = V.table(spark, folder, "orders").select(F.col("o_orderkey").alias("request")).where("request % 3 = 0").select("request", F.lit("RESOLVED").alias("state"), F.lit(0.5).alias("rate"), F.lit("USD").alias("currency"))
    return Y.layered_prices([first, second], "USD").select("request", F.round("rate", 9).alias("rate"), "layer")


@query(f"WITH {BILLING_SQL} SELECT CASE WHEN model IN (SELECT 'm' || i FROM range(100) t(i)) THEN 'matched' ELSE 'unmatched' END AS kind, count(*) AS rows, round(sum(unit_price * coalesce(quantity, 0) / 1000), 6) AS cost FROM billed GROUP BY 1")
def actual_cost_join(spark, folder):
    """J10, AGG38."""
    return Y.actual_cost(billing_rows(spark, folder), spark.range(100).select(F.concat(F.lit("m"), F.col("id")).alias("model")))


@query("SELECT event_id, CAST(('0x' || substr(sha256('k' || event_id), 1, 16)) AS UBIGINT) / 18446744073709551616.0e0 < 0.25e0 AS sampled FROM events")
def deterministic_sample(spark, folder):
    """FLT12."""
    return V.table(spark, folder, "events").select("event_id", sampled(F.concat(F.lit("k"), F.col("event_id")), 0.25).alias("sampled"))


@query()
def lttb_downsample(spark, folder):
    """WIN11."""
    return Z.downsample(usage_series(spark, folder), KEY, "slot", "tpm", 200)


@query(
    f"WITH {S.PRICED_SQL}{S.slice_sql('deployment_name, model_name, deployment_mode, canonical')}, q AS (SELECT deployment_name, 'identity' AS issue, 'the model isn''t named' AS detail FROM summary WHERE pricing_status = 'identity_unresolved' UNION ALL SELECT deployment_name, 'input_tokens', input_tokens_state FROM summary WHERE input_tokens_state <> 'measured' "
    "UNION ALL SELECT deployment_name, 'output_tokens', output_tokens_state FROM summary WHERE output_tokens_state <> 'measured' UNION ALL SELECT deployment_name, 'cached_tokens', cached_tokens_state FROM summary WHERE cached_tokens_state <> 'measured' UNION ALL SELECT deployment_name, 'pricing', unresolved_reasons FROM summary WHERE NOT pricing_complete) SELECT * FROM q"
)
def data_quality(spark, folder):
    """DQ1."""
    return A.data_quality(R.deployment_rollup(priced(spark, folder)))


from . import catalog_more, catalog_stored  # noqa: E402, F401 - register their queries
