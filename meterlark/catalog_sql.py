"""SQL of the views and of pricing, for the queries' SQL side."""

from . import fixed
from .sources.views import METRIC_BUCKETS_SQL, REQUEST_TRACES_SQL

_value = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x!r}e0" if isinstance(x, float) else repr(x)

#: Customer prices of the queries: model, aliases, region, from, to, context from, context to, input, cached, output, rank.
CUSTOMER_PRICES = [
    ("gpt-4.1", [], None, "2024-01-01", "2024-01-15", None, 9999, 2.0, 0.5, 8.0, 10),
    ("gpt-4.1", [], None, "2024-01-01", "2024-01-15", 10000, None, 4.0, 1.0, 12.0, 10),
    ("gpt-4.1", [], None, "2024-01-16", None, None, None, 1.9, 0.4, 7.5, 10),
    ("thinking-house", ["mai-thinking-1"], "global", "2024-01-05", "2024-01-25", None, None, 1.8, 0.18, 7.2, 10),
    ("mai-thinking-1", [], "global", "2024-01-10", "2024-01-20", None, None, 1.7, None, 7.0, 100),
]


def customer_entries() -> list[dict]:
    names = ["model", "aliases", "region", "effective_from", "effective_to", "context_min", "context_max", "input_rate", "cached_rate", "output_rate", "source_rank"]
    return [dict(zip(names, row, strict=True)) | {"confidence": "customer_override"} for row in CUSTOMER_PRICES]


def _rows() -> str:
    rows, seq = [], 0
    for model, aliases, *rest in CUSTOMER_PRICES:
        for match, name in enumerate([model, *aliases]):
            rows.append(["customer", "house", name, min(match, 1), seq, "customer_override", *rest])
        seq += 1
    for model, region, a, c, o in fixed.REFERENCE_PRICES:
        rows.append(["reference", fixed.REFERENCE_CATALOG["name"], model, 0, seq, "verified", region, fixed.REFERENCE_CATALOG["retrieved_at"], None, None, None, a, c, o, 100])
        seq += 1
    return ",\n  ".join("(" + ", ".join(map(_value, r)) + ")" for r in rows)


PUBLISHER_SQL = "CASE " + " ".join(f"WHEN starts_with(canonical, '{p}') THEN '{n}'" for p, n in fixed.PUBLISHER_PREFIXES) + " END"

#: traces, prices and priced: each trace with both readings of cached input (a: as it is, b: unmeasured as zero).
PRICED_SQL = (
    REQUEST_TRACES_SQL
    + f""",
prices(kind, catalog, name, match, seq, confidence, region, starts, ends, context_min, context_max, input_rate, cached_rate, output_rate, source_rank) AS (VALUES
  {_rows()}),
named AS (SELECT *, regexp_replace(regexp_replace(lower(trim(model_name)), '[\\s_]+', '-', 'g'), '-+', '-', 'g') AS canonical FROM traces),
matched AS (
  SELECT n.ingest_seq, p.*, row_number() OVER (PARTITION BY n.ingest_seq, p.kind ORDER BY p.match, p.source_rank, CASE WHEN p.context_min IS NULL AND p.context_max IS NULL THEN 1 ELSE 0 END, p.starts DESC, p.seq) AS nth
  FROM named n JOIN prices p ON n.canonical = p.name AND (p.region IS NULL OR p.region = n.deployment_mode)
    AND CASE WHEN p.kind = 'reference' THEN '2026-09-14' ELSE strftime(n.ts, '%Y-%m-%d') END BETWEEN p.starts AND coalesce(p.ends, '9999-12-31')
    AND coalesce(n.input_tokens, 0) BETWEEN coalesce(p.context_min, 0) AND coalesce(p.context_max, 1000000000000)),
chosen AS (
  SELECT n.*, coalesce(c.kind, r.kind) AS kind, coalesce(c.catalog, r.catalog) AS catalog, coalesce(c.confidence, r.confidence) AS confidence,
    CASE WHEN c.kind IS NOT NULL THEN c.input_rate ELSE r.input_rate END AS input_rate, CASE WHEN c.kind IS NOT NULL THEN c.cached_rate ELSE r.cached_rate END AS cached_rate,
    CASE WHEN c.kind IS NOT NULL THEN c.output_rate ELSE r.output_rate END AS output_rate, coalesce(c.starts, r.starts) AS starts, {PUBLISHER_SQL} AS publisher
  FROM named n LEFT JOIN matched c ON c.ingest_seq = n.ingest_seq AND c.kind = 'customer' AND c.nth = 1 LEFT JOIN matched r ON r.ingest_seq = n.ingest_seq AND r.kind = 'reference' AND r.nth = 1),
readings AS (
  SELECT 'a' AS reading, *, cached_tokens AS cached FROM chosen UNION ALL SELECT 'b' AS reading, *, coalesce(cached_tokens, 0) AS cached FROM chosen),
judged AS (
  SELECT *, concat_ws(',', CASE WHEN input_tokens IS NULL THEN 'input_tokens' END, CASE WHEN cached IS NULL THEN 'cached_tokens' END, CASE WHEN output_tokens IS NULL THEN 'output_tokens' END) AS missing FROM readings),
priced AS (
  SELECT *,
    CASE WHEN observed_cost_usd IS NOT NULL THEN 'observed' WHEN missing <> '' OR kind IS NULL OR (cached <> 0 AND cached_rate IS NULL) THEN 'unresolved' ELSE kind END AS source,
    CASE WHEN observed_cost_usd IS NOT NULL THEN NULL WHEN missing <> '' THEN 'usage-metrics-unavailable:' || missing WHEN kind IS NULL THEN 'no-exact-model-mode-price' WHEN cached <> 0 AND cached_rate IS NULL THEN 'cached-input-rate-unavailable' END AS reason,
    CASE WHEN observed_cost_usd IS NULL AND missing = '' AND kind IS NOT NULL AND (cached = 0 OR cached_rate IS NOT NULL) THEN (input_tokens - cached) * input_rate / 1000000 END AS fresh_cost,
    CASE WHEN observed_cost_usd IS NULL AND missing = '' AND kind IS NOT NULL AND (cached = 0 OR cached_rate IS NOT NULL) THEN cached * coalesce(cached_rate, 0) / 1000000 END AS cached_cost,
    CASE WHEN observed_cost_usd IS NULL AND missing = '' AND kind IS NOT NULL AND (cached = 0 OR cached_rate IS NOT NULL) THEN output_tokens * output_rate / 1000000 END AS output_cost,
    coalesce(input_tokens, 0) + coalesce(output_tokens, 0) AS tokens
  FROM judged),
costed AS (
  SELECT *, CASE WHEN source = 'observed' THEN observed_cost_usd ELSE fresh_cost + cached_cost + output_cost END AS cost_usd,
    CASE WHEN source IN ('customer', 'reference') THEN starts END AS priced_from, CASE WHEN source IN ('customer', 'reference') THEN catalog END AS priced_by,
    CASE WHEN source = 'observed' THEN 'observed_cost' WHEN source <> 'unresolved' THEN 'token_rate' END AS basis,
    CASE WHEN source = 'observed' THEN 'observed' WHEN source <> 'unresolved' THEN confidence END AS trust,
    CASE WHEN reason LIKE 'usage%' OR reason LIKE 'no-exact%' THEN canonical END AS override_key
  FROM priced)"""
)


def state(x: str) -> str:
    return f"CASE WHEN count({x}) = 0 THEN 'unavailable' WHEN count({x}) < count(*) THEN 'partial' ELSE 'measured' END"


def one_or_mixed(x: str) -> str:
    return f"CASE WHEN min({x}) = max({x}) THEN min({x}) WHEN min({x}) IS NOT NULL THEN 'mixed' END"


def slice_sql(keys: str, digits: int = 6) -> str:
    """A rollup of costed traces by ``keys`` ('' for none)."""
    group = f"GROUP BY {keys}, reading" if keys else "GROUP BY reading"
    first = f"{keys}, " if keys else ""
    total = "CASE WHEN input_tokens IS NOT NULL OR output_tokens IS NOT NULL THEN coalesce(input_tokens, 0) + coalesce(output_tokens, 0) END"
    return f""",
sliced AS (
  SELECT {first}reading, count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
    {state("input_tokens")} AS input_tokens_state, {state("cached_tokens")} AS cached_tokens_state, {state("output_tokens")} AS output_tokens_state,
    count(input_tokens) AS with_input, CAST(sum(tokens) AS BIGINT) AS all_tokens, count(CASE WHEN retry_of <> '' THEN 1 END) AS retries, round(avg(latency_ms), 1) AS average_latency_ms,
    bool_or(lower(trim(model_name)) NOT IN ('', 'unknown', 'none')) AS identified, min(service_tier) AS service_tier,
    round(sum(CASE WHEN source <> 'unresolved' THEN cost_usd END), {digits}) AS estimated_cost_usd,
    CASE WHEN bool_and(fresh_cost IS NOT NULL) FILTER (source <> 'unresolved') THEN round(sum(fresh_cost), {digits}) END AS fresh_input_cost_usd,
    CASE WHEN bool_and(fresh_cost IS NOT NULL) FILTER (source <> 'unresolved') THEN round(sum(cached_cost), {digits}) END AS cached_input_cost_usd,
    CASE WHEN bool_and(fresh_cost IS NOT NULL) FILTER (source <> 'unresolved') THEN round(sum(output_cost), {digits}) END AS output_cost_usd,
    count(*) FILTER (source <> 'unresolved') AS resolved, CAST(coalesce(sum(tokens) FILTER (source <> 'unresolved'), 0) AS BIGINT) AS resolved_tokens,
    count(*) FILTER (source = 'unresolved') AS unresolved_requests, CAST(coalesce(sum(tokens) FILTER (source = 'unresolved'), 0) AS BIGINT) AS unresolved_tokens,
    coalesce({one_or_mixed("CASE WHEN source <> 'unresolved' THEN source END")}, 'unresolved') AS pricing_source,
    {one_or_mixed("priced_by")} AS pricing_catalog_name, {one_or_mixed("priced_from")} AS pricing_effective_from, {one_or_mixed("basis")} AS pricing_billing_basis,
    {one_or_mixed("CASE WHEN source = 'observed' THEN publisher END")} AS pricing_publisher, {one_or_mixed("trust")} AS pricing_confidence,
    array_to_string(list_sort(list(DISTINCT reason) FILTER (reason IS NOT NULL)), ';') AS reasons, array_to_string(list_sort(list(DISTINCT override_key) FILTER (source = 'unresolved' AND override_key IS NOT NULL)), ';') AS override_keys
  FROM costed {group}),
summary AS (
  SELECT * EXCLUDE (reading, with_input, identified, reasons, override_keys, resolved, resolved_tokens, all_tokens), coalesce(reasons, '') AS unresolved_reasons, coalesce(override_keys, '') AS suggested_override_keys,
    CAST({total} AS BIGINT) AS total_tokens,
    CASE WHEN input_tokens_state = output_tokens_state AND input_tokens_state <> 'partial' THEN input_tokens_state ELSE 'partial' END AS total_tokens_state,
    CASE WHEN input_tokens_state = 'measured' AND output_tokens_state = 'measured' THEN round((input_tokens + output_tokens) / requests, 1) END AS average_tokens_per_request,
    round(resolved / greatest(requests, 1) * 100, 1) AS pricing_coverage_requests_percent, round(resolved_tokens / greatest(all_tokens, 1) * 100, 1) AS pricing_coverage_tokens_percent,
    resolved = requests AND resolved_tokens = all_tokens AS pricing_complete,
    CASE WHEN NOT identified THEN 'identity_unresolved' WHEN reasons LIKE '%currency-conversion-required%' THEN 'currency_mismatch'
      WHEN estimated_cost_usd IS NULL AND reasons LIKE '%usage-metrics-unavailable:%' THEN 'usage_incomplete' WHEN unresolved_requests > 0 THEN 'partial' WHEN estimated_cost_usd IS NULL THEN 'catalog_missing'
      WHEN round(resolved_tokens / greatest(all_tokens, 1) * 100, 1) < 100 THEN 'partial' ELSE 'priced' END AS pricing_status
  FROM sliced WHERE reading = CASE WHEN with_input = requests AND input_tokens < 1024 THEN 'b' ELSE 'a' END)"""


def bucket_sql(keys: str) -> str:
    """A summary of metric buckets by ``keys``."""
    group, first = (f"GROUP BY {keys}", f"{keys}, ") if keys else ("", "")
    active = "coalesce(input_tokens, 0) + coalesce(output_tokens, 0) > 0 OR requests > 0"
    return f""",
folded AS (
  SELECT {first}count(*) AS metric_buckets_read, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
    CAST(sum(requests) AS BIGINT) AS requests_observed, CAST(sum(successful_requests) AS BIGINT) AS ok, CAST(sum(throttled_requests) AS BIGINT) AS limited, CAST(sum(failed_requests) AS BIGINT) AS failed,
    {state("input_tokens")} AS input_tokens_state, {state("cached_tokens")} AS cached_state, {state("output_tokens")} AS output_tokens_state,
    CASE WHEN bool_and(outcome_coverage = 'complete') THEN 'complete' ELSE 'partial' END AS outcome_coverage,
    count(DISTINCT bucket) AS observed_buckets, count(DISTINCT CASE WHEN {active} THEN bucket END) AS active_buckets, count(DISTINCT CASE WHEN {active} THEN bucket // 86400 END) AS active_days,
    count(DISTINCT bucket // 86400) AS observed_days, min(bucket) AS a, max(bucket) AS z, count(average_latency_ms) AS with_latency
  FROM buckets {group}),
bucket_summary AS (
  SELECT {first}metric_buckets_read, (z - a) // 300 + 1 AS elapsed_buckets, observed_buckets, active_buckets, greatest(0, observed_buckets - active_buckets) AS idle_buckets, active_days, observed_days, requests_observed,
    ok AS successful_requests, limited AS rate_limited_requests, failed AS failed_requests, outcome_coverage, input_tokens,
    CASE WHEN cached_state = 'unavailable' AND input_tokens < 1024 THEN 0 ELSE cached_tokens END AS cached_tokens, output_tokens,
    CAST(CASE WHEN input_tokens IS NOT NULL OR output_tokens IS NOT NULL THEN coalesce(input_tokens, 0) + coalesce(output_tokens, 0) END AS BIGINT) AS total_tokens, input_tokens_state,
    CASE WHEN cached_state = 'unavailable' AND input_tokens < 1024 THEN 'measured' ELSE cached_state END AS cached_tokens_state, output_tokens_state,
    CASE WHEN input_tokens_state = output_tokens_state AND input_tokens_state <> 'partial' THEN input_tokens_state ELSE 'partial' END AS total_tokens_state,
    round(with_latency / metric_buckets_read * 100, 1) AS latency_coverage_percent
  FROM folded)"""


__all__ = ["METRIC_BUCKETS_SQL", "PRICED_SQL", "REQUEST_TRACES_SQL", "bucket_sql", "customer_entries", "slice_sql", "state"]

#: Steps with their cost, attempts and tasks of the task view.
TASKS_SQL = f"""
prices(kind, catalog, name, match, seq, confidence, region, starts, ends, context_min, context_max, input_rate, cached_rate, output_rate, source_rank) AS (VALUES
  {_rows()}),
steps AS (
  SELECT o_orderkey AS task, 'a' || (l_suppkey % 3) AS attempt, l_linenumber AS n, (l_suppkey + l_linenumber) % 4 <> 0 AS call, l_shipdate + to_minutes(l_linenumber) AS ts,
    (['phi-4', 'mai-thinking-1', 'mai-ds-r1', 'gpt-4.1'])[l_partkey % 4 + 1] AS model, CAST(round(l_quantity * 100) AS BIGINT) AS input, CASE WHEN l_partkey % 4 = 1 THEN CAST(round(l_quantity * 10) AS BIGINT) ELSE 0 END AS cached,
    CAST(round(l_quantity * 20) AS BIGINT) AS output, CASE WHEN l_discount > 0.02 THEN l_extendedprice / 1000000 END AS seen, l_quantity * 10 AS ms, row_number() OVER () AS id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
fits AS (
  SELECT s.id, p.*, row_number() OVER (PARTITION BY s.id ORDER BY CASE p.kind WHEN 'customer' THEN 0 ELSE 1 END, p.match, p.source_rank, CASE WHEN p.context_min IS NULL AND p.context_max IS NULL THEN 1 ELSE 0 END, p.starts DESC, p.seq) AS nth
  FROM steps s JOIN prices p ON s.call AND s.model = p.name AND (p.region IS NULL OR p.region = 'global') AND CASE WHEN p.kind = 'reference' THEN '2026-09-14' ELSE strftime(s.ts, '%Y-%m-%d') END BETWEEN p.starts AND coalesce(p.ends, '9999-12-31')
    AND s.input BETWEEN coalesce(p.context_min, 0) AND coalesce(p.context_max, 1000000000000)),
paid AS (
  SELECT s.*, CASE WHEN NOT call THEN CASE WHEN seen IS NOT NULL THEN 'observed' END WHEN f.id IS NOT NULL AND (cached = 0 OR cached_rate IS NOT NULL) THEN kind END AS source,
    CASE WHEN NOT call THEN seen WHEN f.id IS NOT NULL AND (cached = 0 OR cached_rate IS NOT NULL) THEN ((input - cached) * input_rate + cached * coalesce(cached_rate, 0) + output * output_rate) / 1000000 END AS cost
  FROM steps s LEFT JOIN fits f ON s.id = f.id AND f.nth = 1),
results AS (SELECT o_orderkey AS task, 'a' || (o_orderkey % 3) AS attempt, CASE WHEN o_orderstatus = 'F' THEN 'solved' WHEN o_orderkey % 2 = 0 THEN 'failed' ELSE 'abandoned' END AS outcome FROM orders WHERE o_orderstatus <> 'O'),
tried AS (
  SELECT task, attempt, count(cost) = count(*) FILTER (n IS NOT NULL) AS resolved, sum(cost) AS cost, count(n) AS steps, count(source) AS resolved_steps, count(*) FILTER (source = 'observed') AS observed_steps, count(*) FILTER (source = 'customer') AS customer_steps, count(*) FILTER (source = 'reference') AS reference_steps,
    CAST(sum(input + output) FILTER (call) AS BIGINT) AS tokens, CAST(sum(input - cached) FILTER (call) AS BIGINT) AS fresh, CAST(sum(output) FILTER (call) AS BIGINT) AS output, count(*) FILTER (call) AS calls, sum(cost) FILTER (NOT call) AS tool_cost, sum(ms) AS ms, max(outcome) AS outcome
  FROM (SELECT task, attempt, n, call, source, cost, input, cached, output, ms, NULL AS outcome FROM paid UNION ALL SELECT task, attempt, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, outcome FROM results) GROUP BY 1, 2),
summed AS (
  SELECT task, count(*) AS attempts, count(*) FILTER (outcome = 'solved') AS solved_attempts, bool_and(resolved) AS resolved, coalesce(sum(cost), 0) AS cost, CAST(sum(steps) AS BIGINT) AS steps, CAST(sum(resolved_steps) AS BIGINT) AS resolved_steps, CAST(sum(observed_steps) AS BIGINT) AS observed_steps,
    CAST(sum(customer_steps) AS BIGINT) AS customer_steps, CAST(sum(reference_steps) AS BIGINT) AS reference_steps, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(fresh), 0) AS BIGINT) AS fresh_tokens, CAST(coalesce(sum(output), 0) AS BIGINT) AS output_tokens, CAST(sum(calls) AS BIGINT) AS model_calls,
    sum(tool_cost) AS tool_cost, sum(ms) AS ms, max(outcome) AS outcome FROM tried GROUP BY 1),
tasks AS (
  SELECT CAST(task AS VARCHAR) AS task_id, o_orderpriority AS task_type, 'strategy-' || (o_custkey % 3) AS execution_strategy, 'v' || (o_custkey % 2) AS strategy_version, CASE WHEN o_custkey % 4 = 0 THEN 'team ' || (o_custkey % 3) END AS workload, s.outcome,
    attempts, solved_attempts, greatest(0, attempts - 1) AS retries, resolved, CASE WHEN resolved THEN cost END AS cost_usd, steps, resolved_steps, observed_steps, customer_steps, reference_steps, tokens, fresh_tokens, output_tokens, model_calls, tool_cost,
    coalesce(ms, CASE WHEN s.outcome IS NOT NULL THEN 5.0 END) AS duration_ms, CASE WHEN s.outcome IS NOT NULL AND task % 4 = 0 THEN 1 ELSE 0 END AS reviews,
    CASE WHEN s.outcome IS NOT NULL AND task % 8 = 0 AND task % 12 <> 0 THEN 1 ELSE 0 END AS passes, CASE WHEN s.outcome IS NOT NULL AND task % 4 = 0 AND task % 20 <> 0 THEN 1 ELSE 0 END AS policy,
    CASE WHEN s.outcome IS NOT NULL AND task % 4 = 0 AND task % 20 <> 0 AND task % 28 <> 0 THEN 1 ELSE 0 END AS compliant, s.outcome IS NOT NULL AND task % 12 = 0 AS escaped,
    CASE WHEN s.outcome IS NOT NULL AND task % 12 = 0 THEN o_totalprice / 10000 END AS cleanup_cost, s.outcome IS NOT NULL AND task % 12 = 0 AS cleanup_known
  FROM summed s JOIN orders ON task = o_orderkey)"""

_CLOSED = "outcome IS NOT NULL"


def _whole(group: str) -> str:
    return f"CASE WHEN count(*) FILTER ({group} AND resolved) > 0 AND count(*) FILTER ({group} AND resolved) = count(*) FILTER ({group}) THEN round(avg(cost_usd) FILTER ({group}), 6) END"


COHORTS_SQL = f"""
SELECT task_type, CASE WHEN sum(reviews) = 0 THEN 2 ELSE 3 END AS maturity_level, count(*) AS attempted_tasks, count(*) FILTER (outcome IS NULL) AS open_tasks, count(outcome) AS closed_tasks,
  count(*) FILTER (outcome = 'solved') AS solved_tasks, count(*) FILTER (outcome = 'failed') AS failed_tasks, count(*) FILTER (outcome = 'abandoned') AS abandoned_tasks, round(count(*) FILTER (outcome = 'solved') / count(outcome) * 100, 1) AS success_rate,
  count(*) FILTER (resolved) AS resolved_tasks, count(*) FILTER (NOT resolved) AS unresolved_tasks, round(avg(cost_usd), 6) AS cost_per_observed_task_usd, {_whole(_CLOSED)} AS cost_per_closed_task_usd, {_whole("outcome = 'solved'")} AS cost_per_solved_task_usd,
  round(quantile_cont(CAST(tokens AS DOUBLE), 0.5), 12) AS tokens_p50, round(quantile_cont(CAST(tokens AS DOUBLE), 0.9), 12) AS tokens_p90, round(quantile_cont(cost_usd, 0.5), 12) AS cost_p50, round(quantile_cont(cost_usd, 0.9), 12) AS cost_p90,
  round(quantile_cont(cost_usd, 0.5) FILTER (outcome = 'solved'), 12) AS solved_cost_p50, round(quantile_cont(duration_ms, 0.9), 12) AS latency_p90, round(sum(model_calls) / count(*), 3) AS model_calls_per_task, round(sum(attempts) / count(*), 3) AS attempts_per_task,
  CAST(sum(retries) AS BIGINT) AS retries, CASE WHEN count(*) FILTER (outcome IN ('failed', 'abandoned')) = count(cost_usd) FILTER (outcome IN ('failed', 'abandoned')) AND count(*) FILTER (outcome IN ('failed', 'abandoned')) > 0 THEN round(sum(cost_usd) FILTER (outcome IN ('failed', 'abandoned')), 6) END AS failed_spend_usd,
  CAST(sum(passes) AS BIGINT) AS reviewed_passes, count(*) FILTER (escaped) AS escaped_errors, round(count(*) FILTER (escaped) / sum(reviews) * 100, 1) AS leak_rate, round(sum(compliant) / sum(policy) * 100, 1) AS policy_compliance_rate,
  round(sum(cleanup_cost), 6) AS cleanup_spend_usd, round(sum(cleanup_cost) / count(*) FILTER (outcome = 'solved'), 6) AS cleanup_per_solved_usd, round(avg(cost_usd + cleanup_cost) FILTER (escaped), 6) AS cost_per_corrected_usd,
  CAST(sum(resolved_steps) AS BIGINT) AS resolved_events, CAST(sum(steps - resolved_steps) AS BIGINT) AS unresolved_events, CAST(sum(observed_steps) AS BIGINT) AS observed_events, CAST(sum(customer_steps) AS BIGINT) AS customer_events, CAST(sum(reference_steps) AS BIGINT) AS reference_events,
  round(sum(resolved_steps) / sum(steps) * 100, 1) AS coverage_percent, CAST(sum(fresh_tokens) AS BIGINT) AS fresh_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(tool_cost), 6) AS tool_cost_usd
FROM tasks GROUP BY 1"""

STRATEGIES_SQL = f"""
compared AS (
  SELECT task_type, execution_strategy, strategy_version, count(outcome) AS closed_tasks, count(*) FILTER (outcome = 'solved') AS solved_tasks, round(count(*) FILTER (outcome = 'solved') / greatest(1, count(outcome)) * 100, 1) AS success_rate,
    round(sum(solved_attempts) / greatest(1, sum(attempts)) * 100, 1) AS attempt_success_rate, {_whole(_CLOSED)} AS cost_per_task_usd, {_whole("outcome = 'solved'")} AS cost_per_solved_task_usd, round(quantile_cont(cost_usd, 0.5), 12) AS p50_cost_usd, round(quantile_cont(cost_usd, 0.9), 12) AS p90_cost_usd
  FROM tasks GROUP BY 1, 2, 3 HAVING count(outcome) >= 30)"""

#: Attributed traces: workload id and name.
ATTRIBUTED_SQL = (
    PRICED_SQL
    + r""",
attributed AS (
  SELECT *, CASE WHEN workload IS NOT NULL THEN CASE WHEN lower(workload) = 'work load 2' THEN 'wl-load-2' ELSE regexp_replace(lower(workload), '[^a-z0-9]+', '-', 'g') END WHEN deployment_name = 'dep-1' THEN 'wl-late' END AS workload_id
  FROM costed WHERE reading = 'a')"""
)


def workloads_sql(keys: str, select: str) -> str:
    """A rollup of attributed traces by ``keys`` (aliases), given as select expressions."""
    return f""",
daily AS (
  SELECT {select}, CAST(ts AS DATE) AS day, count(*) AS requests, sum(input_tokens) AS input_tokens, sum(cached_tokens) AS cached_tokens, sum(output_tokens) AS output_tokens, count(input_tokens) AS i, count(cached_tokens) AS c, count(output_tokens) AS o,
    sum(cost_usd) FILTER (source <> 'unresolved') AS cost, count(*) FILTER (source <> 'unresolved') AS priced, coalesce(sum(tokens) FILTER (source <> 'unresolved'), 0) AS priced_tokens, coalesce(sum(tokens) FILTER (source = 'unresolved'), 0) AS unpriced_tokens,
    coalesce(sum(tokens) FILTER (model_name = 'unknown'), 0) AS lost, coalesce(sum(tokens) FILTER (workload_id IS NOT NULL), 0) AS tagged FROM attributed GROUP BY ALL),
folded AS (
  SELECT {keys}, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
    CASE WHEN sum(i) = 0 THEN 'unavailable' WHEN sum(i) < sum(requests) THEN 'partial' ELSE 'measured' END AS input_tokens_state, CASE WHEN sum(c) = 0 THEN 'unavailable' WHEN sum(c) < sum(requests) THEN 'partial' ELSE 'measured' END AS cached_tokens_state,
    CASE WHEN sum(o) = 0 THEN 'unavailable' WHEN sum(o) < sum(requests) THEN 'partial' ELSE 'measured' END AS output_tokens_state, sum(cost) AS cost, sum(priced) AS priced, CAST(sum(priced_tokens) AS BIGINT) AS priced_tokens, CAST(sum(unpriced_tokens) AS BIGINT) AS unpriced_tokens,
    CAST(sum(lost) AS BIGINT) AS identity_unresolved_tokens, CAST(sum(tagged) AS BIGINT) AS tagged, count(CASE WHEN priced > 0 THEN 1 END) AS active_days, round(avg(round(cost, 6)), 6) AS average_daily_cost, round(quantile_cont(round(cost, 6), 0.5), 6) AS p50_daily_cost, round(quantile_cont(round(cost, 6), 0.9), 6) AS p90_daily_cost
  FROM daily GROUP BY {keys}),
workload_rollup AS (
  SELECT {keys}, requests, input_tokens, cached_tokens, output_tokens, CAST(coalesce(input_tokens, 0) + coalesce(output_tokens, 0) AS BIGINT) AS total_tokens, input_tokens_state, cached_tokens_state, output_tokens_state,
    CASE WHEN input_tokens_state = output_tokens_state AND input_tokens_state <> 'partial' THEN input_tokens_state ELSE 'partial' END AS total_tokens_state, CASE WHEN priced > 0 THEN round(cost, 6) END AS estimated_cost, priced_tokens, unpriced_tokens,
    round(priced_tokens / (coalesce(input_tokens, 0) + coalesce(output_tokens, 0)) * 100, 1) AS pricing_coverage_percent,
    CASE WHEN unpriced_tokens = 0 AND priced_tokens > 0 AND input_tokens_state = 'measured' AND output_tokens_state = 'measured' AND cached_tokens_state = 'measured' THEN round(cost / requests, 6) END AS cost_per_request, active_days, average_daily_cost, p50_daily_cost, p90_daily_cost,
    round(tagged / (coalesce(input_tokens, 0) + coalesce(output_tokens, 0)) * 100, 1) AS business_identity_coverage_percent, identity_unresolved_tokens FROM folded)"""


#: Gap-filled five-minute series of each deployment.
SERIES_SQL = (
    REQUEST_TRACES_SQL
    + """,
slots AS (SELECT deployment_name, CAST(floor(epoch(ts) / 300) AS BIGINT) AS slot, CAST(sum(coalesce(input_tokens, 0)) AS DOUBLE) AS input, CAST(sum(coalesce(output_tokens, 0)) AS DOUBLE) AS output, count(*) AS requests FROM traces GROUP BY 1, 2),
span AS (SELECT deployment_name, unnest(range(min(slot), max(slot) + 1)) AS slot FROM slots GROUP BY 1),
series AS (
  SELECT deployment_name, slot, coalesce(input, 0) / 5 AS input_tpm, coalesce(output, 0) / 5 AS output_tpm, (coalesce(input, 0) + coalesce(output, 0)) / 5 AS tpm, requests IS NOT NULL AS observed, requests IS NOT NULL AS active
  FROM span LEFT JOIN slots USING (deployment_name, slot)),
lagged AS (SELECT *, lag(tpm, 288) OVER w AS d, lag(tpm, 2016) OVER w AS k, max(tpm) OVER (PARTITION BY deployment_name) AS peak FROM series WINDOW w AS (PARTITION BY deployment_name ORDER BY slot)),
shape AS (
  SELECT deployment_name, count(*) AS elapsed, count(*) FILTER (observed) AS observed, count(*) FILTER (active) AS active, round(avg(tpm), 6) AS average_tpm, round(quantile_cont(tpm, 0.95), 6) AS p95_tpm, round(stddev_pop(tpm) / avg(tpm), 6) AS cv,
    round(avg(CASE WHEN tpm >= peak * 0.3e0 THEN 1.0 ELSE 0.0 END), 6) AS sustained, CASE WHEN count(*) >= 576 THEN round(greatest(0, corr(tpm, d)), 6) END AS daily_similarity, CASE WHEN count(*) >= 4032 THEN round(greatest(0, corr(tpm, k)), 6) END AS weekly_similarity
  FROM lagged GROUP BY 1)"""
)
