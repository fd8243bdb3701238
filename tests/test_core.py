"""Operators on small literal inputs, with the answers that the semantics demand."""

import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from meterlark.functions import measures, text, tokens
from meterlark.operators import buckets, capacity, dedupe, pricing, rollups, rules, samples, tasks, workloads
from meterlark.plans import analysis
from meterlark.sinks import records as record_sink
from meterlark.sinks import reports
from meterlark.sources import prices, records
from meterlark.streaming import twins

TRACE = "ingest_seq long, ts timestamp, request_id string, event_id string, deployment_name string, model_name string, provider string, service_tier string, deployment_mode string, tenant string, workload string, input_tokens long, cached_tokens long, output_tokens long, observed_cost_usd double, latency_ms double, status_code int, retry_of string, record_type string"
T0 = datetime(2026, 9, 1, tzinfo=UTC)


def traces(spark, *rows):
    base = {"ts": T0, "deployment_name": "d", "model_name": "phi-4", "provider": "azure_foundry", "service_tier": "standard", "deployment_mode": "global", "input_tokens": 1000, "cached_tokens": 0, "output_tokens": 100}
    names = [f.split()[0] for f in TRACE.split(", ")]
    full = [{**base, "ingest_seq": i, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], TRACE)


def catalog(spark, *entries, **facts):
    base = {"effective_from": "2026-01-01", "input_rate": 2.0, "output_rate": 8.0}
    return pricing.Catalog(facts.pop("name", "own"), facts.pop("kind", "customer"), pricing.price_rows(spark, [{**base, **e} for e in entries]), **facts)


def cost_of(df):
    return [r["cost"] for r in df.orderBy("ingest_seq").select("cost").collect()]


# Names


def test_names(spark):
    df = spark.createDataFrame([("  MAI Thinking__1 ", 1), ("Meta_Llama 3", 2), ("unknown", 3), (None, 4)], "m string, i int")
    got = df.orderBy("i").select(text.canonical_model(F.col("m")).alias("c"), text.publisher_of(F.col("m")).alias("p"), text.known_model(F.col("m")).alias("k"), text.workload_slug(F.col("m")).alias("w")).collect()
    assert [tuple(r) for r in got] == [("mai-thinking-1", "microsoft", True, "mai-thinking-1"), ("meta-llama-3", "meta", True, "meta-llama-3"), ("unknown", None, False, "unknown"), (None, None, False, "unknown")]


def test_states(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", None), ("b", 2), ("c", None)], "k string, x int")
    got = {r["k"]: (r["s"], r["x"]) for r in df.groupBy("k").agg(measures.state_of(F.col("x")).alias("s"), F.sum("x").alias("x")).collect()}
    assert got == {"a": ("measured", 1), "b": ("partial", 2), "c": ("unavailable", None)}


def test_message_tokens(spark):
    df = spark.sql("select array(named_struct('role', 'user', 'content', 'é', 'name', cast(null as string)), named_struct('role', 'a', 'content', 'bc', 'name', 'n')) as m, cast(array() as array<struct<role:string,content:string,name:string>>) as e")
    assert df.select(tokens.count_messages(F.col("m")), tokens.count_messages(F.col("e"))).first() == Row(4 + 4 + 2 + 4 + 1 + 2 + 1 + 2, 0)


# Pricing


def test_literal_name_beats_alias_and_rank_beats_date(spark):
    own = catalog(spark, {"model": "other", "aliases": ["phi-4"], "input_rate": 1.0, "source_rank": 1}, {"model": "phi-4", "input_rate": 5.0}, {"model": "phi-4", "input_rate": 3.0, "source_rank": 10}, {"model": "phi-4", "input_rate": 9.0, "effective_from": "2026-08-01"})
    assert cost_of(pricing.price_traces(traces(spark, {}), [own]))[0]["input_rate"] == 3.0


def test_context_bands_dates_and_regions(spark):
    own = catalog(spark, {"model": "phi-4", "context_max": 127_999}, {"model": "phi-4", "context_min": 128_000, "input_rate": 4.0}, {"model": "old", "effective_to": "2026-08-31"}, {"model": "here", "region": "regional"})
    rows = traces(spark, {}, {"input_tokens": 128_000}, {"model_name": "old"}, {"model_name": "old", "ts": T0 - timedelta(days=1)}, {"model_name": "here"}, {"model_name": "here", "deployment_mode": "Regional"})
    assert [c["input_rate"] for c in cost_of(pricing.price_traces(rows, [own]))] == [2.0, 4.0, None, 2.0, None, 2.0]


def test_reasons(spark):
    own = catalog(spark, {"model": "phi-4"})
    rows = traces(spark, {"cached_tokens": 10}, {"output_tokens": None, "cached_tokens": None}, {"model_name": "Nobody Knows"}, {"observed_cost_usd": 0.5, "input_tokens": None})
    got = cost_of(pricing.price_traces(rows, [own, pricing.reference_catalog(spark)]))
    assert [(c["source"], c["reason"], c["override_key"]) for c in got] == [("unresolved", "cached-input-rate-unavailable", None), ("unresolved", "usage-metrics-unavailable:cached_tokens,output_tokens", "phi-4"), ("unresolved", "no-exact-model-mode-price", "nobody-knows"), ("observed", None, None)]


def test_foreign_currency_gives_the_reason_alone(spark):
    euros = catalog(spark, {"model": "phi-4"}, currency="EUR")
    got = cost_of(pricing.price_traces(traces(spark, {}, {"model_name": "x"}), [euros]))
    assert [c["reason"] for c in got] == ["currency-conversion-required", "no-exact-model-mode-price"]
    assert cost_of(pricing.price_traces(traces(spark, {"observed_cost_usd": 1.0}), [euros], "EUR"))[0]["reason"] == "currency-conversion-required"


def test_snapshot_catalog_prices_at_its_own_date(spark):
    got = cost_of(pricing.price_traces(traces(spark, {"ts": datetime(2020, 1, 1, tzinfo=UTC)}), [pricing.reference_catalog(spark)]))
    assert got[0]["source"] == "reference" and got[0]["cost_usd"] == pytest.approx((1000 * 0.125 + 100 * 0.5) / 1e6)


def test_bucket_context_is_assumed(spark):
    own = catalog(spark, {"model": "phi-4", "context_max": 1000, "context_window": "short"})
    rows = traces(spark, {"input_tokens": 50_000})
    assert cost_of(pricing.price_traces(rows, [own]))[0]["reason"] == "no-exact-model-mode-price"
    assert cost_of(pricing.price_traces(rows, [own], buckets=True))[0]["assumed"] == ["context=short"]


def test_fresh_input_is_not_clamped(spark):
    own = catalog(spark, {"model": "phi-4", "cached_rate": 1.0})
    assert cost_of(pricing.price_traces(traces(spark, {"input_tokens": 10, "cached_tokens": 30}), [own]))[0]["fresh_cost"] < 0


# Rollups


def test_small_slices_take_missing_cache_as_zero(spark):
    own = catalog(spark, {"model": "phi-4"})
    rows = traces(spark, {"deployment_name": "small", "input_tokens": 500, "cached_tokens": None}, {"deployment_name": "small", "input_tokens": 523}, {"deployment_name": "large", "input_tokens": 1024, "cached_tokens": None})
    got = {r["deployment_name"]: r for r in rollups.deployment_rollup(pricing.price_traces(rows, [own])).collect()}
    assert got["small"]["pricing_status"] == "priced" and got["small"]["cached_tokens_state"] == "partial"
    assert got["large"]["pricing_status"] == "usage_incomplete" and got["large"]["estimated_cost_usd"] is None


def test_rollup_keeps_unpriced_apart(spark):
    rows = traces(spark, {}, {"model_name": "phi-4", "input_tokens": None}, {"deployment_name": "e", "model_name": "unknown"})
    got = {r["deployment_name"]: r for r in rollups.deployment_rollup(pricing.price_traces(rows, [catalog(spark, {"model": "phi-4"})])).collect()}
    assert (got["d"]["pricing_status"], got["d"]["unresolved_requests"], got["d"]["unresolved_tokens"], got["d"]["total_tokens_state"]) == ("partial", 1, 100, "partial")
    assert got["e"]["pricing_status"] == "identity_unresolved"


def test_empty_rollup(spark):
    priced = pricing.price_traces(traces(spark).limit(0), [pricing.reference_catalog(spark)])
    assert rollups.deployment_rollup(priced).count() == 0 and rollups.slice_summary(priced, []).first()["requests"] == 0


def test_mixed_telemetry_is_refused(spark):
    rows = traces(spark, {}, {"record_type": "foundry_metric_bucket"})
    with pytest.raises(analysis.MixedTelemetryError):
        analysis.analyze(rows, [pricing.reference_catalog(spark)])
    assert "portfolio" in analysis.analyze(rows, [pricing.reference_catalog(spark)], allow_mixed=True)


# Buckets

BUCKET = "deployment_name string, bucket long, input_tokens long, cached_tokens long, output_tokens long, requests long, successful_requests long, throttled_requests long, failed_requests long, average_latency_ms double, outcome_coverage string"


def test_idle_buckets_are_not_requests(spark):
    rows = [("d", 0, 18, None, 9, 2, 1, 0, 1, None, "complete"), ("d", 300, 12, None, 6, 2, 1, 0, 1, None, "complete")] + [("d", 300 * i, 0, None, 0, 0, 0, 0, 0, None, "complete") for i in range(2, 39)]
    got = buckets.bucket_summary(spark.createDataFrame(rows, BUCKET), expected=4032).first()
    assert (got["metric_buckets_read"], got["elapsed_buckets"], got["observed_buckets"], got["active_buckets"], got["idle_buckets"], got["requests_observed"], got["total_tokens"]) == (39, 4032, 39, 2, 37, 4, 45)
    assert (got["cached_tokens"], got["cached_tokens_state"], got["outcome_coverage"]) == (0, "measured", "complete")
    ids = [r["insight_id"] for r in buckets.insights(buckets.bucket_summary(spark.createDataFrame(rows, BUCKET), expected=4032)).orderBy("priority", "insight_id").collect()]
    assert ids == ["AGG-COVERAGE", "AGG-FAILURE-RATE", "DQ-LATENCY-GAP", "AGG-TOKENS-PER-REQUEST"]


def test_gaps_and_days(spark):
    df = spark.createDataFrame([("d", 300 * i) for i in (0, 1, 4, 5, 9)] + [("d", 86400 * 3)], "deployment_name string, bucket long")
    assert [(r["gap_start"], r["missing_buckets"]) for r in buckets.bucket_gaps(df, ["deployment_name"]).orderBy("gap_start").collect()] == [(600, 2), (1800, 3), (3000, 854)]
    assert buckets.day_coverage(df, ["deployment_name"]).first()[1:] == (4, 0, 2, 2)


def test_chunks_keep_the_first(spark):
    a = spark.createDataFrame([(0, "d", 1), (300, "d", 2)], "bucket long, deployment_name string, x int")
    b = spark.createDataFrame([(300, "d", 9), (600, "d", 3)], "bucket long, deployment_name string, x int")
    assert sorted(tuple(r) for r in buckets.merge_chunks([a, b]).collect()) == [(0, "d", 1), (300, "d", 2), (600, "d", 3)]


def test_pivot(spark):
    series = [("ProcessedPromptTokens", {"modelDeploymentName": "d", "ContextLength": "short"}, 0, 10.0, None), ("ProcessedPromptTokens", {"DEPLOYMENTNAME": "d", "ContextLength": "long"}, 0, 5.0, None), ("ProcessedPromptTokens", {"DEPLOYMENTNAME": "d", "ContextLength": "long"}, 0, 5.0, None), ("Latency", {"deploymentname": "d", "StatusCode": "200"}, 0, None, 7.0), ("Latency", {"deploymentname": "d", "StatusCode": "500"}, 0, None, 9.0), ("ModelRequests", {"deploymentname": "d", "StatusCode": "429"}, 0, 3.0, None), ("ModelRequests", {"deploymentname": "d", "StatusCode": "204"}, 0, 4.0, None), ("ProcessedPromptTokens", {"deploymentname": "d"}, 300, None, None)]
    df = spark.createDataFrame(series, "metric_name string, dimensions map<string,string>, ts long, total double, average double")
    got = buckets.pivot_points(records.metric_points(df)).collect()
    assert len(got) == 1
    assert (got[0]["input_tokens"], got[0]["requests"], got[0]["average_latency_ms"], got[0]["throttled_requests"], got[0]["successful_requests"], got[0]["cached_tokens"]) == (15, 7, 7.0, 3, 4, None)


# Rules


def requests(spark, *rows):
    call = lambda role, content, calls=(): (role, content, None, list(calls))
    base = {"model": "gpt-4.1", "model_name": "gpt-4.1", "messages": [call("user", "hello there")], "tools": [], "retrieved_chunks": [], "retry_count": 0}
    schema = "ingest_seq long, deployment_name string, model string, model_name string, messages array<struct<role:string,content:string,name:string,tool_calls:array<string>>>, tools array<string>, tools_json string, retrieved_chunks array<string>, input_tokens long, output_tokens long, max_output_tokens long, retry_of string, retry_count int, task_type string, tenant string, workload string, record_type string, fingerprint string, prefix_tokens long"
    names = [f.split()[0] for f in schema.replace("struct<role:string,content:string,name:string,tool_calls:array<string>>", "x").split(", ")]
    return spark.createDataFrame([tuple({**base, "ingest_seq": i, **r}.get(n) for n in names) for i, r in enumerate(rows)], schema)


def m(role, content, calls=()):
    return (role, content, None, list(calls))


def only(df):
    rows = df.collect()
    assert len(rows) <= 1
    return rows[0].asDict() if rows else None


def test_prefix_needs_repetition(spark):
    long = "s" * 120
    assert only(rules.repeated_prefix(requests(spark, {"messages": [m("system", long), m("user", "a")]}))) is None
    got = only(rules.repeated_prefix(requests(spark, *[{"messages": [m("system", long)]}] * 2, *[{"messages": [m("system", "t" * 200)]}] * 2)))
    assert (got["affected"], got["measured"], got["min_savings"], got["max_savings"]) == (2, 120, 86, 120)


def test_fingerprints_count_only_without_prompts(spark):
    marked = [{"messages": [], "fingerprint": "hmac-sha256:a", "prefix_tokens": 200}] * 3
    assert only(rules.fingerprint_prefix(requests(spark, *marked)))["measured"] == 400
    assert only(rules.fingerprint_prefix(requests(spark, *marked, {"messages": [m("system", "x")]}))) is None


def test_unused_tools(spark):
    rows = requests(spark, {"tools": ["a", "b", "c"], "tools_json": "x" * 300, "messages": [m("assistant", "", ["a"])]})
    got = only(rules.unused_tools(rows))
    assert (got["affected"], got["measured"], got["max_savings"], got["min_savings"]) == (2, 300, 200, 120)


def test_conversation_queries_read_whole_texts(spark, tmp_path):
    from meterlark import catalog

    long = "s" * 120
    system = {3: long, 9: long, 6: "sss other", 12: "s" * 119 + "t"}
    asked = {3: "How much is it?", 9: "how  much is it? ", 6: "How many are there?", 12: "How long does it take?", 1: "same words", 4: "same other words", 7: "same words"}
    rows = [(i, 0, "system", t) for i, t in system.items()] + [(i, 1, "user", t) for i, t in asked.items()]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(99, "other")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = lambda name: {r["deployment_name"]: (r["affected"], r["measured"]) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
    # conversation 3 is sent twice
    assert run("tl001_repeated_prefix") == {"dep-0": (3, 240)}
    assert run("tl007_repeated_intents") == {"dep-0": (1, 2), "dep-1": (1, 1)}
    assert run("tl005_retry_amplification") == {"dep-0": (2, 2 * (2 + 4 + len("system") + 120 + 4 + len("user") + len(asked[3]))), "dep-1": (2, 2 * (2 + 4 + len("user") + len("same words")))}
    top = {r["rule_id"]: (r["affected"], r["measured"]) for r in catalog.QUERIES["material_findings_topk"](spark, str(tmp_path)).collect()}
    assert top["TL001"] == (3, 240)


def test_instructions_of_every_other_team(spark, tmp_path):
    from meterlark.sources import views

    spark.createDataFrame([(i, 0, "user", f"u{i}") for i in range(12)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(i, f"item {i}") for i in range(5)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = views.conversation_traces(spark, str(tmp_path)).orderBy("ingest_seq").collect()
    assert [r["ingest_seq"] for r in rows] == [0, 2, 4, 6, 7, 8, 10, 12, 14, 16, 18, 20, 22]
    told = {r["ingest_seq"] // 2: r["messages"][0]["content"] for r in rows if r["messages"][0]["role"] == "system"}
    assert told == {i: f"item {i % 5}" for i in (0, 1, 2, 3, 8, 9, 10, 11)}
    assert {r["fingerprint"] for r in rows if r["team"] == "team-1"} == {"hmac-sha256:1"}


def chunks_of(traces):
    return rules.redundant_chunk_rows(traces.select("ingest_seq", F.posexplode_outer("retrieved_chunks").alias("place", "chunk")))


def test_chunks(spark):
    same, other = "alpha beta gamma delta " * 5, "one two three four five"
    got = only(chunks_of(requests(spark, {"retrieved_chunks": [same, same, same, other]}, {"retrieved_chunks": [other]})))
    assert (got["affected"], got["measured"]) == (2, 3 * len(same))
    assert only(chunks_of(requests(spark, {"retrieved_chunks": [same, same]}))) is None


def test_chunks_are_parsed_once(spark, monkeypatch):
    """Frequencies come from hashes that are written, and words that one set of a request has alone don't reach the join of sets."""
    plans, tables, classes, kept = [], {}, rules.frequency_classes, rules.written
    monkeypatch.setattr(rules, "frequency_classes", lambda rows: plans.append(rows._jdf.queryExecution().toString()) or classes(rows))
    monkeypatch.setattr(rules, "written", lambda df, name: tables.setdefault(name, kept(df, name)))
    near, far = "alpha beta gamma delta epsilon zeta eta theta iota kappa", "one two three four five six seven"
    got = only(chunks_of(requests(spark, {"retrieved_chunks": [near, near + " lambda", far, near]}, {"retrieved_chunks": [near, far, None, ""]})))
    assert (got["affected"], got["measured"]) == (2, len(near + " lambda") + 2 * len(near))
    assert len(plans) == 1 and "regexp" not in plans[0]
    assert {r["n"] for r in tables["chunk-starts"].groupBy("k", "word").agg(F.count("*").alias("n")).collect()} == {2}


def test_chunks_are_all_lines_of_documents(spark, tmp_path):
    import random
    import re

    from meterlark import catalog

    rng = random.Random(3)
    base = [" ".join(f"word{rng.randrange(60)}" for _ in range(rng.choice([1, 4, 12, 20]))) for _ in range(12)]
    line = lambda: rng.choice(base) + rng.choice(["", "", " extra", " ab", " more words"])
    docs = [(i, "\n".join(line() for _ in range(rng.randrange(1, 25)))) for i in range(40)] + [(40, None), (41, ""), (42, "a\n\nb")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    total, requests_, words = {}, {}, lambda c: set(re.findall("[a-z0-9]{3,}", c.lower()))
    for request in range(9):
        chunks = [c for i, t in docs if i // 5 == request and t is not None for c in t.split("\n")]
        name = f"dep-{request % 4}"
        requests_[name] = requests_.get(name, 0) + 1
        for j, y in enumerate(chunks):
            total[name] = total.get(name, 0) + len(y) * sum(len(words(x) & words(y)) / max(1, len(words(x) | words(y))) >= 0.85 for x in chunks[:j])
    got = {r["deployment_name"]: (r["affected"], r["measured"]) for r in catalog.QUERIES["tl004_chunk_redundancy"](spark, str(tmp_path)).collect()}
    assert got == {d: (requests_[d], t) for d, t in total.items() if t >= 100} and len(got) == 4


def test_retries_are_explicit_first(spark):
    rows = [{"input_tokens": 10}, {"input_tokens": 20}, {"messages": [], "input_tokens": 5}, {"messages": [], "input_tokens": 5}]
    assert only(rules.retry_amplification(requests(spark, *rows)))["measured"] == 30
    got = only(rules.retry_amplification(requests(spark, *rows, {"retry_of": "r", "input_tokens": 7, "messages": [m("user", "z")]})))
    assert (got["affected"], got["measured"]) == (1, 7)


def test_output_budget_uses_nearest_rank(spark):
    rows = [{"max_output_tokens": i, "output_tokens": 1} for i in range(1, 251)]
    assert only(rules.output_budget(requests(spark, *rows)))["measured"] == 247
    assert only(rules.output_budget(requests(spark, {"max_output_tokens": 9, "output_tokens": 1}))) is None


def test_intents_stay_within_tenant(spark):
    a, b = {"messages": [m("user", " What  is\nIT ")], "tenant": "a"}, {"messages": [m("user", "what is it")], "tenant": "a"}
    got = only(rules.repeated_intents(requests(spark, a, b, {**b, "tenant": "b"})))
    assert (got["affected"], got["measured"]) == (1, 1)


def test_not_evaluated_is_not_no_issue(spark):
    got = {r["rule_id"]: (r["status"], r["missing"]) for r in rules.evaluate(requests(spark, {}, {})).collect()}
    assert got["TL003"] == ("not_evaluated", "tools") and got["TL002"] == ("no_issue", "") and got["TL007"] == ("finding", "") and got["TL006"][0] == "not_evaluated"
    aggregated = {r["rule_id"]: r["runs"] for r in rules.applicability(rules.evidence(requests(spark, {"record_type": "foundry_metric_bucket", "retry_count": 1}))).collect()}
    assert [k for k, v in aggregated.items() if v] == ["TL005"]


# Records and events


def test_dedupe_keeps_rows_without_id(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), (None, 2), (None, 3), ("", 4)], "event_id string, ingest_seq int")
    assert sorted(r["ingest_seq"] for r in dedupe.dedupe_records(df).collect()) == [0, 2, 3, 4]


def test_stream_keys(spark):
    rows = traces(spark, {"request_id": "r"}, {"request_id": "r", "event_id": "e"}, {"event_id": "e"}, {}, {}, {"model_name": "x"})
    assert sorted(r["ingest_seq"] for r in dedupe.stream_dedupe(rows).collect()) == [0, 2, 3, 5]
    assert dedupe.stream_dedupe(rows, 2).count() == 2


EVENT = "event_id string, event_type string, ts timestamp, seq long, task_id string, task_type string, execution_strategy string, strategy_version string, workload string, attempt_id string, step_index long, provider string, model_name string, service_tier string, deployment_mode string, input_tokens long, cached_tokens long, output_tokens long, observed_cost_usd double, context_length long, duration_ms double, outcome string, review_outcome string, escaped_error boolean, policy_compliant boolean, cleanup_cost_usd double, payload string"


def events(spark, *rows):
    base = {"task_type": "t", "execution_strategy": "s", "strategy_version": "v", "provider": "azure_foundry", "service_tier": "standard", "deployment_mode": "global"}
    names = [f.split()[0] for f in EVENT.split(", ")]
    return spark.createDataFrame([tuple({**base, "event_id": f"e{i}", "seq": i, "ts": T0 + timedelta(minutes=i), **r}.get(n) for n in names) for i, r in enumerate(rows)], EVENT)


CALL = {"event_type": "model_call", "attempt_id": "a1", "step_index": 0, "model_name": "phi-4", "input_tokens": 1000, "cached_tokens": 0, "output_tokens": 100, "observed_cost_usd": 0.01}


def test_failed_attempt_then_solved(spark):
    rows = events(spark, {**CALL, "task_id": "x"}, {"event_type": "task_result", "task_id": "x", "attempt_id": "a1", "outcome": "failed"}, {**CALL, "task_id": "x", "attempt_id": "a2", "observed_cost_usd": 0.02}, {"event_type": "task_result", "task_id": "x", "attempt_id": "a2", "outcome": "solved"}, {**CALL, "task_id": "open"}, {"event_type": "human_review", "task_id": "x", "review_outcome": "correct", "task_type": None, "cleanup_cost_usd": 1.0})
    got = tasks.cohorts(tasks.trajectories(tasks.price_events(rows, []))).first()
    assert (got["attempted_tasks"], got["open_tasks"], got["success_rate"], got["retries"], got["cost_per_solved_task_usd"], got["maturity_level"], got["reviewed_passes"]) == (2, 1, 100.0, 1, 0.03, 3, 1)


def test_unpriced_steps_withhold_costs(spark):
    rows = events(spark, {**CALL, "task_id": "x"}, {"event_type": "tool_step", "task_id": "x", "attempt_id": "a1", "step_index": 1}, {"event_type": "task_result", "task_id": "x", "attempt_id": "a1", "outcome": "solved"}, {"event_type": "task_result", "task_id": "y", "attempt_id": "a", "outcome": "solved"})
    found = {r["task_id"]: r for r in tasks.trajectories(tasks.price_events(rows, [])).collect()}
    assert found["x"]["cost_usd"] is None and found["y"]["resolved"] and found["y"]["cost_usd"] == 0
    got = tasks.cohorts(tasks.trajectories(tasks.price_events(rows, []))).first()
    assert got["cost_per_solved_task_usd"] is None and got["coverage_percent"] == 50.0


def test_violations(spark):
    rows = events(
        spark, {**CALL, "task_id": "x"}, {**CALL, "task_id": "x", "event_id": "twice", "payload": "1", "step_index": 5}, {**CALL, "task_id": "x", "event_id": "twice", "payload": "2", "step_index": 5}, {**CALL, "task_id": "x"}, {**CALL, "task_id": "y", "attempt_id": None}, {**CALL, "task_id": "y", "task_type": "other"},
        {"event_type": "task_result", "task_id": "y", "attempt_id": "a", "outcome": "solved"}, {"event_type": "task_result", "task_id": "y", "attempt_id": "b", "outcome": "failed"}, {"event_type": "human_review", "task_id": "ghost"},
    )
    got = {(r["rule"], r["subject"]) for r in dedupe.stream_violations(rows).collect()}
    assert got == {("conflicting-duplicate", "twice"), ("duplicate-step", "x"), ("missing-attempt", "e4"), ("conflicting-metadata", "y"), ("conflicting-outcome", "y"), ("review-of-unknown-task", "ghost")}


def test_violations_derive_events_once(spark):
    """The rules read what was written, not the events again."""
    rows = events(spark, {**CALL, "task_id": "x"}, {"event_type": "human_review", "task_id": "ghost"})
    plan = dedupe.stream_violations(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "LocalRelation" not in plan and "LogicalRDD" not in plan


def test_strategies_write_what_they_compare(spark, monkeypatch):
    wrote = {}

    def note(df, name, write=tasks.written):
        wrote[name] = df.columns
        return write(df, name)

    monkeypatch.setattr(tasks, "written", note)
    rows = events(spark, {**CALL, "task_id": "x"}, {"event_type": "task_result", "task_id": "x", "attempt_id": "a1", "outcome": "solved"})
    tasks.pareto(tasks.strategies(tasks.trajectories(tasks.price_events(rows, [])), provisional=1)).collect()
    assert sorted(wrote["tasks"]) == ["attempts", "cost_usd", "execution_strategy", "outcome", "resolved", "solved_attempts", "strategy_version", "task_type"]
    assert "strategies" in wrote


def test_pareto(spark):
    df = spark.createDataFrame([("t", "a", "1", 1.0, 90.0), ("t", "b", "1", 2.0, 80.0), ("t", "c", "1", 3.0, 95.0), ("t", "d", "1", None, 99.0), ("u", "a", "1", 9.0, 1.0)], "task_type string, execution_strategy string, strategy_version string, cost_per_solved_task_usd double, success_rate double")
    assert {(r[0], r[1]): r["pareto_frontier"] for r in tasks.pareto(df).collect()} == {("t", "a"): True, ("t", "b"): False, ("t", "c"): True, ("t", "d"): True, ("u", "a"): True}


# Workloads


def test_workloads_add_up(spark):
    rows = traces(spark, {"workload": "Team One"}, {"deployment_name": "mine"}, {"deployment_name": "other"}, {"workload": "late"})
    maps = spark.createDataFrame([("w-late", "Late", "shared", ["x"]), ("w1", "Mine", "dedicated", ["MINE"])], workloads.MAPPING).coalesce(1)
    done = workloads.attribute(pricing.price_traces(rows, [catalog(spark, {"model": "phi-4"})]), maps)
    got = {r["business_id"]: r for r in workloads.business_workloads(done).collect()}
    assert set(got) == {"team-one", "w1", "unassigned", "w-late"}
    assert sum(r["total_tokens"] for r in got.values()) == sum(r["total_tokens"] for r in workloads.technical_workloads(done).collect())
    assert got["w1"]["cost_per_request"] == pytest.approx(0.0028)


# Capacity


def test_series_and_shape(spark):
    rows = traces(spark, *[{"ts": T0 + timedelta(minutes=5 * i), "input_tokens": 500 if i % 2 else 0, "output_tokens": 0} for i in range(0, 600) if i % 7])
    points = capacity.series(capacity.usage_buckets(rows, ["deployment_name"]), ["deployment_name"])
    got = capacity.series_shape(points, ["deployment_name"]).first()
    assert (got["elapsed"], got["observed"]) == (599, 514) and got["weekly_similarity"] is None and 0 <= got["daily_similarity"] <= 1
    flat = capacity.series_shape(capacity.series(capacity.usage_buckets(traces(spark, *[{"ts": T0 + timedelta(minutes=5 * i)} for i in range(576)]), ["deployment_name"]), ["deployment_name"]), ["deployment_name"]).first()
    assert flat["daily_similarity"] == 0.5 and flat["cv"] == 0 and flat["sustained"] == 1


def test_downsample_keeps_ends(spark):
    df = spark.range(1000).select(F.lit("k").alias("k"), F.col("id").alias("x"), F.when(F.col("id") == 500, 99.0).otherwise(F.sin("id")).alias("y"))
    got = samples.downsample(df, ["k"], "x", "y", 50).orderBy("x").collect()
    assert len(got) == 50 and (got[0]["x"], got[-1]["x"]) == (0, 999) and any(r["x"] == 500 for r in got)


# Sources


def lines(spark, *values):
    return spark.createDataFrame([("f", v if isinstance(v, str) else json.dumps(v)) for v in values], "file string, value string")


def test_trace_envelopes(spark):
    flat = {"timestamp": "2026-01-01T00:00:00Z", "model": "d", "usage": {"prompt_tokens": 5, "completion_tokens": 0, "prompt_tokens_details": {"cached_tokens": 2}}, "messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]}, {"content": "no role"}], "metadata": {"tenant": "t", "retry_count": 2}, "deployment_name": ""}
    nested = {"request": {"model": "dep", "max_tokens": 9, "messages": [{"role": "assistant", "tool_calls": [{"function": {"name": "f"}}]}]}, "response": {"model": "gpt", "usage": {"input_tokens": 7, "output_tokens": 1}}, "endpoint": "e"}
    a, b = records.normalize_traces(records.parsed(lines(spark, flat, nested))).collect()
    assert (a["deployment_name"], a["model_name"], a["input_tokens"], a["output_tokens"], a["cached_tokens"], a["tenant"], a["retry_count"]) == ("d", "d", 5, 0, 2, "t", 2)
    assert [x["content"] for x in a["messages"]] == ["a b"]
    assert (b["deployment_name"], b["model_name"], b["model"], b["provider"], b["input_tokens"], b["max_output_tokens"], b["messages"][0]["tool_calls"]) == ("dep", "gpt", "gpt", "azure_foundry", 7, 9, ["f"])


def test_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"model": "x"}\n\n[1]\n')
    rows = records.read_lines(spark, str(tmp_path / "a.jsonl"))
    assert rows.count() == 2 and records.parsed(rows, reject=False).count() == 1
    with pytest.raises(Exception, match="isn't a JSON object"):
        records.parsed(rows).select("v").collect()


def test_migration_tells_zero_from_missing(spark):
    base = {"record_type": "model_request", "timestamp": "2026-01-01T00:00:00Z", "deployment_name": "d", "usage": {"input_tokens": 0, "output_tokens": 3}}
    old, new = records.canonical_requests(records.parsed(lines(spark, {**base, "schema_version": 3}, {**base, "schema_version": 4}))).collect()
    assert (old["input_tokens"], old["missing_metrics"], old["availability_migration_warning"]) == (None, ["input_tokens"], True)
    assert (new["input_tokens"], new["missing_metrics"], new["availability_migration_warning"]) == (0, [], False)


def test_spans(spark):
    attributes = [{"key": "gen_ai.response.model", "value": {"stringValue": "gpt"}}, {"key": "gen_ai.usage.input_tokens", "value": {"intValue": "12"}}, {"key": "gen_ai.prompt", "value": {"stringValue": "secret"}}, {"key": "error.type", "value": {"stringValue": "timeout"}}]
    span = {"spanId": "1", "startTimeUnixNano": "1000000000000000000", "endTimeUnixNano": "1000000000250000000", "attributes": attributes, "status": {"code": 2}}
    document = {"resourceSpans": [{"instrumentationLibrarySpans": [{"spans": [span]}]}]}
    plain = {"spans": [{**span, "attributes": {"gen_ai.request.model": "m", "gen_ai.usage.output_tokens": "4"}, "status": {}}, {"spanId": "2", "attributes": {}}]}
    rows = records.map_spans(records.spans_of(records.parsed(lines(spark, document, plain)))).orderBy("model_name").collect()
    assert [(r["model_name"], r["input_tokens"], r["output_tokens"], r["content_dropped"], r["failed"], r["latency_ms"]) for r in rows] == [("gpt", 12, None, 1, True, 250.0), ("m", None, 4, 0, False, 250.0)]
    assert rows[1]["status_code"] == 200 and len(rows[0]["event_id"]) == 32 and rows[0]["event_id"] != rows[1]["event_id"]


def test_log_exports(spark):
    query = {"tables": [{"columns": [{"name": "timestamp"}, {"name": "name"}, {"name": "customDimensions"}, {"name": "duration"}, {"name": "success"}], "rows": [["2026-01-01T00:00:00Z", "chat", '{"gen_ai.request.model": "m"}', 12.5, "False"]]}]}
    flat = {"timestamp": "2026-01-01T00:00:00Z", "id": "x", "resultCode": "429", "customDimensions": '{"gen_ai.request.model": "n", "gen_ai.usage.input_tokens": "3"}'}
    rows = records.map_spans(records.log_records(records.parsed(lines(spark, query, flat)))).orderBy("model_name").collect()
    assert [(r["model_name"], r["latency_ms"], r["failed"], r["status_code"], r["input_tokens"]) for r in rows] == [("m", 12.5, True, None, None), ("n", None, False, 429, 3)]


def test_mapping(spark):
    mapping = {"fields": {"timestamp": "ts", "provider": "p", "deployment_name": "a.d", "model_name": "a.m"}, "usage": {"input_tokens": "u"}, "defaults": {"provider": "me"}}
    rows = records.mapped_rows(records.parsed(lines(spark, {"ts": 1767225600, "a": {"d": "d", "m": "m"}, "u": -3.7}, {"ts": 1767225600000, "a": {"d": "d", "m": "m"}, "u": "4"}, {"ts": "2026-01-01T00:00:00Z", "a": {"d": "d"}}, {"ts": "never", "a": {"d": "d", "m": "m"}})), mapping).collect()
    assert [(r["ts"].replace(tzinfo=None), r["provider"], r["input_tokens"]) for r in rows] == [(datetime(2026, 1, 1), "me", 0), (datetime(2026, 1, 1), "me", 4)]
    with pytest.raises(ValueError, match="content"):
        records.check_mapping({"fields": {"workload": "request.messages"}})
    with pytest.raises(ValueError, match="unknown"):
        records.check_mapping({"fields": {"colour": "c"}})


def test_html_tables(spark):
    good = "<table><tr><th>Nav</th></tr></table><table><tr><th>Model</th><th> Base\n input </th></tr><tr><td>A</td><td>$3 / MTok</td></tr></table>"
    rows = prices.html_tables(spark.createDataFrame([(1, good), (2, None)], "page_id int, html string"), ["Model", "Base input"])
    assert [tuple(r["cells"]) for r in rows.collect()] == [("A", "$3 / MTok")]
    assert rows.select(prices.dollars(F.col("cells")[1])).first()[0] == 3.0


def test_units(spark):
    df = spark.createDataFrame([("1K",), ("1M",), ("100",), ("1/Hour",), ("10K tokens",), (None,)], "u string")
    assert [r[0] for r in df.select(prices.units_per_measure(F.col("u"))).collect()] == [1000.0, 1e6, 100.0, None, 10_000.0, None]


def test_contract_rates(spark):
    rows = spark.createDataFrame([("a", "input_tokens", 2.0, 1000.0), ("a", "output_tokens", 4.0, 1000.0), ("b", "input_tokens", 1.0, 1.0)], "model string, component string, unit_price double, unit_multiplier double")
    assert [tuple(r) for r in prices.contract_entries(rows).collect()] == [("contract", "a", 2000.0, None, 4000.0)]


# Sinks and streams


def test_append_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("a", T0), ("b", T0), ("a", T0)], "event_id string, ts timestamp")
    folder = str(tmp_path / "out")
    assert [record_sink.append_new(rows, folder), record_sink.append_new(rows, folder)] == [2, 0]
    nameless = spark.createDataFrame([(None, T0), (None, T0), (None, T0), (None, None), ("", T0), ("a", T0)], "event_id string, ts timestamp")
    assert [record_sink.append_new(nameless, folder), record_sink.append_new(nameless, folder)] == [5, 0]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("TL001", "high", 3, "x")], "rule_id string, severity string, affected int, confidence string")
    assert "confidence" not in reports.report_json({"findings": df})
    assert json.loads(reports.report_sarif(df))["runs"][0]["results"][0]["level"] == "error"
    assert "TL001" in reports.report_text({"findings": df}) and "<td>TL001</td>" in reports.report_html({"findings": df})
    path = reports.timestamped_path(str(tmp_path), "json", T0)
    reports.write_private("{}", path)
    assert path.stat().st_mode & 0o777 == 0o600 and reports.timestamped_path(str(tmp_path), "json", T0) != path


def test_streams_agree_with_batches(spark, tmp_path):
    rows = traces(spark, *[{"ts": T0 + timedelta(minutes=i), "request_id": f"r{i % 20}"} for i in range(40)])
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    once = twins.run_to_end(twins.dedupe_stream(stream), "once", str(tmp_path / "c1"))
    assert once.count() == 20
    counted = twins.run_to_end(twins.five_minute_buckets(stream), "counted", str(tmp_path / "c2"), "complete")
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, twins.five_minute_buckets(rows).collect()))


def test_plans_stay_declarative(spark):
    """The fact side of a pricing query is read once, by the columns that it needs, and joins by broadcast."""
    own = catalog(spark, {"model": "phi-4"})
    plan = rollups.deployment_rollup(pricing.price_traces(traces(spark, {}), [own]))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "CartesianProduct" not in plan and "Python" not in plan


def test_billing_takes_every_line(spark, tmp_path):
    from datetime import date

    from meterlark import catalog

    day = date(2024, 1, 1)
    lines = [(n, part, "A", 1000.0 * n, 10.0, day) for n, part in [(1, 1), (3, 1), (5, 2), (4, 3), (7, 200)]]
    spark.createDataFrame(lines, "l_linenumber int, l_partkey long, l_returnflag string, l_extendedprice double, l_quantity double, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, i, day) for i in (1, 2, 3)], "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    run = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).collect()
    assert {r["request"]: (r["state"], r["rate"]) for r in run("imported_price_ambiguity")} == {1: ("AMBIGUOUS", None), 2: ("RESOLVED", 0.005), 3: ("NO_PRICE", None)}
    assert {r["request"]: (r["rate"], r["layer"]) for r in run("layered_price")} == {1: (None, None), 2: (0.005, 0), 3: (0.5, 1)}
    assert {r["kind"]: (r["rows"], r["cost"]) for r in run("actual_cost_join")} == {"matched": (4, 0.13), "unmatched": (1, 0.07)}
