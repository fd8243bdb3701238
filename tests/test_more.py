"""Validation, capabilities, readiness, dashboards, snapshots and percentiles on literal inputs."""

import hashlib
import hmac
import random
from datetime import UTC, date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlark.functions import tokens
from meterlark.functions.quantiles import exact_percentiles
from meterlark.operators import capabilities, capacity, dashboard, manifests, pricing, readiness, validation
from meterlark.sources import prices, snapshots

NOW = datetime(2026, 9, 15, tzinfo=UTC)


def test_event_rules(spark):
    fields = "event_id string, task_id string, attempt_id string, stamp string, input_tokens long, cached_tokens long, cache_write_tokens long, output_tokens long, reasoning_tokens long"
    rows = [("a", "t", "x", "2026-01-01T00:00:00Z", 10, 6, 4, 5, 5), ("b", "t", None, "2026-01-01T00:00:00+0100", 10, 6, 5, 5, 6), ("c\n", "t", "x", "2026-01-01T00:00:00", 1, None, None, None, None), ("d", "t\r", "x", None, -1, 0, 0, 0, 0)]
    events = spark.createDataFrame(rows, fields)
    got = sorted(tuple(r) for r in validation.event_problems(events).collect())
    assert got == sorted([("b", "cached-exceeds-input"), ("b", "reasoning-exceeds-output"), ("c\n", "timestamp-without-zone"), ("c\n", "newline-in-event-id"), ("d", "negative-usage"), ("d", "cached-exceeds-input"), ("d", "timestamp-without-zone"), ("d", "newline-in-task-id")])
    assert [r["event_id"] for r in validation.valid_events(events).collect()] == ["a"]
    with pytest.raises(Exception, match="usage rules"):
        validation.valid_events(events, reject=True).collect()


def test_forbidden_keys(spark):
    """At any depth, with one scan; texts that look like names or brackets are texts."""
    deep = '{"d":[' * 50 + '{"headers": {"prompt": 1}, "fingerprints": [{"tools": {"x": [1]}}], "prompt": 2}' + "]}" * 50
    texts = [
        '{"a": {"b": [{"headers": 1}, {"x": {"prompt": null}}]}}',
        '{"fingerprints": {"system_prompt": "k"}, "content_features": {"tools": {"tools": 1}}}',
        "[]",
        deep,
        '{"a": "\\"prompt\\": {", "b": "}", "fingerprints": 3, "c": {"api_key": "\\\\"}, "\\u0074ools": 1}',
        '{"content_features": {"prompt": 1}, "messages": []}',
        None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", F.try_parse_json("t").alias("v"))
    found = validation.forbidden_keys(df, "id")
    assert sorted(tuple(r) for r in found.collect()) == [(0, "headers"), (0, "prompt"), (3, "headers"), (3, "prompt"), (4, "api_key"), (4, "tools"), (5, "messages"), (6, "not a record")]
    assert found._jdf.queryExecution().executedPlan().toString().count("Scan ") == 1


def test_fingerprints_are_hmac(spark):
    df = spark.createDataFrame([("é text",), ("",), (None,)], "t string")
    for key in (b"k", b"long" * 40):
        got = [r[0] for r in df.select(validation.keyed_fingerprint(F.col("t"), key)).collect()]
        assert got == ["hmac-sha256:" + hmac.new(key, "é text".encode(), hashlib.sha256).hexdigest(), None, None]
    assert df.select(validation.keyed_fingerprint(F.col("t"), None)).first()[0] is None


def test_capabilities(spark):
    rows = spark.createDataFrame([("GPT-4.1 mini", None), ("gpt-4.1-x", None), ("Whisper 1", "text"), (None, None)], "model_name string, modality string")
    got = [(r["modality"], r["ptu_eligible"], r["capability_status"]) for r in capabilities.with_capability(rows).collect()]
    assert got == [("text", True, "verified"), (None, None, "unknown"), ("text", None, "unknown"), (None, None, "unknown")]
    offers = spark.createDataFrame([("Global Standard",), ("DataZone_Provisioned-Managed",), ("Standard-S2",), ("odd",), (None,)], "o string")
    assert [r[0] for r in offers.select(capabilities.offer_mode(F.col("o"))).collect()] == ["global", "data_zone_provisioned", "regional", "unknown", "unknown"]
    errors = spark.createDataFrame([("RateLimitError", True), ("strange", False), (None, True), (None, False)], "t string, f boolean")
    assert [r[0] for r in errors.select(capabilities.error_category(F.col("t"), F.col("f"))).collect()] == ["rate_limited", "unknown", "unknown", None]
    with pytest.raises(Exception, match="can't be told"):
        errors.select(capabilities.resolved_deployment(F.col("t"), ["a", "b"])).collect()


def test_tool_tokens(spark):
    import json

    tools = [{"type": "function", "function": {"name": "a:b,c", "parameters": {"é": [1, 2, {"z": None, "a": 'q"u'}]}}}]
    df = spark.createDataFrame([(json.dumps(tools, ensure_ascii=False, separators=(",", ":")),), ("not json",), (None,)], "t string")
    assert [r[0] for r in df.select(tokens.count_tools(F.col("t"))).collect()] == [len(json.dumps(tools, sort_keys=True, ensure_ascii=False).encode()), 8, 0]


def test_percentiles_are_exact(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([rng.gauss(0, 1), 5.0, 5.0])) for k in ("a", "b", None) for _ in range(rng.randrange(400, 900))] + [("one", 7.0), ("none", None)]
    got = {r["k"]: r for r in exact_percentiles(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", {"p50": 0.5, "p95": 0.95, "p0": 0.0, "p100": 1.0}, bins=8).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for k, r in got.items():
        values = [x for n, x in rows if n == k and x is not None]
        assert [r["p50"], r["p95"], r["p0"], r["p100"]] == pytest.approx([float(np.percentile(values, p)) for p in (50, 95, 0, 100)])


def test_sweep_sums_from_the_top(spark):
    rng = random.Random(1)
    points = [("d", i, float(rng.randrange(0, 4000)), float(rng.randrange(0, 300))) for i in range(300)]
    df = spark.createDataFrame([(*p, p[2] + p[3], True, True) for p in points], "deployment_name string, slot long, input_tpm double, output_tpm double, tpm double, observed boolean, active boolean")
    plans = spark.createDataFrame([("d", 50, 4, 15, 5, 1.0, 250.0)], "deployment_name string, tpm_per_unit long, output_ratio int, least long, step long, hourly_rate double, blended double")
    got = capacity.sweep(df, plans, ["deployment_name"]).first()
    weighted = [i + 4 * o for _, _, i, o in points]
    top = max(15, int(np.ceil(max(weighted) * 1.2 / 50 / 5)) * 5)
    cost = lambda u: u * 720 * 0.35 + sum(max(0, w - u * 50) for w in weighted) / 300 * 43_200 / 1e6 * 250
    best = min(range(15, top + 1, 5), key=lambda u: (round(cost(u), 9), u))
    assert got["suggested_units"] == best and got["hybrid_monthly"] == pytest.approx(cost(best), abs=1e-5)
    assert got["spillover_percent"] == pytest.approx(sum(w > best * 50 for w in weighted) / 3, abs=1e-4)


def test_readiness_states(spark):
    entry = lambda **e: {"model": "phi-4", "effective_from": "2026-01-01", "input_rate": 1.0, "output_rate": 2.0, **e}
    own = pricing.Catalog("own", "customer", pricing.price_rows(spark, [entry(region="regional"), entry(model="x", region="global", effective_to="2026-02-01")]), "EUR")
    public = pricing.Catalog("public", "reference", pricing.price_rows(spark, [entry(), entry(model="gpt", region="global", aliases=["G P T"])]))
    rows = spark.createDataFrame([("a", "Phi 4", "regional"), ("b", "phi-4", "global"), ("c", "g p t", None), ("d", "gpt", "regional"), ("e", "None", "global")], "deployment string, model string, deployment_mode string").withColumn("model_version", F.lit("1"))
    got = {r["deployment"]: (r["state"], r["catalog_name"], r["override_key"]) for r in readiness.pricing_readiness(rows, own, public).collect()}
    assert got == {"a": ("currency_mismatch", "own", None), "b": ("exact_public_rate", "public", None), "c": ("exact_public_rate", "public", None), "d": ("rate_unavailable", None, "gpt"), "e": ("identity_unresolved", None, None)}
    problems = {tuple(r) for r in readiness.catalog_problems([own, public], date(2026, 3, 1)).collect()}
    assert problems == {("own", "expired", "x"), ("own", "currency-differs", None), ("own", "not-labelled-customer", "phi-4"), ("own", "not-labelled-customer", "x")}
    assert {(r["catalog"], r["entries"]) for r in readiness.catalog_status([own, public]).collect()} == {("own", 2), ("public", 2)}


def test_dashboard_state_precedence(spark):
    rows = [("x", "PTU recommended", False, True), ("ptu_not_applicable", "Borderline", True, False), ("eligible_sufficient_evidence", "Borderline", True, False), ("pricing_unavailable", "Borderline", True, True), ("eligible_sufficient_evidence", "PTU recommended", True, True), ("odd", "odd", True, True)]
    df = spark.createDataFrame(rows, "e string, r string, i boolean, s boolean")
    got = [r[0] for r in df.select(dashboard.dashboard_state(*[F.col(c) for c in "eris"])).collect()]
    assert got == ["collection_identity_error", "ptu_not_applicable", "insufficient_evidence", "pricing_unavailable", "ptu_recommended", "insufficient_evidence"]


def test_partial_days(spark):
    day = date(2026, 1, 2)
    rows = [(day, datetime(2026, 1, 2, tzinfo=UTC), datetime(2026, 1, 2, 23, 55, tzinfo=UTC)), (day, datetime(2026, 1, 2, 0, 5, tzinfo=UTC), datetime(2026, 1, 3, tzinfo=UTC)), (day, None, None)]
    df = spark.createDataFrame(rows, "d date, a timestamp, z timestamp")
    assert [r[0] for r in df.select(dashboard.partial_day(F.col("d"), F.col("a"), F.col("z"))).collect()] == [False, True, True]


def test_opportunity_is_the_largest_alone(spark):
    found = spark.createDataFrame([("d", "TL001", 10, 90), ("d", "TL002", 50, 80), ("d", "TL007", 999, 999), ("e", "TL008", None, None)], "k string, rule_id string, min_savings long, max_savings long")
    totals = spark.createDataFrame([("d", 60), ("e", None), ("f", 5)], "k string, input_tokens long")
    got = {r["k"]: (r["addressable_min_tokens"], r["addressable_max_tokens"]) for r in manifests.largest_opportunity(found, totals, ["k"]).collect()}
    assert got == {"d": (10, 60), "e": (0, 0), "f": (0, 0)}


def test_snapshots(spark, tmp_path):
    folder = str(tmp_path / "snapshots")
    own = pricing.price_rows(spark, [{"model": "a", "effective_from": "2026-01-01", "input_rate": 1.0, "output_rate": 2.0}])

    def broken(_):
        raise OSError("no answer")

    done = {r["source"]: r["ok"] for r in snapshots.sync(spark, folder, {"one": lambda s: own, "two": broken}, "usd", NOW - timedelta(days=3)).collect()}
    assert done == {"one": True, "two": False}
    snapshots.write_snapshot(spark, folder, "three", own, "eur", NOW - timedelta(days=9))
    with pytest.raises(ValueError, match="cut short"):
        snapshots.write_snapshot(spark, folder, "one", own, "usd", NOW, complete=False)
    (tmp_path / "snapshots" / "source=bad").mkdir()
    (tmp_path / "snapshots" / "source=bad" / "x.json").write_text('{"schema_version": 1, "currency": "USD"}\nnot json\n')
    stored = snapshots.load_snapshots(spark, folder)
    assert {(r["source"], r["included"], r["entries"]) for r in snapshots.provenance(stored, "USD").collect()} == {("one", True, 1), ("three", False, 1)}
    assert {(r["source"], r["needed"]) for r in snapshots.sync_needed(stored, ["one", "three", "none"], NOW).collect()} == {("one", False), ("three", True), ("none", True)}
    catalog = snapshots.public_catalog(stored, "usd")
    assert catalog.retrieved_at == "2026-09-12" and catalog.prices.count() == 1


def test_feed_bounds():
    pages = {"https://a/1": {"Items": [1, 2], "NextPageLink": "https://a/2"}, "https://a/2": {"Items": [3], "NextPageLink": None}}
    assert [p["Items"] for p in snapshots.pages_of("https://a/1", pages.get, ["https://a/"])] == [[1, 2], [3]]
    for bound in ({"max_pages": 1}, {"max_items": 2}):
        with pytest.raises(ValueError, match="more than"):
            list(snapshots.pages_of("https://a/1", pages.get, ["https://a/"], **bound))
    with pytest.raises(ValueError, match="allowed"):
        list(snapshots.pages_of("https://b/1", pages.get, ["https://a/"]))


def test_customer_catalog(spark, tmp_path):
    path = tmp_path / "own.json"
    assert snapshots.customer_catalog(spark, str(path)) is None
    path.write_text('{"currency": "usd", "catalog_name": "mine", "prices": [{"model": "a", "input_rate": 1.0, "output_rate": 2.0, "effective_from": "2026-01-01"}]}')
    own = snapshots.customer_catalog(spark, str(path))
    assert (own.name, own.currency, own.prices.first()["model"]) == ("mine", "USD", "a")


def test_spellings_fail_closed(spark):
    df = spark.createDataFrame([("Global-Standard",), ("none",)], "v string")
    assert [r[0] for r in df.select(snapshots.optional_deployment(F.col("v"))).collect()] == ["global", None]
    with pytest.raises(Exception, match="deployment mode"):
        df.select(snapshots.canonical_deployment(F.col("v"))).collect()


def test_table_prices_quarantine(spark):
    table = spark.createDataFrame([("Claude X", 10.0, 1.0, 12.0, 50.0)], "model string, input double, cached double, write double, output double")
    good, bad = snapshots.table_prices(table, [None, "data zone", "regional"], ["claude-x", "gone"])
    assert sorted((r["region"], round(r["input_rate"], 9), round(r["input_units"], 6), r["assumed"][0]) for r in good.collect()) == [("data_zone", 11.0, 1100.0, "purchase_model=payg"), ("global", 10.0, 1000.0, "deployment=global")]
    assert sorted((r["reason"], r["subject"], r["detail"]) for r in bad.collect()) == [("deployment-mode-not-published", "Claude X", "regional"), ("model-not-published", "gone", None)]


def test_price_cells(spark):
    df = spark.createDataFrame([("Input: $1.50 Output: $6 Cached: 0.15 / 1M Tokens",), ("$1,200 / 1K Pages",), ("ask us",)], "t string")
    got = [r[0] for r in df.select(snapshots.page_components(F.col("t"))).collect()]
    assert (got[0]["input"], got[0]["output"], got[0]["cached_input"], got[0]["unit"]) == (1.5, 6.0, 0.15, "/ 1M Tokens") and got[1]["unit_price"] == 1200.0 and got[2] is None
    page = spark.createDataFrame([(1, "<table><tr><th>Other</th></tr></table>")], "page_id int, html string")
    with pytest.raises(Exception, match="no table"):
        prices.html_tables(page, ["Model"], must=True).collect()
