"""Paged feeds as a data source; prices by bins of days and labels by prefixes against brute force; percentiles of several measures."""

import json
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlark.functions.quantiles import measured_percentiles
from meterlark.sources import feeds, prices


def put(root, resource, window, page, items, link=None):
    at = root / f"resource={resource}" / f"window={window}"
    at.mkdir(parents=True, exist_ok=True)
    (at / page).write_text(json.dumps({"Items": items, "NextPageLink": link}))


def test_feeds_are_followed(spark, tmp_path):
    for r in "abc":
        put(tmp_path, r, "w1", "page=1", [{"n": 1}, {"n": "é"}], "two")
        put(tmp_path, r, "w1", "two", [], f"file://{tmp_path}/resource={r}/window=w1/three")
        put(tmp_path, r, "w1", "three", [{"n": 3}])
    put(tmp_path, "a", "w2", "page=1", None)
    rows = feeds.read_feeds(spark, str(tmp_path))
    got = sorted((r["resource"], r["window"], r["page"], r["position"], json.loads(r["item"])["n"]) for r in rows.collect() if True)
    assert got == [(r, "w1", p, i, n) for r in "abc" for p, i, n in ((1, 1, 1), (1, 2, "é"), (3, 1, 3))]
    assert {r["resource"] for r in rows.where("resource = 'b'").collect()} == {"b"}
    reader = feeds.FeedReader({"path": str(tmp_path)})
    assert list(reader.pushFilters([feeds.EqualTo(("resource",), "a"), feeds.In(("window",), ("w2", "w3")), feeds.EqualTo(("page",), 1)])) == [feeds.EqualTo(("page",), 1)]
    assert [(f.resource, f.window) for f in reader.partitions()] == [("a", "w2")]


@pytest.mark.parametrize(
    ("pages", "options", "error"),
    [
        (41, {}, "more than 40 pages"),
        (3, {"max_items": 5}, "more than 5 items"),
        (2, {"away": "file:///etc/page"}, "isn't below the feeds"),
        (2, {"away": "../../resource=b/window=w/../x"}, "isn't below the feeds"),
        (2, {"away": "page=1"}, "names a page again"),
        (2, {"away": "gone"}, "gone"),
    ],
)
def test_feeds_are_never_cut_short(spark, tmp_path, pages, options, error):
    for n in range(1, pages + 1):
        put(tmp_path, "a", "w", f"page={n}", [{"n": n}] * 2, f"page={n + 1}" if n < pages else options.get("away"))
    with pytest.raises(Exception, match=error):
        feeds.read_feeds(spark, str(tmp_path), **{k: v for k, v in options.items() if k != "away"}).collect()


def test_forty_pages_are_read(spark, tmp_path):
    for n in range(1, 41):
        put(tmp_path, "a", "w", f"page={n}", [{"n": n}], f"page={n + 1}" if n < 40 else None)
    assert feeds.read_feeds(spark, str(tmp_path)).count() == 40


def test_prices_by_bins(spark):
    rng, start = random.Random(3), date(2024, 1, 1)
    rows = []
    for i in range(300):
        a = start + timedelta(days=rng.randrange(-400, 500))
        z = None if rng.random() < 0.1 else a + timedelta(days=rng.randrange(0, 90))
        rows.append((f"m{rng.randrange(40)}", "A", "input", float(i), 10.0, None if i % 5 == 0 else 2.0, "USD", a, z))
    asked = [(i, f"m{rng.randrange(45)}", "A", "input", start + timedelta(days=rng.randrange(-50, 450))) for i in range(400)] + [(400, None, "A", "input", start), (401, "m1", "A", "input", None)]
    df = spark.createDataFrame(rows, "model string, processing_scope string, component string, unit_price double, unit_multiplier double, quantity double, currency string, effective_from date, effective_to date")
    requests = spark.createDataFrame(asked, "request long, model string, processing_scope string, component string, at date")
    want = {}
    for i, m, _, _, at in asked:
        fit = [r for r in rows if at and r[0] == m and r[7] <= at and (r[8] is None or at <= r[8])]
        want[i] = ("NO_PRICE", None) if not fit else ("AMBIGUOUS", None) if len(fit) > 1 else ("RATE_VERIFIED_USAGE_MISSING" if fit[0][5] is None else "RESOLVED", fit[0][3] / 10)
    for bin_days in (1, 32, 10_000):
        assert {r["request"]: (r["state"], r["rate"]) for r in prices.imported_prices(df, requests, bin_days).collect()} == want
    assert prices.imported_prices(df, requests.limit(0)).count() == 0
    plan = prices.imported_prices(df.hint("merge"), requests)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "bin#" in plan


def test_prices_never_pair_requests_and_rows(spark):
    """Requests within a day meet rows that begin and end within it, and no join compares moments."""
    at = lambda minute: datetime(2024, 1, 1) + timedelta(minutes=minute)
    rows = [("m", "A", "input", float(a), 10.0, 2.0, "USD", at(a), None if z is None else at(z)) for a, z in ((10, 20), (20, 30), (31, 40), (60, None), (1500, 1600), (50, 45))]
    df = spark.createDataFrame(rows, "model string, processing_scope string, component string, unit_price double, unit_multiplier double, quantity double, currency string, effective_from timestamp, effective_to timestamp")
    requests = spark.createDataFrame([(i, "m", "A", "input", at(i)) for i in (9, 10, 19, 20, 21, 30, 31, 47, 60, 1499, 1500, 1600, 1601, 9000)], "request long, model string, processing_scope string, component string, at timestamp")
    found = prices.imported_prices(df, requests, 1)
    got = {r["request"]: r["rate"] if r["state"] == "RESOLVED" else r["state"] for r in found.collect()}
    assert got == {9: "NO_PRICE", 10: 1.0, 19: 1.0, 20: "AMBIGUOUS", 21: 2.0, 30: 2.0, 31: 3.1, 47: "NO_PRICE", 60: 6.0, 1499: 6.0, 1500: "AMBIGUOUS", 1600: "AMBIGUOUS", 1601: 6.0, 9000: 6.0}
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join " in x]
    assert joins and not any("<=" in x or ">=" in x for x in joins)


def test_labels_and_crosswalk(spark):
    crosswalk = spark.createDataFrame([("a", "p", "Five"), ("b", "p", "five-six"), ("c", "q", "FIVE six"), ("d", "p", " "), ("e", "p", "seven eight nine")], "model string, publisher string, label string")
    names = spark.createDataFrame([("five six seven",), ("five",), ("sixty",), ("",), ("seven eight",), (None,)], "name string")
    t = names.select(prices.label_tokens(F.col("name")).alias("t")).distinct()
    got = {" ".join(r["t"]): (r["m"]["n"], r["m"]["model"]) for r in prices.longest_labels(t, crosswalk).collect()}
    assert got == {"five six seven": (2, "c"), "five": (1, "a")}
    assert prices.longest_labels(t, crosswalk.limit(0)).count() == 0
    known = crosswalk.withColumn("aliases", F.when(F.col("model") == "b", F.array(F.lit("A"), F.lit("bee_1"))).when(F.col("model") == "c", F.array(F.lit("Bee 1"))))
    asked = spark.createDataFrame([(i, n) for i, n in enumerate(["a", "BEE-1", "nobody", None, ""])], "id int, name string")
    assert {r["id"]: r["model"] for r in prices.crosswalk_models(asked, known).collect()} == {0: "a", 1: "b", 2: None, 3: None, 4: None}


def test_percentiles_of_measures(spark):
    rng = np.random.default_rng(5)
    values = [(k, float(v), None if v % 3 else float(v * 2)) for k in ("x", None) for v in rng.integers(0, 500, 400)] + [("none", None, None)]
    rows = spark.createDataFrame(values, "k string, a double, b double")
    got = {r["k"]: r for r in measured_percentiles(rows, ["k"], {"a": F.col("a"), "b": F.col("b")}, {"p50": 0.5, "p90": 0.9}).collect()}
    assert set(got) == {"x", None}
    for k in ("x", None):
        for i, m in ((1, "a"), (2, "b")):
            mine = [v[i] for v in values if v[0] == k and v[i] is not None]
            assert [got[k][f"{m}_p50"], got[k][f"{m}_p90"]] == pytest.approx([np.quantile(mine, 0.5), np.quantile(mine, 0.9)])


# Mappings and reports

GOOD = {"fields": {"timestamp": "at", "provider": "p", "deployment_name": "d", "model_name": "m"}, "usage": {"input_tokens": "usage.prompt_tokens"}}


def test_mapping_files(spark, tmp_path):
    from meterlark.sources import records

    (tmp_path / "a.json").write_text(json.dumps(GOOD))
    assert records.read_mapping(spark, str(tmp_path / "a.json")) == GOOD
    pytest.importorskip("yaml")
    (tmp_path / "b.yml").write_text("# a mapping\nfields:\n  timestamp: at\n  provider: p\n  deployment_name: d\n  model_name: m\nusage:\n  input_tokens: usage.prompt_tokens\ndefaults:\n")
    assert records.read_mapping(spark, str(tmp_path / "b.yml")) == {**GOOD, "defaults": {}}
    (tmp_path / "c.yml").write_text("just text")
    with pytest.raises(ValueError, match="sections by name"):
        records.read_mapping(spark, str(tmp_path / "c.yml"))
    line = json.dumps({"at": "2026-01-01T00:00:00Z", "p": "x", "d": "y", "m": "z", "usage": {"prompt_tokens": 7}})
    rows = records.mapped_rows(records.parsed(spark.createDataFrame([("f", line)], "file string, value string")), records.read_mapping(spark, str(tmp_path / "b.yml")))
    assert rows.first()["input_tokens"] == 7


@pytest.mark.parametrize(
    ("change", "error"),
    [
        ({"extra": {}}, "unknown sections: extra"),
        ({"fields": {**GOOD["fields"], "prompt": "x"}}, "unknown destinations: prompt"),
        ({"usage": {"input_tokens": "request.prompt.text"}}, "may hold content"),
        ({"usage": {"input_tokens": "prompt_tokens.api_key"}}, "may hold content"),
        ({"usage": {"input_tokens": "a..b"}}, "empty segment"),
        ({"fields": {"timestamp": "t"}}, "required destinations"),
        ({"timestamp_format": "roman"}, "timestamp format"),
    ],
)
def test_mappings_that_are_refused(change, error):
    from meterlark.sources import records

    with pytest.raises(ValueError, match=error):
        records.check_mapping({**GOOD, **change})


def test_sarif_tells_impact_and_titles(spark):
    from meterlark.sinks import reports

    findings = spark.createDataFrame([("TL001", "medium", 3, 1.5, 12.0), ("TL999", "info", 1, None, None)], "rule_id string, severity string, affected int, impact_min_percent double, impact_max_percent double")
    deployments = spark.createDataFrame([("d", "m", 5, "x")], "deployment_name string, model_name string, total_tokens long, other string")
    run = json.loads(reports.report_sarif(findings, deployments=deployments))["runs"][0]
    assert [r["level"] for r in run["results"]] == ["warning", "note"] and run["results"][0]["properties"]["impact_max_percent"] == 12.0 and "12.0 percent" in run["results"][0]["message"]["text"]
    assert run["tool"]["driver"]["rules"][0]["shortDescription"]["text"] != "TL001" and run["properties"] == {"deployments": ["d"], "deployment_summaries": [{"deployment_name": "d", "model_name": "m", "total_tokens": 5}]}
    cohorts = spark.createDataFrame([("code", 2, 80.0, 1, 10, 4), ("chat", 0, 100.0, 0, 5, 5)], "task_type string, unresolved_events long, coverage_percent double, unresolved_tasks long, attempted_tasks long, solved_tasks long")
    run = json.loads(reports.task_sarif(cohorts))["runs"][0]
    assert [r["properties"]["task_type"] for r in run["results"]] == ["code"] and run["properties"] == {"total_attempted_tasks": 15, "total_solved_tasks": 9}


def test_all_rules_in_one_pass(spark, tmp_path):
    """One scan of conversations feeds all rules but the chunks; chunks of another table are judged with them."""
    from meterlark import catalog
    from meterlark.operators import rules

    spark.createDataFrame([(i, t, r, "please classify this text " * 9 if t else "you are a helper " * 20) for i in range(40) for t, r in enumerate(["user", "assistant", "user", "assistant", "user"])], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(i, f"item {i} " * 30) for i in range(5)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    line = "alpha beta gamma delta epsilon " * 3
    spark.createDataFrame([(i, f"{line}\n{line}\nother {i}") for i in range(40)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    traces = catalog.raw_requests(spark, str(tmp_path))
    got = {(r["deployment_name"], r["rule_id"]): r for r in catalog.QUERIES["rule_run"](spark, str(tmp_path)).collect()}
    singles = [rules.repeated_prefix, rules.fingerprint_prefix, rules.history_growth, rules.unused_tools, rules.retry_amplification, rules.output_budget, rules.repeated_intents, rules.model_sizing]
    want = {(r["deployment_name"], r["rule_id"]): tuple(r)[2:] for f in singles for r in f(traces, ["deployment_name"]).collect()}
    assert want and {k: tuple(r[n] for n in rules.RESULT[1:]) for k, r in got.items() if r["status"] == "finding" and k[1] != "TL004"} == want
    assert {d for (d, rule), r in got.items() if rule == "TL004" and r["status"] == "finding"} == {"dep-0", "dep-1", "dep-2", "dep-3"}
    whole = {r["rule_id"]: r["status"] for r in rules.evaluate(traces).collect()}
    assert len(whole) == 8 and whole["TL004"] == "not_evaluated" and whole["TL002"] == "finding"


def test_caps_are_told(spark):
    from meterlark.operators import manifests

    rows = spark.range(20, numPartitions=5).withColumnRenamed("id", "ingest_seq")
    few, reached = manifests.capped(rows, 3)
    assert reached and sorted(r[0] for r in few.collect()) == [0, 1, 2]
    assert manifests.capped(rows, 20)[1] is False and manifests.capped(rows, 20)[0].count() == 20
