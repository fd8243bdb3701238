"""Readers of request traces, spans, log exports and mapped application logs.

Every reader parses a line or document once into a variant and projects typed columns; nothing is inferred from data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import first_filled
from ..operators.capabilities import error_category

TOOL_CALL = "struct<function:struct<name:string>>"
MESSAGES = f"array<struct<role:string,content:variant,name:string,tool_calls:array<{TOOL_CALL}>>>"


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """SRC1 to SRC3, SET1: (file, value) of the non-blank lines of files, directories and globs."""
    lines = spark.read.text(list(dict.fromkeys([paths] if isinstance(paths, str) else paths)))
    return lines.select(F.col("_metadata.file_path").alias("file"), "value").where("trim(value) <> ''")


def parsed(lines: DataFrame, reject: bool = True) -> DataFrame:
    """``lines`` with ``v``, the line as a variant; a line that is no JSON object raises an error that names its file, or is left out."""
    v = F.try_parse_json("value")
    good = F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    if reject:
        v = F.when(F.coalesce(good, F.lit(False)), v).otherwise(F.raise_error(F.concat(F.lit("a line isn't a JSON object in "), F.col("file"))))
        return lines.withColumn("v", v)
    return lines.withColumn("v", v).where(F.coalesce(good, F.lit(False)))


def at(path: str, kind: str = "string", column: str = "v") -> Column:
    return F.try_variant_get(F.col(column), f"$.{path}", kind)


def content_text(content: Column) -> Column:
    """TOK2: a text, or the texts of a list of parts joined by a space."""
    parts = F.try_variant_get(content, "$", "array<struct<text:string>>")
    return F.coalesce(F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string")), F.array_join(F.transform(F.filter(parts, lambda p: p["text"].isNotNull()), lambda p: p["text"]), " "), F.lit(""))


def usage_of(base: str) -> dict[str, Column]:
    """PRJ3: a usage block under ``base``, in any of the vendors' spellings."""
    u = f"{base}usage."
    return {
        "input_tokens": F.coalesce(at(u + "input_tokens", "long"), at(u + "prompt_tokens", "long")),
        "output_tokens": F.coalesce(at(u + "output_tokens", "long"), at(u + "completion_tokens", "long")),
        "cached_tokens": F.coalesce(at(u + "cached_tokens", "long"), at(u + "prompt_tokens_details.cached_tokens", "long"), at(u + "input_token_details.cached_tokens", "long")),
    }


def normalize_traces(records: DataFrame) -> DataFrame:
    """PRJ1, PRJ2: raw, request/response and metadata envelopes as trace rows; the first filled place of each chain wins."""
    chain = lambda *paths: first_filled(*[at(p) for p in paths])
    places = lambda name: chain(name, f"request.{name}", f"metadata.{name}", f"request.metadata.{name}")
    blocks = [usage_of("response."), usage_of(""), usage_of("request.")]
    empty = lambda b: b["input_tokens"].isNull() & b["output_tokens"].isNull()
    usage = {n: F.when(~empty(blocks[0]), blocks[0][n]).when(~empty(blocks[1]), blocks[1][n]).otherwise(blocks[2][n]) for n in blocks[0]}
    deployment = F.coalesce(chain("deployment_name", "deployment", "request.deployment_name", "request.deployment", "metadata.deployment_name", "metadata.deployment", "request.model", "model"), F.lit("unknown"))
    nested = at("response", "variant").isNotNull()
    model = F.coalesce(F.when(nested, chain("model_name", "response.model_name", "response.model", "metadata.model_name")).otherwise(chain("model_name", "model", "metadata.model_name")), F.lit("unknown"))
    endpoint = chain("endpoint", "request.endpoint", "metadata.endpoint", "deployment", "deployment_name")
    raw = F.coalesce(at("request.messages", MESSAGES), at("messages", MESSAGES), at("request.input", MESSAGES), at("input", MESSAGES))
    kept = F.filter(raw, lambda m: F.coalesce(m["role"], F.lit("")) != "")
    message = lambda m: F.struct(m["role"].alias("role"), content_text(m["content"]).alias("content"), m["name"].alias("name"), F.transform(F.coalesce(m["tool_calls"], F.array().cast(f"array<{TOOL_CALL}>")), lambda c: c["function"]["name"]).alias("tool_calls"))
    tools = F.coalesce(at("request.tools", f"array<{TOOL_CALL}>"), at("tools", f"array<{TOOL_CALL}>"), F.array().cast(f"array<{TOOL_CALL}>"))
    return records.select(
        "file",
        F.try_to_timestamp(chain("timestamp", "request.timestamp")).alias("ts"),
        chain("request_id", "id", "request.request_id").alias("request_id"),
        chain("metadata.event_id", "event_id").alias("event_id"),
        F.when(model != "unknown", model).otherwise(deployment).alias("model"),
        deployment.alias("deployment_name"),
        model.alias("model_name"),
        F.coalesce(places("provider"), F.when(endpoint.isNotNull(), fixed.PROVIDER), F.lit("unknown")).alias("provider"),
        F.coalesce(places("service_tier"), F.lit("standard")).alias("service_tier"),
        F.coalesce(places("deployment_mode"), F.lit("unknown")).alias("deployment_mode"),
        places("resource_name").alias("resource_name"),
        places("project_name").alias("project_name"),
        F.coalesce(F.transform(kept, message), F.array().cast("array<struct<role:string,content:string,name:string,tool_calls:array<string>>>")).alias("messages"),
        F.filter(F.transform(tools, lambda t: t["function"]["name"]), lambda n: n.isNotNull()).alias("tools"),
        F.coalesce(at("request.tools"), at("tools")).alias("tools_json"),
        F.coalesce(at("retrieved_chunks", "array<string>"), at("request.retrieved_chunks", "array<string>"), F.array().cast("array<string>")).alias("retrieved_chunks"),
        F.coalesce(at("request.max_output_tokens", "long"), at("max_output_tokens", "long"), at("request.max_tokens", "long"), at("max_tokens", "long")).alias("max_output_tokens"),
        *[c.alias(n) for n, c in usage.items()],
        at("latency_ms", "double").alias("latency_ms"),
        at("status_code", "int").alias("status_code"),
        chain("retry_of").alias("retry_of"),
        F.coalesce(at("metadata.retry_count", "int"), F.lit(0)).alias("retry_count"),
        F.coalesce(at("observed_cost_usd", "double"), at("response.observed_cost_usd", "double")).alias("observed_cost_usd"),
        chain("metadata.tenant", "request.metadata.tenant").alias("tenant"),
        chain("metadata.workload", "request.metadata.workload").alias("workload"),
        chain("metadata.task_type", "request.metadata.task_type").alias("task_type"),
        chain("metadata.record_type", "record_type").alias("record_type"),
    )


USAGE = ["input_tokens", "cached_tokens", "output_tokens", "reasoning_tokens", "cache_write_tokens"]


def canonical_requests(records: DataFrame) -> DataFrame:
    """PRJ4, PRJ6, PRJ7: canonical request records of versions 1 to 4; before 4 a zero is not known to be measured, so it becomes null and is flagged."""
    version = at("schema_version", "int")
    rows = records.where((at("record_type") == "model_request") & version.between(1, 4)).withColumn("old", version < 4)
    value = lambda n: at(f"usage.{n}", "long")
    zero = [F.when(F.col("old") & (value(n) == 0), F.lit(n)) for n in USAGE]
    missing = F.array_sort(F.array_union(F.coalesce(at("missing_metrics", "array<string>"), F.array().cast("array<string>")), F.array_compact(F.array(*zero))))
    return rows.select(
        "file", at("event_id").alias("event_id"), F.try_to_timestamp(at("timestamp")).alias("ts"), at("source").alias("telemetry_source"), at("provider").alias("provider"), at("deployment_name").alias("deployment_name"), at("model_name").alias("model_name"),
        F.coalesce(at("service_tier"), F.lit("standard")).alias("service_tier"), F.coalesce(at("deployment_mode"), F.lit("unknown")).alias("deployment_mode"), F.coalesce(at("workload"), at("scope.workload")).alias("workload"),
        *[F.when(F.col("old") & (value(n) == 0), F.lit(None)).otherwise(value(n)).alias(n) for n in USAGE],
        at("latency_ms", "double").alias("latency_ms"), at("status_code", "int").alias("status_code"), F.coalesce(at("retry_count", "int"), F.lit(0)).alias("retry_count"), at("retry_of").alias("retry_of"),
        missing.alias("missing_metrics"), (F.size(F.array_compact(F.array(*zero))) > 0).alias("availability_migration_warning"),
        at("content_features.system_prompt_tokens", "long").alias("prefix_tokens"), at("fingerprints.system_prompt").alias("fingerprint"),
    )


def canonical_buckets(records: DataFrame) -> DataFrame:
    """PRJ5: canonical metric buckets; latency is the median, or the average where that is missing or zero."""
    rows = records.where((at("record_type") == "foundry_metric_bucket") & at("schema_version", "int").between(1, 4))
    names = ["input_tokens", "cached_tokens", "output_tokens", "requests", "successful_requests", "throttled_requests", "failed_requests"]
    p50 = at("metrics.p50_latency_ms", "double")
    return rows.select(
        "file", at("event_id").alias("event_id"), F.unix_seconds(F.try_to_timestamp(at("timestamp"))).alias("bucket"), at("deployment_name").alias("deployment_name"), at("model_name").alias("model_name"), F.coalesce(at("bucket_minutes", "int"), F.lit(5)).alias("bucket_minutes"),
        *[at(f"metrics.{n}", "long").alias(n) for n in names], at("metrics.average_latency_ms", "double").alias("average_latency_ms"), F.when(p50 != 0, p50).otherwise(at("metrics.average_latency_ms", "double")).alias("latency_ms"),
        F.coalesce(at("outcome_coverage"), F.lit("unavailable")).alias("outcome_coverage"), at("status_codes", "map<string,long>").alias("status_codes"), at("expected_buckets", "int").alias("expected_buckets"), at("missing_metrics", "array<string>").alias("missing_metrics"),
    )


def task_event_lines(records: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """SRC5, SRC6, PRJ21: lines of task events (schema version 2); ``aliases`` gives dotted paths for canonical names."""
    path = lambda n: (aliases or {}).get(n, n)
    text = ["event_id", "event_type", "task_id", "task_type", "attempt_id", "execution_strategy", "strategy_version", "workload", "provider", "deployment_name", "model_name", "service_tier", "region", "tool_category", "outcome", "automated_check", "review_outcome"]
    kinds = {"step_index": "int", "context_length": "long", "observed_cost_usd": "double", "duration_ms": "double", "status_code": "int", "escaped_error": "boolean", "policy_compliant": "boolean", "cleanup_cost_usd": "double"}
    usage = {"input_tokens": "input_tokens", "cached_tokens": "cached_input_tokens", "cache_write_tokens": "cache_write_tokens", "output_tokens": "output_tokens", "reasoning_tokens": "reasoning_tokens"}
    rows = records.where((at("schema_version", "int") == 2) & at(path("event_type")).isin("model_call", "tool_step", "task_result", "human_review"))
    return rows.select("file", F.try_to_timestamp(at(path("timestamp"))).alias("ts"), *[at(path(n)).alias(n) for n in text], *[at(path(n), k).alias(n) for n, k in kinds.items()], *[F.coalesce(at(f"usage.{p}", "long"), F.when(at("usage", "variant").isNotNull(), F.lit(0))).alias(n) for n, p in usage.items()])


# Spans

VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"


def spans_of(documents: DataFrame) -> DataFrame:
    """SRC7 to SRC9, PRJ9, PRJ10: (file, span, attributes) of OTLP documents, span lists and single spans in ``v``."""
    many = at("resourceSpans", "array<struct<scopeSpans:array<struct<spans:array<variant>>>,instrumentationLibrarySpans:array<struct<spans:array<variant>>>>>")
    deep = F.flatten(F.flatten(F.transform(many, lambda r: F.transform(F.coalesce(r["scopeSpans"], r["instrumentationLibrarySpans"]), lambda s: F.coalesce(s["spans"], F.array().cast("array<variant>"))))))
    listed = F.coalesce(deep, at("spans", "array<variant>"), F.array(F.col("v")))
    text = lambda x: F.coalesce(x["stringValue"], x["intValue"], x["doubleValue"].cast("string"), x["boolValue"].cast("string"))
    empty = F.create_map().cast("map<string,string>")

    def attributes(span: Column) -> Column:
        pairs = F.filter(F.try_variant_get(span, "$.attributes", f"array<struct<key:string,value:{VALUE}>>"), lambda p: p["key"].isNotNull())
        entries = F.transform(pairs, lambda p: F.struct(p["key"].alias("key"), text(p["value"]).alias("value")))
        keys = F.transform(pairs, lambda p: p["key"])
        last = F.map_from_entries(F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("key"), F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"].alias("value"))))
        return F.coalesce(F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.map_from_entries(entries)).otherwise(last), F.try_variant_get(span, "$.attributes", "map<string,string>"), empty)

    # the map is built inside the generator, so no filter or projection above it builds it again
    return documents.select("file", F.explode(F.transform(listed, lambda s: F.struct(s.alias("span"), attributes(s).alias("attributes")))).alias("x")).select("file", "x.span", "x.attributes")


def is_content(name: Column) -> Column:
    """FLT11: whether a name has a fragment that marks content."""
    return F.lower(name).rlike("|".join(fixed.CONTENT_FRAGMENTS))


def split_attributes(attributes: Column, allowed: Sequence[str]) -> tuple[Column, Column]:
    """PRJ18: the allowed attributes, and how many of the rest are content."""
    keep = F.map_filter(attributes, lambda k, _: k.isin(*allowed))
    return keep, F.size(F.filter(F.map_keys(attributes), lambda k: ~k.isin(*allowed) & is_content(k)))


def event_id(*parts: Column) -> Column:
    """A stable id: the first half of the SHA-256 of the parts; a missing part counts as None."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]).cast("binary"), 256), 1, 32)


def map_spans(spans: DataFrame, own: str = "meterlark") -> DataFrame:
    """PRJ8, AGG40: spans that name a model as request rows, with what content they had to leave behind as a count."""
    kept, dropped = split_attributes(F.col("attributes"), [*fixed.SPAN_ATTRIBUTES, f"{own}.deployment_mode", f"{own}.workload"])
    rows = spans.withColumns({"a": kept, "content_dropped": dropped})
    a = lambda *names: F.coalesce(*[F.element_at("a", F.lit(n)) for n in names])
    whole = lambda *names: F.greatest(F.lit(0), F.expr(f"try_cast(coalesce({', '.join(f'element_at(a, {n!r})' for n in names)}) AS long)"))
    whole_or_null = lambda *names: F.when(F.expr(f"try_cast(coalesce({', '.join(f'element_at(a, {n!r})' for n in names)}) AS long)").isNotNull(), whole(*names))
    s = lambda p, k="string": F.try_variant_get("span", f"$.{p}", k)
    start, end = F.coalesce(s("startTimeUnixNano", "long"), s("start_time_unix_nano", "long")), F.coalesce(s("endTimeUnixNano", "long"), s("end_time_unix_nano", "long"))
    ts = F.coalesce(F.timestamp_micros((start / 1000).cast("long")), F.try_to_timestamp(F.coalesce(s("startTime"), s("timestamp"))))
    request, response = a("gen_ai.request.model"), a("gen_ai.response.model")
    deployment = F.coalesce(a("gen_ai.azure.deployment_name"), request, response)
    system = F.coalesce(a("gen_ai.provider.name"), a("gen_ai.system"), F.lit("unknown"))
    failed = F.upper(F.coalesce(s("status.code"), F.lit(""))).isin("STATUS_CODE_ERROR", "ERROR", "2")
    status = F.nullif(whole_or_null("http.response.status_code"), F.lit(0))
    rows = rows.where(F.coalesce(F.element_at("a", F.lit("gen_ai.request.model")), F.element_at("a", F.lit("gen_ai.response.model"))).isNotNull())
    return rows.select(
        "file", event_id(F.lit("otel"), F.coalesce(s("spanId"), s("span_id"), F.lit("")), deployment, ts).alias("event_id"), ts.alias("ts"), F.when(F.startswith(F.lower(system), F.lit("az.")) | F.contains(F.lower(system), F.lit("azure")), fixed.PROVIDER).otherwise(system).alias("provider"),
        deployment.alias("deployment_name"), F.coalesce(response, request).alias("model_name"), F.coalesce(a("gen_ai.response.service_tier"), a("gen_ai.request.service_tier"), F.lit("standard")).alias("service_tier"), F.coalesce(a(f"{own}.deployment_mode"), a("az.deployment.mode"), F.lit("unknown")).alias("deployment_mode"),
        a(f"{own}.workload").alias("workload"), F.coalesce(a("gen_ai.operation.name"), s("name")).alias("api"), whole_or_null("gen_ai.usage.input_tokens", "gen_ai.usage.prompt_tokens").alias("input_tokens"), whole_or_null("gen_ai.usage.output_tokens", "gen_ai.usage.completion_tokens").alias("output_tokens"),
        whole_or_null("gen_ai.usage.cached_input_tokens").alias("cached_tokens"), whole_or_null("gen_ai.usage.reasoning_tokens").alias("reasoning_tokens"), F.round((end - start) / 1_000_000, 3).alias("latency_ms"),
        F.when(~failed & a("error.type").isNull(), F.coalesce(status, F.lit(200))).otherwise(status).cast("int").alias("status_code"), (failed | a("error.type").isNotNull()).alias("failed"), error_category(a("error.type"), failed).alias("error_category"), "content_dropped",
    )


def log_records(documents: DataFrame) -> DataFrame:
    """SRC10 to SRC14, PRJ14: rows of a logs query ({tables: [{columns, rows}]}) or of a flat export, as spans with attributes."""
    tables = at("tables", "array<struct<columns:array<struct<name:string>>,rows:array<array<variant>>>>")
    rows = documents.select("file", F.explode(F.flatten(F.transform(tables, lambda t: F.transform(t["rows"], lambda r: F.map_from_arrays(F.transform(t["columns"], lambda c: c["name"]), F.transform(r, lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x)))))))).alias("r")).where("r is not null")
    flat = documents.where(at("tables", "variant").isNull()).select("file", F.try_variant_get("v", "$", "map<string,string>").alias("r"))
    both = rows.unionByName(flat)
    g = lambda *names: F.coalesce(*[F.element_at("r", F.lit(n)) for n in names])
    custom = lambda n: F.coalesce(F.from_json(g(n), "map<string,string>"), F.create_map().cast("map<string,string>"))
    known = F.map_filter("r", lambda k, _: F.startswith(k, F.lit("gen_ai.")) | F.startswith(k, F.lit("az.")))
    code = g("resultCode", "ResultCode")
    merged = lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
    attributes = merged(merged(merged(F.when(code.isNotNull(), F.create_map(F.lit("http.response.status_code"), code)).otherwise(F.create_map().cast("map<string,string>")), known), custom("customDimensions")), custom("customMeasurements"))
    start = F.unix_micros(F.try_to_timestamp(g("timestamp", "timestamp [UTC]"))) * 1000
    length = (g("duration", "DurationMs").try_cast("double") * 1_000_000).cast("long")
    state = F.when(F.lower(F.trim(F.coalesce(g("success"), F.lit("")))) == "false", "STATUS_CODE_ERROR").otherwise("STATUS_CODE_OK")
    span = F.struct(F.coalesce(g("name", "target"), F.lit("log-export")).alias("name"), F.coalesce(g("id", "itemId", "operation_Id"), F.lit("")).alias("spanId"), start.alias("startTimeUnixNano"), (start + length).alias("endTimeUnixNano"), F.struct(state.alias("code")).alias("status"))
    return both.select("file", F.parse_json(F.to_json(span)).alias("span"), attributes.alias("attributes"))


# Mapped application logs

REQUIRED = ["timestamp", "provider", "deployment_name", "model_name"]
DESTINATIONS = {*REQUIRED, "deployment_mode", "service_tier", "api", "workload", "latency_ms", "status_code", "error_category", "retry_count", "retry_of"}
ERRORS = ["rate_limit", "timeout", "authentication", "invalid_request", "server_error", "content_filter", "unknown"]


SECTIONS = {"fields", "usage", "defaults", "timestamp_format"}
COUNT_SUFFIXES = ("_tokens", "_token_count", "tokencount")


def check_mapping(mapping: dict) -> dict:
    """PRJ12, VAL10, VAL11: known sections and destinations only, and no source path that names content; names of token counts aren't content."""
    import re

    strange = sorted(set(mapping) - SECTIONS)
    if strange:
        raise ValueError(f"unknown sections: {', '.join(strange)}")
    unknown = sorted(set(mapping.get("fields", {})) - DESTINATIONS) + sorted(set(mapping.get("usage", {})) - set(USAGE))
    if unknown:
        raise ValueError(f"unknown destinations: {', '.join(unknown)}")
    if mapping.get("timestamp_format", "auto") not in ("auto", "iso8601", "epoch_seconds", "epoch_millis"):
        raise ValueError(f"unknown timestamp format: {mapping['timestamp_format']}")
    content = re.compile("|".join(fixed.CONTENT_FRAGMENTS))
    paths = [*mapping.get("fields", {}).values(), *mapping.get("usage", {}).values()]
    empty = [p for p in paths if not all(str(p).split("."))]
    if empty:
        raise ValueError(f"source paths with an empty segment: {', '.join(map(str, empty))}")
    risky = [p for p in paths if any(content.search(part.lower()) and not part.lower().endswith(COUNT_SUFFIXES) for part in p.split("."))]
    if risky:
        raise ValueError(f"source paths that may hold content: {', '.join(sorted(risky))}")
    lacking = [n for n in REQUIRED if n not in mapping.get("fields", {}) and n not in mapping.get("defaults", {})]
    if lacking:
        raise ValueError(f"required destinations without a source: {', '.join(lacking)}")
    return mapping


def read_mapping(spark: SparkSession, path: str) -> dict:
    """SRC16: a mapping file, JSON or (where PyYAML is there) YAML, from any store that Spark reads."""
    import json

    text = spark.read.text(path, wholetext=True).first()[0]
    try:
        mapping = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ModuleNotFoundError as error:
            raise ValueError("a mapping that isn't JSON needs PyYAML") from error
        mapping = yaml.safe_load(text)
    if not isinstance(mapping, dict):
        raise ValueError("a mapping file holds sections by name")
    return check_mapping({k: v if v is not None else {} for k, v in mapping.items()})


def mapped_rows(records: DataFrame, mapping: dict) -> DataFrame:
    """SRC15, SRC16, PRJ11, PRJ13, AGG39: rows by a declared mapping; those that lack a required field are left out."""
    mapping = check_mapping(mapping)
    fields, defaults, usage = mapping.get("fields", {}), mapping.get("defaults", {}), mapping.get("usage", {})
    value = lambda n, k="string": F.coalesce(*([at(fields[n], k)] if n in fields else []), F.lit(defaults.get(n)).cast(k))
    whole = lambda p: F.when(at(p, "double").isNotNull(), F.greatest(F.lit(0), at(p, "double").cast("long")))
    style, text = mapping.get("timestamp_format", "auto"), value("timestamp")
    number = F.when(text.rlike(r"^[0-9]+(\.[0-9]*)?$"), text.cast("double"))
    seconds = number / 1000 if style == "epoch_millis" else F.when(number > 10_000_000_000, number / 1000).otherwise(number) if style == "auto" else number
    ts = F.coalesce(F.timestamp_micros(F.round(seconds * 1_000_000).cast("long")), F.when(number.isNull(), F.try_to_timestamp(text)))
    out = records.select("file", ts.alias("ts"), *[value(n).alias(n) for n in sorted(DESTINATIONS - {"timestamp", "latency_ms", "status_code", "retry_count"})], value("latency_ms", "double").alias("latency_ms"), value("status_code", "int").alias("status_code"), *[(whole(usage[n]) if n in usage else F.lit(None).cast("long")).alias(n) for n in USAGE])
    out = out.where(F.col("ts").isNotNull() & (F.coalesce("provider", F.lit("")) != "") & (F.coalesce("deployment_name", F.lit("")) != "") & (F.coalesce("model_name", F.lit("")) != ""))
    known = F.when(F.col("error_category").isin(*ERRORS), F.col("error_category"))
    return out.withColumns({"error_category": known, "event_id": event_id(F.lit("import"), *[F.col(c) for c in ("provider", "deployment_name", "model_name", "ts", "input_tokens", "output_tokens", "cached_tokens", "status_code", "latency_ms")])})


# Metric points

METRIC_FIELDS = {"ProcessedPromptTokens": "input_tokens", "InputTokens": "input_tokens", "CachedPromptTokens": "cached_tokens", "GeneratedTokens": "output_tokens", "OutputTokens": "output_tokens", "ModelRequests": "requests", "AzureOpenAIRequests": "requests", "Latency": "average_latency_ms"}


def normal_dimensions(dimensions: Column) -> Column:
    """PRJ15: dimension names by their aliases, any case; unknown ones under ``azure.``; null values are dropped."""
    aliases = F.create_map(*[F.lit(x) for pair in fixed.DIMENSIONS.items() for x in pair])
    name = lambda k: F.coalesce(F.element_at(aliases, F.lower(F.trim(k))), F.concat(F.lit("azure."), F.trim(k)))
    return F.map_from_entries(F.transform(F.filter(F.map_entries(dimensions), lambda e: e["value"].isNotNull()), lambda e: F.struct(name(e["key"]).alias("key"), e["value"].alias("value"))))


def metric_points(series: DataFrame) -> DataFrame:
    """SRC17, SRC18: series (metric_name, dimensions, ts, total, average) as points for ``pivot_points``; unknown metrics are left out."""
    fields = F.create_map(*[F.lit(x) for pair in METRIC_FIELDS.items() for x in pair])
    rows = series.withColumns({"d": normal_dimensions(F.col("dimensions")), "field": F.element_at(fields, F.col("metric_name"))}).where("field is not null")
    counted = F.col("field") != "average_latency_ms"
    return rows.select(
        "ts", F.element_at("d", F.lit("ModelDeploymentName")).alias("deployment_name"), "field", F.array_join(F.transform(F.array_sort(F.map_entries("d")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("signature"),
        F.expr("try_cast(element_at(d, 'StatusCode') AS int)").alias("status_code"), F.when(counted, "counter").otherwise("average").alias("kind"), F.when(counted, F.col("total")).otherwise(F.col("average")).cast("double").alias("value"),
    )
