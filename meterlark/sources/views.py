"""Telemetry views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODELS = ["phi-4", "MAI Thinking_1", "mai-ds-r1", "gpt-4.1", "unknown"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if it is read in fewer parts, as a small file is; a table of many parts stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number + 1).cast("int"))


def request_traces(spark: SparkSession, folder: str) -> DataFrame:
    """One model call for each row of ``events``."""
    e = table(spark, folder, "events")
    kind, user, value, number = F.col("event_type"), F.col("user_id"), F.col("value"), F.col("event_id")
    return e.select(
        number.alias("ingest_seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("dep-"), user % 5).alias("deployment_name"),
        pick(MODELS, user % 5).alias("model_name"),
        F.lit("azure_foundry").alias("provider"),
        F.lit("standard").alias("service_tier"),
        F.when((user % 5 == 2) & (user % 2 == 0), "regional").otherwise("global").alias("deployment_mode"),
        F.concat(F.lit("tenant-"), user % 7).alias("tenant"),
        F.when(user % 3 == 0, F.concat(F.lit("Work load "), user % 4)).alias("workload"),
        F.when(kind != "signup", F.round(value * 100).cast("long")).alias("input_tokens"),
        F.when(~kind.isin("signup", "view"), F.floor(value * 10).cast("long")).alias("cached_tokens"),
        F.when((kind != "signup") | (number % 3 == 0), F.round(value * 20).cast("long")).alias("output_tokens"),
        F.when(number % 40 == 7, value / 1000).alias("observed_cost_usd"),
        F.when(number % 11 != 0, value * 7).alias("latency_ms"),
        F.when(kind == "error", F.when(number % 2 == 0, 429).otherwise(500)).otherwise(200).alias("status_code"),
        F.when(number % 50 == 0, (number - 1).cast("string")).alias("retry_of"),
        F.when(number % 4 == 0, (number % 5) * 400).alias("max_output_tokens"),
    )


#: The same view for the SQL side.
REQUEST_TRACES_SQL = """
traces AS (
  SELECT event_id AS ingest_seq, ts, 'dep-' || (user_id % 5) AS deployment_name,
    (['phi-4', 'MAI Thinking_1', 'mai-ds-r1', 'gpt-4.1', 'unknown'])[user_id % 5 + 1] AS model_name,
    'azure_foundry' AS provider, 'standard' AS service_tier,
    CASE WHEN user_id % 5 = 2 AND user_id % 2 = 0 THEN 'regional' ELSE 'global' END AS deployment_mode,
    'tenant-' || (user_id % 7) AS tenant,
    CASE WHEN user_id % 3 = 0 THEN 'Work load ' || (user_id % 4) END AS workload,
    CASE WHEN event_type <> 'signup' THEN CAST(round(value * 100) AS BIGINT) END AS input_tokens,
    CASE WHEN event_type NOT IN ('signup', 'view') THEN CAST(floor(value * 10) AS BIGINT) END AS cached_tokens,
    CASE WHEN event_type <> 'signup' OR event_id % 3 = 0 THEN CAST(round(value * 20) AS BIGINT) END AS output_tokens,
    CASE WHEN event_id % 40 = 7 THEN value / 1000 END AS observed_cost_usd,
    CASE WHEN event_id % 11 <> 0 THEN value * 7 END AS latency_ms,
    CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 429 ELSE 500 END ELSE 200 END AS status_code,
    CASE WHEN event_id % 50 = 0 THEN CAST(event_id - 1 AS VARCHAR) END AS retry_of,
    CASE WHEN event_id % 4 = 0 THEN event_id % 5 * 400 END AS max_output_tokens
  FROM events)"""


def metric_buckets(spark: SparkSession, folder: str, minutes: int = 5) -> DataFrame:
    """Sums of the traces by deployment and five minutes, as a metrics service would report them."""
    t = request_traces(spark, folder)
    seconds = minutes * 60
    return (
        t.withColumn("bucket", (F.floor(F.unix_seconds("ts") / seconds) * seconds).cast("long"))
        .groupBy("deployment_name", "model_name", "bucket")
        .agg(
            F.sum("input_tokens").alias("input_tokens"),
            F.sum("cached_tokens").alias("cached_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
            F.count("*").alias("requests"),
            F.sum(F.when(F.col("status_code") < 400, 1).otherwise(0)).alias("successful_requests"),
            F.sum(F.when(F.col("status_code") == 429, 1).otherwise(0)).alias("throttled_requests"),
            F.sum(F.when(F.col("status_code") == 500, 1).otherwise(0)).alias("failed_requests"),
            F.round(F.avg("latency_ms"), 6).alias("average_latency_ms"),
        )
        .withColumn("outcome_coverage", F.when(F.col("deployment_name") == "dep-4", "partial").otherwise("complete"))
    )


METRIC_BUCKETS_SQL = (
    REQUEST_TRACES_SQL
    + """,
buckets AS (
  SELECT deployment_name, model_name, CAST(floor(epoch(ts) / 300) * 300 AS BIGINT) AS bucket,
    CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
    count(*) AS requests, CAST(sum(CASE WHEN status_code < 400 THEN 1 ELSE 0 END) AS BIGINT) AS successful_requests,
    CAST(sum(CASE WHEN status_code = 429 THEN 1 ELSE 0 END) AS BIGINT) AS throttled_requests, CAST(sum(CASE WHEN status_code = 500 THEN 1 ELSE 0 END) AS BIGINT) AS failed_requests,
    round(avg(latency_ms), 6) AS average_latency_ms, CASE WHEN deployment_name = 'dep-4' THEN 'partial' ELSE 'complete' END AS outcome_coverage
  FROM traces GROUP BY ALL)"""
)


def conversation_traces(spark: SparkSession, folder: str) -> DataFrame:
    """One request for each conversation; ``messages`` are its turns with whole texts.

    Every other team (four conversations each) begins with its application's instructions, a benchmark item; the other
    teams have fingerprints of theirs instead.  One conversation in ten was sent twice.
    """
    c = table(spark, folder, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    ids = c.select("conv_id").distinct().where((F.floor(F.col("conv_id") / 4) % 2 == 0))
    items = table(spark, folder, "benchmark").select(F.col("item_id"), F.col("text"))
    told = ids.join(items, F.col("conv_id") % 5 == F.col("item_id")).select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"), "text")
    turns = c.unionByName(told).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"), F.sum(F.when(F.col("role") == "assistant", F.length("text"))).alias("said"))
    calls = F.when(F.col("conv_id") % 3 == 0, F.array(F.concat(F.lit("tool_"), F.col("conv_id") % 2))).otherwise(F.array().cast("array<string>"))
    messages = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"), F.lit(None).cast("string").alias("name"), F.when(t["role"] == "assistant", calls).alias("tool_calls")))
    number, team = F.col("conv_id"), F.floor(F.col("conv_id") / 4).cast("long")
    sent = turns.withColumn("copy", F.explode(F.when(number % 10 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    keyed = team % 2 == 1
    return sent.select(
        (number * 2 + F.col("copy")).alias("ingest_seq"),
        F.concat(F.lit("dep-"), number % 3).alias("deployment_name"),
        F.concat(F.lit("team-"), team).alias("team"),
        F.when(number % 2 == 0, "gpt-4.1-mini").otherwise("gpt-4.1").alias("model"),
        F.when(number % 7 == 0, "unknown").when(number % 2 == 0, "gpt-4.1-mini").otherwise("gpt-4.1").alias("model_name"),
        messages.alias("messages"),
        F.when(number % 2 == 0, F.array(F.lit("tool_0"), F.lit("tool_1"), F.concat(F.lit("tool_"), number % 5))).otherwise(F.array().cast("array<string>")).alias("tools"),
        F.concat(F.lit('[{"type": "function", "function": {"name":"tool_'), number % 5, F.lit('"}}]')).alias("tools_json"),
        F.when(number % 4 != 0, F.col("said") + 10).alias("input_tokens"),
        F.when(number % 5 != 0, F.coalesce(F.floor(F.col("said") / 4), F.lit(0))).cast("long").alias("output_tokens"),
        F.when(number % 3 != 0, 4000 + number % 10).cast("long").alias("max_output_tokens"),
        F.lit(None).cast("string").alias("retry_of"),
        F.when(number % 29 == 0, 1).otherwise(0).alias("retry_count"),
        F.when(number % 4 == 1, "Classify ticket").alias("task_type"),
        F.concat(F.lit("t"), number % 2).alias("tenant"),
        F.when(number % 3 == 0, "support").alias("workload"),
        F.lit(None).cast("string").alias("record_type"),
        F.when(keyed, F.concat(F.lit("hmac-sha256:"), team % 4)).alias("fingerprint"),
        F.when(keyed, 120 + team % 4).cast("long").alias("prefix_tokens"),
        F.array().cast("array<string>").alias("retrieved_chunks"),
    )


CONVERSATIONS_SQL = """
told AS (
  SELECT DISTINCT conv_id, CAST(-1 AS BIGINT) AS turn, 'system' AS role, b.text FROM conversations c JOIN benchmark b ON conv_id % 5 = item_id WHERE conv_id // 4 % 2 = 0),
turns AS (
  SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn, role, text) AS turns, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) END) AS BIGINT) AS said
  FROM (SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations UNION ALL SELECT * FROM told) GROUP BY conv_id),
sent AS (SELECT *, unnest(CASE WHEN conv_id % 10 = 3 THEN [0, 1] ELSE [0] END) AS copy FROM turns),
requests AS (
  SELECT conv_id * 2 + copy AS ingest_seq, 'dep-' || (conv_id % 3) AS deployment_name, 'team-' || (conv_id // 4) AS team, CASE WHEN conv_id % 2 = 0 THEN 'gpt-4.1-mini' ELSE 'gpt-4.1' END AS model,
    CASE WHEN conv_id % 7 = 0 THEN 'unknown' WHEN conv_id % 2 = 0 THEN 'gpt-4.1-mini' ELSE 'gpt-4.1' END AS model_name, turns,
    CASE WHEN conv_id % 2 = 0 THEN ['tool_0', 'tool_1', 'tool_' || (conv_id % 5)] ELSE CAST([] AS VARCHAR[]) END AS tools,
    CASE WHEN conv_id % 3 = 0 AND len(list_filter(turns, lambda t: t.role = 'assistant')) > 0 THEN ['tool_' || (conv_id % 2)] ELSE CAST([] AS VARCHAR[]) END AS called,
    strlen('[{"function": {"name": "tool_' || (conv_id % 5) || '"}, "type": "function"}]') AS tools_bytes,
    CASE WHEN conv_id % 4 <> 0 THEN said + 10 END AS input_tokens, CASE WHEN conv_id % 5 <> 0 THEN coalesce(said // 4, 0) END AS output_tokens,
    CASE WHEN conv_id % 3 <> 0 THEN 4000 + conv_id % 10 END AS max_output_tokens, CASE WHEN conv_id % 29 = 0 THEN 1 ELSE 0 END AS retry_count,
    CASE WHEN conv_id % 4 = 1 THEN 'Classify ticket' END AS task_type, 't' || (conv_id % 2) AS tenant, CASE WHEN conv_id % 3 = 0 THEN 'support' END AS workload,
    CASE WHEN conv_id // 4 % 2 = 1 THEN 'hmac-sha256:' || (conv_id // 4 % 4) END AS fingerprint, CASE WHEN conv_id // 4 % 2 = 1 THEN 120 + conv_id // 4 % 4 END AS prefix_tokens,
    CAST(list_sum(list_transform(turns, lambda t: 4 + strlen(t.role) + strlen(t.text))) + CASE WHEN len(turns) > 0 THEN 2 ELSE 0 END AS BIGINT) AS context
  FROM sent)"""
#: The same requests as one slice.
WHOLE_SQL = CONVERSATIONS_SQL.replace("'dep-' || (conv_id % 3) AS deployment_name", "'all' AS deployment_name")


def document_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """One request for every five documents, with every line of each as a retrieved chunk: a row a chunk, ``place`` orders a request's."""
    d = spread(table(spark, folder, "documents").select("doc_id", "text").where("doc_id is not null"))  # a document without an id is in no request
    number = F.floor(F.col("doc_id") / 5).cast("long")
    return (
        d.select(number.alias("ingest_seq"), F.concat(F.lit("dep-"), number % 4).alias("deployment_name"), "doc_id", F.xxhash64("text").alias("of"), F.posexplode_outer(F.split("text", "\n")).alias("line", "chunk"))
        .select("ingest_seq", "deployment_name", F.struct("doc_id", "of", "line").alias("place"), "chunk")
    )


CHUNKS_SQL = r"""
lines AS (
  SELECT doc_id // 5 AS ingest_seq, 'dep-' || (doc_id // 5 % 4) AS deployment_name, doc_id, unnest(string_split(text, chr(10))) AS chunk, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE doc_id IS NOT NULL),
worded AS (SELECT *, row_number() OVER (ORDER BY doc_id, line) AS place, strlen(chunk) AS n, list_distinct(regexp_extract_all(lower(chunk), '[a-z0-9]{3,}')) AS words FROM lines),
flat AS (SELECT ingest_seq, place, len(words) AS size, unnest(words) AS word FROM worded),
shared AS (SELECT a.ingest_seq, a.place AS x, b.place AS y, count(*) AS same, any_value(a.size) + any_value(b.size) AS sizes FROM flat a JOIN flat b ON a.ingest_seq = b.ingest_seq AND a.word = b.word AND a.place < b.place AND least(a.size, b.size) >= 0.85 * greatest(a.size, b.size) GROUP BY 1, 2, 3),
redundant AS (SELECT w.deployment_name, CAST(sum(w.n) AS BIGINT) AS total FROM shared s JOIN worded w ON w.place = s.y WHERE same / (sizes - same) >= 0.85 GROUP BY 1),
counts AS (SELECT deployment_name, count(DISTINCT ingest_seq) AS n FROM worded GROUP BY 1)"""


def task_events(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as tasks: lines are steps, suppliers attempts, the order's status its result, some orders are reviewed."""
    orders = table(spark, folder, "orders")
    lines = spread(table(spark, folder, "lineitem")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    key, number = F.col("o_orderkey"), F.col("l_linenumber")
    text, whole, double, flag = (F.lit(None).cast(t) for t in ("string", "long", "double", "boolean"))
    about = {"task_id": key.cast("string"), "task_type": F.col("o_orderpriority"), "execution_strategy": F.concat(F.lit("strategy-"), F.col("o_custkey") % 3), "strategy_version": F.concat(F.lit("v"), F.col("o_custkey") % 2), "workload": F.when(F.col("o_custkey") % 4 == 0, F.concat(F.lit("team "), F.col("o_custkey") % 3)), "provider": F.lit("azure_foundry"), "service_tier": F.lit("standard"), "deployment_mode": F.lit("global")}
    call = (F.col("l_suppkey") + number) % 4 != 0
    at = F.col("l_shipdate").cast("timestamp") + F.make_dt_interval(mins=number)
    step = {
        "event_type": F.when(call, "model_call").otherwise("tool_step"), "ts": at, "seq": number.cast("long"), "attempt_id": F.concat(F.lit("a"), F.col("l_suppkey") % 3), "step_index": number.cast("long"),
        "model_name": F.when(call, pick(["phi-4", "mai-thinking-1", "mai-ds-r1", "gpt-4.1"], F.col("l_partkey") % 4)), "input_tokens": F.when(call, F.round(F.col("l_quantity") * 100).cast("long")), "cached_tokens": F.when(call, F.when(F.col("l_partkey") % 4 == 1, F.round(F.col("l_quantity") * 10).cast("long")).otherwise(0).cast("long")),
        "output_tokens": F.when(call, F.round(F.col("l_quantity") * 20).cast("long")), "observed_cost_usd": F.when(~call & (F.col("l_discount") > 0.02), F.col("l_extendedprice") / 1_000_000), "context_length": F.when(call, F.round(F.col("l_quantity") * 100).cast("long")), "duration_ms": F.col("l_quantity") * 10,
        "outcome": text, "review_outcome": text, "escaped_error": flag, "policy_compliant": flag, "cleanup_cost_usd": double,
    }
    none = {"model_name": text, "input_tokens": whole, "cached_tokens": whole, "output_tokens": whole, "observed_cost_usd": double, "context_length": whole}
    end = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(days=F.lit(4000))
    result = {"event_type": F.lit("task_result"), "ts": end, "seq": F.lit(1000).cast("long"), "attempt_id": F.concat(F.lit("a"), key % 3), "step_index": whole, **none, "duration_ms": F.lit(5.0), "outcome": F.when(F.col("o_orderstatus") == "F", "solved").otherwise(F.when(key % 2 == 0, "failed").otherwise("abandoned")), "review_outcome": text, "escaped_error": flag, "policy_compliant": flag, "cleanup_cost_usd": double}
    review = {"event_type": F.lit("human_review"), "ts": end, "seq": F.lit(2000).cast("long"), "attempt_id": text, "step_index": whole, **none, "duration_ms": double, "outcome": text, "review_outcome": F.when(key % 8 == 0, "correct").otherwise("incorrect"), "escaped_error": F.when(key % 12 == 0, True).when(key % 16 == 0, False), "policy_compliant": F.when(key % 20 != 0, key % 28 != 0), "cleanup_cost_usd": F.when(key % 3 == 0, F.col("o_totalprice") / 10_000)}
    rows = lambda df, more: df.select(*[c.alias(n) for n, c in {**about, **more}.items()])
    closed = orders.where("o_orderstatus <> 'O'")
    out = rows(lines, step).unionByName(rows(closed, result)).unionByName(rows(closed.where(key % 4 == 0), review))
    return out.withColumn("event_id", F.concat_ws("/", "task_id", "event_type", "attempt_id", "step_index"))


MAPPINGS = [("wl-batch", "Batch jobs", "dedicated", ["dep-1"]), ("wl-load-2", "Work load 2", "shared", ["dep-2", "dep-9"]), ("wl-late", "Late jobs", "dedicated", ["dep-1"]), ("wl-none", "No traffic", "dedicated", ["dep-8", "dep-9"])]


def mappings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MAPPINGS, "id string, name string, allocation string, deployments array<string>").coalesce(1)
