"""De-duplication and validation of record and event streams, as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sinks.tables import written


def dedupe_records(records: DataFrame, key: str = "event_id", order: str = "ingest_seq") -> DataFrame:
    """WIN1: the first row of each key; rows without a key are all kept (and kept out of the window, so they crowd no task)."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(order))
    keyed = records.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).withColumn("nth", first).where("nth = 1").drop("nth")
    return keyed.unionByName(records.where(F.col(key).isNull() | (F.col(key).cast("string") == "")))


def stream_key() -> Column:
    """Key of the pull stream: request id, else event id, else time, deployment and model."""
    filled = lambda c: F.when(F.col(c).cast("string") != "", F.col(c).cast("string"))
    rest = F.concat_ws("|", F.coalesce(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("None")), F.coalesce("deployment_name", F.lit("None")), F.coalesce("model_name", F.lit("None")))
    return F.coalesce(filled("request_id"), filled("event_id"), rest)


def stream_dedupe(records: DataFrame, max_records: int | None = None, order: str = "ingest_seq") -> DataFrame:
    """SRC4: the first row of each stream key, and the first ``max_records`` of those in order."""
    first = F.row_number().over(Window.partitionBy("stream_key").orderBy(order))
    out = records.withColumn("stream_key", stream_key()).withColumn("nth", first).where("nth = 1").drop("nth")
    return out.orderBy(order).limit(max_records) if max_records else out


def stream_violations(events: DataFrame) -> DataFrame:
    """WIN3 to WIN6, J22: (rule, subject) of what makes an event stream invalid.

    Needs event_id, event_type, ts, task_id, task_type, execution_strategy, strategy_version, attempt_id, step_index, outcome, payload.
    Events are derived and brought together by id once, and written; every rule reads what is left.
    """
    said = lambda rule, df, subject: df.select(F.lit(rule).alias("rule"), F.col(subject).cast("string").alias("subject"))
    about, rest = ["task_type", "execution_strategy", "strategy_version"], ["event_type", "ts", "task_id", "attempt_id", "step_index", "outcome"]
    # ids are put in order by a number first, which compares faster than long ids that begin alike
    once = events.groupBy(F.xxhash64("event_id").alias("place"), "event_id").agg((F.min("payload") != F.max("payload")).alias("torn"), F.min(F.struct(*rest, *about)).alias("e"))
    unique = written(once.select("event_id", "torn", "e.*"), "events-once")
    # a task has few sets of metadata, which are counted by hash; only those are compared
    sets = unique.groupBy("task_id", *about).agg(F.bool_or(F.col("event_type") != "human_review").alias("known"))
    differs = [F.min(c) != F.max(c) for c in about]
    tasks = sets.groupBy("task_id").agg((differs[0] | differs[1] | differs[2]).alias("differs"), F.bool_or("known").alias("known"))
    faults = F.array_compact(F.array(F.when(F.col("differs"), F.lit("conflicting-metadata")), F.when(~F.col("known"), F.lit("review-of-unknown-task"))))
    tasks = tasks.where("differs or not known").select(F.explode(faults).alias("rule"), F.col("task_id").cast("string").alias("subject"))
    steps = unique.where(F.col("event_type").isin("model_call", "tool_step"))
    lost = steps.where("attempt_id is null")
    again = steps.where("attempt_id is not null").groupBy("task_id", "attempt_id", "step_index").count().where("count > 1").select("task_id").distinct()
    turn = Window.partitionBy("task_id").orderBy("ts", "event_id")
    results = unique.where("event_type = 'task_result'").withColumn("before", F.lag("outcome").over(turn)).where("before = 'solved' and outcome <> 'solved'").select("task_id").distinct()
    parts = [("conflicting-duplicate", unique.where("torn"), "event_id"), ("missing-attempt", lost, "event_id"), ("duplicate-step", again, "task_id"), ("conflicting-outcome", results, "task_id")]
    out = tasks
    for p in parts:
        out = out.unionByName(said(*p))
    return out


def attempt_outcomes(events: DataFrame) -> DataFrame:
    """Attempts whose results disagree."""
    return events.where("event_type = 'task_result'").groupBy("task_id", "attempt_id").agg((F.min("outcome") != F.max("outcome")).alias("bad")).where("bad").select("task_id", "attempt_id")
