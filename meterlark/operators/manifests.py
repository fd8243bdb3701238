"""What a collection or an import has brought: coverage by field, counts, and the rest of a report's findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .buckets import is_active
from .rules import finding_order

FIELDS = ["input_tokens", "cached_tokens", "output_tokens", "requests", "successful_requests", "throttled_requests", "failed_requests", "average_latency_ms"]


def field_coverage(buckets: DataFrame, keys: Sequence[str], start: int, end: int, minutes: int = 5, fields: Sequence[str] = FIELDS) -> DataFrame:
    """AGG32: (keys, field, points_reported, expected_points, percent, state) of buckets in the window from ``start`` to ``end`` (epoch seconds).

    A field that no bucket of a deployment has isn't listed.
    """
    expected = max(0, end - start) // (minutes * 60)
    rows = buckets.where((F.col("bucket") >= start) & (F.col("bucket") < end))
    counts = rows.groupBy(*keys).agg(*[F.count(f).alias(f) for f in fields])
    flat = counts.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("points_reported")) for f in fields])).alias("x")).select(*keys, "x.*").where("points_reported > 0")
    percent = F.round(F.least(F.lit(100.0), F.col("points_reported") / F.lit(max(expected, 1)) * 100), 1) if expected else F.lit(0.0)
    state = F.when(F.lit(expected > 0) & (F.col("points_reported") >= expected), "complete").otherwise("partial")
    return flat.select(*keys, "field", "points_reported", F.lit(expected).cast("long").alias("expected_points"), percent.alias("percent"), state.alias("state"))


def deployment_manifest(buckets: DataFrame, keys: Sequence[str], start: int, end: int, minutes: int = 5) -> DataFrame:
    """AGG32: by ``keys`` expected, observed and active buckets of the window, and its returned span in epoch seconds."""
    seconds = minutes * 60
    rows = buckets.where((F.col("bucket") >= start) & (F.col("bucket") < end))
    return rows.groupBy(*keys).agg(
        F.lit(max(0, end - start) // seconds).cast("long").alias("expected_buckets"),
        F.count_distinct("bucket").alias("observed_buckets"),
        F.count_if(is_active()).alias("active_buckets"),
        F.count_distinct(F.floor(F.col("bucket") / 86400)).alias("observed_days"),
        F.min("bucket").alias("returned_start"),
        (F.max("bucket") + seconds).alias("returned_end"),
    )


def collection_summary(buckets: DataFrame, expected: int) -> DataFrame:
    """AGG43: buckets, active buckets and outcome coverage of a whole collection; without any bucket coverage is ``unavailable``."""
    state = F.coalesce("outcome_coverage", F.lit("unavailable"))
    complete = F.bool_or(state == "complete")
    coverage = F.when(F.count(F.lit(1)) == 0, "unavailable").when(F.bool_and(state == "complete"), "complete").when(complete, "partial").otherwise("unavailable")
    return buckets.agg(F.count(F.lit(1)).alias("buckets"), F.count_if(is_active()).alias("active_buckets"), F.lit(expected).cast("long").alias("expected_buckets"), F.coalesce(coverage, F.lit("unavailable")).alias("outcome_coverage"))


def request_manifest(seen: DataFrame, mapped: DataFrame, key: str = "event_id") -> DataFrame:
    """AGG35: records seen, mapped, skipped and repeated, and the span of the mapped ones."""
    counted = mapped.agg(F.count(F.lit(1)).alias("records_mapped"), (F.count(key) - F.count_distinct(key)).alias("duplicates_skipped"), F.min("ts").alias("requested_start"), F.max("ts").alias("requested_end"))
    both = seen.agg(F.count(F.lit(1)).alias("records_seen")).crossJoin(counted)  # one row each
    return both.select("records_seen", "records_mapped", (F.col("records_seen") - F.col("records_mapped")).alias("records_skipped"), "duplicates_skipped", "requested_start", "requested_end")


def capped(records: DataFrame, max_rows: int, order: str = "ingest_seq") -> tuple[DataFrame, bool]:
    """SRT9: the first ``max_rows`` records in order, and whether there are more; a cap that isn't reached costs no sort."""
    more = records.limit(max_rows + 1).count() > max_rows
    return (records.orderBy(order).limit(max_rows), True) if more else (records, False)


# Findings


def impact_category(findings: DataFrame) -> DataFrame:
    """TLCAT: ``findings`` (see ``rules.with_impact``) with the category of their impact."""
    most, size = F.col("impact_max_percent"), F.coalesce(F.nullif(F.col("max_savings"), F.lit(0)), F.col("min_savings"), F.lit(0))
    tokens = F.col("rule_id") != "TL007"
    category = F.when(most.isNull(), "Evaluation opportunity").when(tokens & (size < 1000), "Low absolute volume").when(most >= 10, "Major").when(most >= 5, "High").when(most >= 1, "Moderate").otherwise("Low materiality")
    return findings.withColumn("impact_category", category)


def immaterial_findings(findings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """SRT4: what isn't material, in the order of findings (``place``)."""
    return findings.where("not material").withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*finding_order())))


def top_recommendations(findings: DataFrame, service: str, keys: Sequence[str] = (), n: int = 3) -> DataFrame:
    """SRT5: the first findings in order, one for each value of ``service``."""
    order = finding_order()
    one = findings.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, service).orderBy(*order))).where("nth = 1").drop("nth")
    return one.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def largest_opportunity(findings: DataFrame, totals: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """AGG26: the largest single saving of tokens, no more than the input; findings overlap, so they are never added up.

    ``totals`` has keys and input_tokens; the first finding in rule order wins among equals.
    """
    tokens = findings.where("rule_id <> 'TL007' and min_savings is not null")
    best = tokens.groupBy(*keys).agg(F.min_by(F.struct("min_savings", "max_savings"), F.struct((-F.coalesce("max_savings", "min_savings")).alias("m"), "rule_id")).alias("b"))
    rows = totals.join(best, list(keys), "left") if keys else totals.crossJoin(best)  # without keys both have one row
    top = F.coalesce("input_tokens", F.lit(0))
    least = F.least(F.coalesce(F.col("b.min_savings"), F.lit(0)), top)
    most = F.least(F.coalesce(F.col("b.max_savings"), least), top)
    return rows.select(*keys, least.alias("addressable_min_tokens"), F.greatest(least, most).alias("addressable_max_tokens"), F.round(F.greatest(least, most) / F.greatest(F.lit(1), top) * 100, 1).alias("addressable_max_percent"))


def compared(baseline: DataFrame, candidate: DataFrame, keys: Sequence[str], fail_at: float | None = None) -> DataFrame:
    """Regression compare of two ``largest_opportunity`` results: change in percentage points, and whether it is a regression."""
    b, c = (d.select(*keys, F.col("addressable_max_percent").alias(n)) for d, n in ((baseline, "baseline_percent"), (candidate, "candidate_percent")))
    both = c.join(b, list(keys), "full_outer").fillna(0.0, ["baseline_percent", "candidate_percent"]) if keys else c.crossJoin(b)  # without keys both have one row
    delta = F.round(F.col("candidate_percent") - F.col("baseline_percent"), 1)
    return both.withColumns({"change_points": delta, "regression": delta > F.lit(fail_at) if fail_at is not None else F.lit(False)})
