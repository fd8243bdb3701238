"""Names, slugs and other text rules as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import PUBLISHER_PREFIXES


def canonical_model(name: Column) -> Column:
    """Trimmed, lower-cased, white space and underscores to single hyphens."""
    return F.regexp_replace(F.lower(F.trim(name)), r"[\s_-]+", "-")


def publisher_of(model: Column) -> Column:
    """Publisher by the first fitting prefix of the canonical name; null if none fits."""
    return publisher_of_name(canonical_model(model))


def publisher_of_name(name: Column) -> Column:
    """The same for a name that is canonical already."""
    return reduce(lambda rest, rule: F.when(F.startswith(name, F.lit(rule[0])), F.lit(rule[1])).otherwise(rest), reversed(PUBLISHER_PREFIXES), F.lit(None).cast("string"))


def known_model(model: Column) -> Column:
    """Whether a model is named at all; null counts as not named."""
    return ~F.lower(F.trim(F.coalesce(model, F.lit("")))).isin("", "unknown", "none")


def workload_slug(label: Column) -> Column:
    """Lower-cased runs of letters and digits joined by hyphens; ``unknown`` if nothing is left."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(label, F.lit("")))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", F.lit("unknown")).otherwise(slug)


def deployment_workload(deployment: Column) -> Column:
    """Workload id of a deployment without a label."""
    return F.concat(F.lit("deployment:"), workload_slug(deployment))


def status_class(code: Column) -> Column:
    """``rate_limited`` for 429, ``success`` for 200 to 399, else ``failed``; null stays null."""
    return F.when(code == 429, "rate_limited").when(code.between(200, 399), "success").when(code.isNotNull(), "failed")


def sampled(key: Column, rate: float) -> Column:
    """Deterministic sampling: the first 8 bytes of the key's SHA-256, as a fraction of 2**64, are below the rate."""
    high = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    low = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 9, 8), 16, 10).cast("double")
    return (high * 4294967296.0 + low) / 18446744073709551616.0 < F.lit(rate)


def word_hashes_of(text: Column) -> Column:
    """Hashes of the distinct words of three or more ASCII letters and digits of the lower-cased text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), 0), lambda w: F.xxhash64(w)))


def first_filled(*values: Column) -> Column:
    """First value that is neither null nor empty text."""
    return F.coalesce(*[F.when(v.cast("string") != "", v) for v in values])


def one_or_mixed(value: Column) -> Column:
    """Aggregate: the only non-null value, ``mixed`` if there are several, null if there is none.  Partial aggregation holds two values."""
    low, high = F.min(value), F.max(value)
    return F.when(low == high, low).when(low.isNotNull(), F.lit("mixed"))


def only_value(value: Column) -> Column:
    """Aggregate: the only non-null value, else null."""
    return F.when(F.min(value) == F.max(value), F.min(value))
