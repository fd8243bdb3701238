"""Checks of event records, stored records and their identifiers: what is wrong, as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed

IDENTIFIERS = ("event_id", "task_id", "attempt_id")


def has_zone(stamp: Column) -> Column:
    """VAL2: whether a timestamp's text states its zone; null doesn't."""
    return F.coalesce(stamp.rlike(r"(?:[zZ]|[+-]\d\d:?\d\d)$"), F.lit(False))


def currency_shape(value: Column) -> Column:
    """VAL5: the currency in three upper-case letters, else null."""
    code = F.upper(F.trim(value))
    return F.when(code.rlike("^[A-Z]{3}$"), code)


def is_keyed(fingerprint: Column) -> Column:
    """VAL6: whether a fingerprint is keyed; null is none and passes."""
    return fingerprint.isNull() | F.startswith(fingerprint, F.lit(fixed.FINGERPRINT_PREFIX))


def stated_mode(mode: Column) -> Column:
    """VAL9: a mode that isn't stated stays ``unknown``; it is never taken for global."""
    return F.coalesce(F.when(F.trim(mode) != "", mode), F.lit("unknown"))


def broken_rules(identifiers: Sequence[str] = IDENTIFIERS) -> Column:
    """VAL1 to VAL3: the names of the rules that an event breaks.

    Needs the identifiers, stamp (the timestamp's text) and the five token counts; a missing count is zero.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    counts = ("input_tokens", "cached_tokens", "cache_write_tokens", "output_tokens", "reasoning_tokens")
    rules = [
        ("negative-usage", F.least(*map(n, counts)) < 0),
        ("cached-exceeds-input", n("cached_tokens") + n("cache_write_tokens") > n("input_tokens")),
        ("reasoning-exceeds-output", n("reasoning_tokens") > n("output_tokens")),
        ("timestamp-without-zone", ~has_zone(F.col("stamp"))),
        *[(f"newline-in-{c.replace('_', '-')}", F.coalesce(F.col(c).rlike("[\\r\\n]"), F.lit(False))) for c in identifiers],
    ]
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))


def event_problems(events: DataFrame) -> DataFrame:
    """(event_id, problem) for each rule that an event breaks."""
    return events.select("event_id", F.explode(broken_rules()).alias("problem"))


def valid_events(events: DataFrame, reject: bool = False) -> DataFrame:
    """Events that break no rule; with ``reject`` one that does raises an error."""
    good = F.size(broken_rules()) == 0
    if reject:
        error = F.raise_error(F.concat(F.lit("an event breaks the usage rules: "), F.coalesce("event_id", F.lit("?")))).cast("boolean")
        return events.where(F.when(good, F.lit(True)).otherwise(error))
    return events.where(good)


def forbidden_names(json: Column) -> Column:
    """PRJ19, VAL13: the forbidden names in a JSON text as ``to_json`` writes it, at any depth, each once; fails closed on null.

    One pass over the text's strings and brackets, with the depth as its only stack: what stands below a name in
    ``fixed.MEASUREMENT_PARTS`` is skipped until its bracket closes.  Escaped characters can't be part of a forbidden name,
    so they are blanked before strings are told apart.
    """
    tokens = F.regexp_extract_all(F.regexp_replace(json, r"\\.", "~"), F.lit(r'"[^"]*":?|[{}\[\]]'), F.lit(0))
    none = F.lit(-1)

    def step(s: Column, t: Column) -> Column:
        opens, closes, names = t.isin("{", "["), t.isin("}", "]"), F.endswith(t, F.lit('":'))
        name, skipped = F.substring(t, F.lit(2), F.char_length(t) - 3), s["skip"] >= 0
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        skip = F.when(skipped, F.when(closes & (depth == s["skip"]), none).otherwise(s["skip"])).when(opens & s["measures"], s["depth"]).otherwise(none)
        measures = ~skipped & names & name.isin(*fixed.MEASUREMENT_PARTS)
        bad = ~skipped & names & name.isin(*fixed.FORBIDDEN_KEYS) & ~F.array_contains(s["found"], name)
        return F.struct(depth.alias("depth"), skip.alias("skip"), measures.alias("measures"), F.when(bad, F.array_append(s["found"], name)).otherwise(s["found"]).alias("found"))

    start = F.struct(F.lit(0).alias("depth"), none.alias("skip"), F.lit(False).alias("measures"), F.array().cast("array<string>").alias("found"))
    return F.when(json.isNull(), F.array(F.lit("not a record"))).otherwise(F.aggregate(tokens, start, step, lambda s: s["found"]))


def forbidden_keys(records: DataFrame, key: str) -> DataFrame:
    """PRJ19, VAL13: (key, found) for each forbidden name at any level of the variant ``v``, in one pass over the records.

    Names below ``fixed.MEASUREMENT_PARTS`` name measurements and aren't looked at; a null record is ``not a record``.
    """
    return records.select(F.col(key).alias("id"), F.explode(forbidden_names(F.to_json("v"))).alias("found"))


def keyed_fingerprint(value: Column, key: bytes | None) -> Column:
    """HLP34: HMAC-SHA-256 of a text, by the hash's definition; null without a key or a text."""
    if not key:
        return F.lit(None).cast("string")
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in block))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), value.cast("binary")), 256))
    return F.when(value != "", F.concat(F.lit(fixed.FINGERPRINT_PREFIX), F.sha2(F.concat(pad(0x5C), inner), 256)))
