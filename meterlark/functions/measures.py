"""Measures that keep "not measured" apart from zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def state_of(value: Column) -> Column:
    """Aggregate: ``unavailable`` if no row has the value, ``partial`` if some lack it, else ``measured``."""
    return F.when(F.count(value) == 0, "unavailable").when(F.count(value) < F.count(F.lit(1)), "partial").otherwise("measured")


def total_state(input_state: Column, output_state: Column) -> Column:
    """State of input and output together."""
    both = input_state == output_state
    return F.when(both & (input_state == "unavailable"), "unavailable").when(both & (input_state == "measured"), "measured").otherwise("partial")


def total_of(input_tokens: Column, output_tokens: Column) -> Column:
    """Sum of what is known; null if neither is."""
    return F.when(input_tokens.isNotNull() | output_tokens.isNotNull(), F.coalesce(input_tokens, F.lit(0)) + F.coalesce(output_tokens, F.lit(0)))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Share in percent; a whole below 1 counts as 1."""
    return F.round(part / F.greatest(whole, F.lit(1)) * 100, digits)


def merged_state(state: Column) -> Column:
    """Aggregate: the states' common value, else ``partial``."""
    return F.when(F.min(state) == F.max(state), F.min(state)).otherwise("partial")
