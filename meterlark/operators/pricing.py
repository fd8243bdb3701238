"""Pricing of traces against dated catalogs.

Prices of a catalog become one row for each (provider, model or alias, tier) with its candidates in order of
preference.  A trace meets that row by an equi-join and takes the first candidate whose region, dates and context band
fit, within the row: no shuffle of traces and no ranking window.  A catalog is broadcast only while it is small
(``BROADCAST_ROWS``); a larger one is joined by Spark's choice.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import canonical_model, publisher_of_name

PRICE = "provider string, publisher string, model string, aliases array<string>, service_tier string, region string, effective_from date, effective_to date, context_min long, context_max long, context_window string, billing_basis string, confidence string, source_rank int, assumed array<string>, input_rate double, cached_rate double, write_rate double, output_rate double"
BROADCAST_ROWS = 50_000
NAME = "pm_name"  # the canonical model name, computed once a row


@dataclass
class Catalog:
    """Prices with what holds for all of them; ``kind`` is ``customer`` or ``reference``."""

    name: str
    kind: str
    prices: DataFrame
    currency: str = "USD"
    basis: str = "effective_period"
    retrieved_at: str | None = None
    rows: int | None = None

    def size(self) -> int:
        """Prices, counted once (and no further than the bound of a broadcast)."""
        if self.rows is None:
            self.rows = self.prices.limit(BROADCAST_ROWS + 1).count()
        return self.rows


def price_rows(spark: SparkSession, entries: Iterable[dict]) -> DataFrame:
    """Prices from dicts; what is left out takes its default."""
    from datetime import date

    as_date = lambda x: date.fromisoformat(x) if isinstance(x, str) else x
    rows = [
        (
            e.get("provider", fixed.PROVIDER), e.get("publisher", ""), e["model"], e.get("aliases", []), e.get("service_tier", "standard"), e.get("region"),
            as_date(e["effective_from"]), as_date(e.get("effective_to")), e.get("context_min"), e.get("context_max"), e.get("context_window"), e.get("billing_basis", "token_rate"),
            e.get("confidence", "verified"), e.get("source_rank", 100), e.get("assumed", []), float(e["input_rate"]), e.get("cached_rate"), float(e.get("write_rate", 0.0)), float(e["output_rate"]),
        )
        for e in entries
    ]
    return spark.createDataFrame(rows, PRICE)


def reference_catalog(spark: SparkSession) -> Catalog:
    """The dated catalog that ships with the library."""
    facts = fixed.REFERENCE_CATALOG
    entries = [{"model": m, "region": r, "effective_from": facts["retrieved_at"], "input_rate": i, "cached_rate": c, "output_rate": o} for m, r, i, c, o in fixed.REFERENCE_PRICES]
    return Catalog(facts["name"], "reference", price_rows(spark, entries), facts["currency"], facts["basis"], facts["retrieved_at"], len(entries))


def candidates(prices: DataFrame) -> DataFrame:
    """(p_provider, p_model, p_tier, found): candidates in order: literal name before alias, source rank, bounded context first, latest start, as listed."""
    names = F.concat(F.array(F.struct(canonical_model(F.col("model")).alias("name"), F.lit(0).alias("match"))), F.transform("aliases", lambda a: F.struct(canonical_model(a).alias("name"), F.lit(1).alias("match"))))
    bounded = F.when(F.col("context_min").isNotNull() | F.col("context_max").isNotNull(), 0).otherwise(1)
    listed = prices.withColumn("listed", F.monotonically_increasing_id())
    flat = listed.select("*", F.explode(names).alias("n")).select("*", "n.name", "n.match")
    order = [F.col("match"), F.col("source_rank"), bounded.alias("bounded"), (-F.datediff("effective_from", F.lit("1970-01-01").cast("date"))).alias("recent"), F.col("listed")]
    kept = ["region", "effective_from", "effective_to", "context_min", "context_max", "context_window", "publisher", "billing_basis", "confidence", "assumed", "input_rate", "cached_rate", "write_rate", "output_rate"]
    return flat.groupBy(F.lower("provider").alias("p_provider"), F.col("name").alias("p_model"), F.lower("service_tier").alias("p_tier")).agg(F.array_sort(F.collect_list(F.struct(*order, *kept))).alias("found"))


def with_price(traces: DataFrame, catalog: Catalog, out: str, when: Column, context: Column) -> DataFrame:
    """``traces`` with the price entry that fits as struct ``out``, or null.  Needs provider, model_name, service_tier, deployment_mode."""
    priced_at = F.lit(catalog.retrieved_at).cast("date") if catalog.basis == "analysis_date_snapshot" and catalog.retrieved_at else F.to_date(when)
    length = F.coalesce(context, F.lit(0))

    def fits(c: Column) -> Column:
        region = c["region"].isNull() | (F.lower(c["region"]) == F.lower(F.coalesce(F.col("deployment_mode"), F.lit(""))))
        dates = (priced_at >= c["effective_from"]) & (c["effective_to"].isNull() | (priced_at <= c["effective_to"]))
        band = (c["context_min"].isNull() | (length >= c["context_min"])) & (c["context_max"].isNull() | (length <= c["context_max"]))
        return region & dates & band

    table = candidates(catalog.prices)
    if catalog.size() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    named = traces if NAME in traces.columns else traces.withColumn(NAME, canonical_model(F.col("model_name")))
    keys = (F.lower(F.col("provider")) == F.col("p_provider")) & (F.col(NAME) == F.col("p_model")) & (F.lower(F.col("service_tier")) == F.col("p_tier"))
    priced = named.join(table, keys, "left").withColumn(out, F.get(F.filter("found", fits), F.lit(0))).drop("p_provider", "p_model", "p_tier", "found")
    return priced if named is traces else priced.drop(NAME)


OBSERVED, LACKING, NO_PRICE, NO_CACHED_RATE, PRICED = range(5)


def resolve(rows: DataFrame, catalogs: list[Catalog], currency: str, readings: dict[str, Column], buckets: bool = False, fields: Sequence[str] = ()) -> DataFrame:
    """``rows`` (see ``with_price``: columns price_0, ...) with a struct for each reading of cached input: what a trace costs and why not.

    An observed cost goes first; then usage must be complete; then the first catalog of the currency that has an entry
    decides, even if that entry can't price cached input; an entry in another currency only gives the reason.  What the
    structs share (canonical name, publisher, the entry that decides, the state) are columns that are computed once a row.
    """
    dollars = currency.upper() == "USD"
    mine = [(i, c) for i, c in enumerate(catalogs) if c.currency.upper() == currency.upper()]
    foreign = [F.col(f"price_{i}").isNotNull() for i, c in enumerate(catalogs) if c.currency.upper() != currency.upper()]
    none, text, number = F.array().cast("array<string>"), F.lit(None).cast("string"), F.lit(None).cast("double")
    observed, given, made = F.col("observed_cost_usd"), F.col("input_tokens"), F.col("output_tokens")
    chain: Column | None = None
    for i, c in mine:
        entry = F.col(f"price_{i}")
        assumed = entry["assumed"] if not buckets else F.array_sort(F.array_distinct(F.concat(entry["assumed"], F.when(entry["context_window"].isNotNull(), F.array(F.concat(F.lit("context="), entry["context_window"]))).otherwise(none))))
        hit = F.struct(F.lit(c.kind).alias("kind"), F.lit(c.name).alias("catalog"), assumed.alias("assumed"), *[entry[n].alias(n) for n in ("effective_from", "billing_basis", "confidence", "publisher", "input_rate", "cached_rate", "output_rate")])
        chain = F.when(entry.isNotNull(), hit) if chain is None else chain.when(entry.isNotNull(), hit)
    empty = F.lit(None).cast("struct<kind:string,catalog:string,assumed:array<string>,effective_from:date,billing_basis:string,confidence:string,publisher:string,input_rate:double,cached_rate:double,output_rate:double>")
    out = rows.withColumns({"pm_hit": empty if chain is None else chain, "pm_foreign": reduce(lambda a, b: a | b, foreign, F.lit(False)), "pm_publisher": publisher_of_name(F.col(NAME))})
    states = {}
    for name, cached in readings.items():
        lacks = given.isNull() | cached.isNull() | made.isNull()
        states[f"pm_{name}"] = F.when(observed.isNotNull(), OBSERVED).when(lacks, LACKING).when(F.col("pm_hit").isNull(), NO_PRICE).when((cached != 0) & F.col("pm_hit.cached_rate").isNull(), NO_CACHED_RATE).otherwise(PRICED)
    out = out.withColumns(states)
    h = lambda n: F.col(f"pm_hit.{n}")
    for name, cached in readings.items():
        s = F.col(f"pm_{name}")
        is_ = lambda *v, s=s: s.isin(*v)
        priced = is_(PRICED)
        parts = [F.when(priced, (given - cached) * h("input_rate") / 1_000_000), F.when(priced, cached * F.coalesce(h("cached_rate"), F.lit(0.0)) / 1_000_000), F.when(priced, made * h("output_rate") / 1_000_000)]
        seen = is_(OBSERVED) if dollars else F.lit(False)
        missing = F.concat_ws(",", F.when(given.isNull(), "input_tokens"), F.when(cached.isNull(), "cached_tokens"), F.when(made.isNull(), "output_tokens"))
        no_price = F.when(F.col("pm_foreign"), "currency-conversion-required").otherwise("no-exact-model-mode-price")
        own_publisher = F.when(h("publisher") != "", h("publisher"))
        columns = {
            "resolved": priced | seen,
            "cost_usd": F.when(seen, observed).when(priced, parts[0] + parts[1] + parts[2]).cast("double"),
            "source": F.when(seen, "observed").when(priced, h("kind")).otherwise("unresolved"),
            "fresh_cost": parts[0],
            "cached_cost": parts[1],
            "output_cost": parts[2],
            "reason": F.when(is_(LACKING), F.concat(F.lit("usage-metrics-unavailable:"), missing)).when(is_(NO_PRICE), no_price).when(is_(NO_CACHED_RATE), "cached-input-rate-unavailable").when(is_(OBSERVED), text if dollars else F.lit("currency-conversion-required")),
            "override_key": F.when(is_(LACKING, NO_PRICE), F.col(NAME)),
            "catalog": F.when(is_(PRICED, NO_CACHED_RATE), h("catalog")),
            "effective_from": F.when(priced, h("effective_from").cast("string")),
            "billing_basis": F.when(seen, "observed_cost").when(is_(PRICED, NO_CACHED_RATE), h("billing_basis")),
            "confidence": F.when(seen, "observed").when(priced, h("confidence")),
            "publisher": F.when(is_(PRICED, NO_CACHED_RATE), own_publisher).when(seen | is_(LACKING, NO_PRICE), F.col("pm_publisher")),
            "input_rate": F.when(priced, h("input_rate")),
            "cached_rate": F.when(priced, h("cached_rate")),
            "output_rate": F.when(priced, h("output_rate")),
            "assumed": F.when(priced, h("assumed")).otherwise(none),
        }
        out = out.withColumn(name, F.struct(*[c.alias(n) for n, c in columns.items() if not fields or n in fields]))
    return out.drop("pm_hit", "pm_foreign", "pm_publisher", *states)


def price_traces(traces: DataFrame, catalogs: list[Catalog], currency: str = "USD", when: Column | None = None, buckets: bool = False) -> DataFrame:
    """``traces`` with ``cost`` (see ``resolve``) and ``cost_no_cache``, the same with unmeasured cached input taken as zero."""
    out, context = traces.withColumn(NAME, canonical_model(F.col("model_name"))), F.lit(None).cast("long") if buckets else F.col("input_tokens")
    for i, c in enumerate(catalogs):
        out = with_price(out, c, f"price_{i}", F.col("ts") if when is None else F.coalesce(F.col("ts"), when), context)
    out = resolve(out, catalogs, currency, {"cost": F.col("cached_tokens"), "cost_no_cache": F.coalesce(F.col("cached_tokens"), F.lit(0))}, buckets)
    return out.drop(NAME, *[f"price_{i}" for i in range(len(catalogs))])
