"""Price sources: retail meters, published tables, imported billing rows, and their layers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import fixed
from ..functions.text import canonical_model

ITEM = "struct<currencyCode:string,meterId:string,meterName:string,skuName:string,armSkuName:string,productName:string,serviceName:string,unitOfMeasure:string,type:string,armRegionName:string,retailPrice:double,unitPrice:double,tierMinimumUnits:double,effectiveStartDate:string,reservationTerm:string,isPrimaryMeterRegion:boolean>"
SERVICE = "foundry models"


def retail_rows(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """SRC25, SRC26: the rows of retail feed pages ({Items: [...]}); bad rows are dropped."""
    pages = spark.read.schema(f"Items array<{ITEM}>").option("multiLine", True).json(paths if isinstance(paths, str) else list(paths))
    rows = pages.select(F.explode("Items").alias("i")).select("i.*")
    return rows.where(F.col("meterName").isNotNull() & F.col("retailPrice").isNotNull())


def label_tokens(label: Column) -> Column:
    """Lower-cased words of a meter label; hyphenated words split, decimals stay."""
    return F.filter(F.split(F.lower(F.coalesce(label, F.lit(""))), r"[^a-z0-9.]+"), lambda t: t != "")


def units_per_measure(unit: Column) -> Column:
    """CST5: 1K, 1M, 100 (optionally with the word tokens) as a number of units; anything else is null."""
    number = F.regexp_extract(unit, r"(?i)^\s*(\d+(?:\.\d+)?)\s*([km]?)(?:\s*tokens?)?\s*$", 1)
    scale = F.lower(F.regexp_extract(unit, r"(?i)^\s*(\d+(?:\.\d+)?)\s*([km]?)(?:\s*tokens?)?\s*$", 2))
    value = number.try_cast("double") * F.when(scale == "k", 1_000.0).when(scale == "m", 1_000_000.0).otherwise(1.0)
    return F.when(value > 0, value)


def per_million(price: Column, unit: Column) -> Column:
    """CST6."""
    return price * 1_000_000 / units_per_measure(unit)


def longest_labels(names: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """J16: (t, m) for each name's words ``t`` with the longest label that begins them: ``m`` has n (words of the label), model, publisher; names without one are left out.

    Names are different from each other; their beginnings meet labels by equality, so neither side is compared in pairs.
    """
    labels = crosswalk.select("model", "publisher", label_tokens(F.col("label")).alias("l")).where(F.size("l") > 0)
    longest = labels.agg(F.max(F.size("l"))).first()[0] or 0
    upto = F.sequence(F.lit(1), F.least(F.size("t"), F.lit(longest)))
    begins = names.where((F.size("t") > 0) & F.lit(longest > 0)).select("t", F.explode(F.transform(upto, lambda n: F.slice("t", F.lit(1), n))).alias("l"))
    return begins.join(labels, "l").groupBy("t").agg(F.max(F.struct(F.size("l").alias("n"), "model", "publisher")).alias("m"))


def crosswalk_models(asked: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """J17: ``asked`` (name) with the crosswalk's model, publisher and label for a model or one of its aliases; null for none.

    ``crosswalk``: (model, publisher, label, aliases).  A model's own name goes before another's alias, then the smaller model.
    """
    names = F.concat(F.array(F.struct(F.lit(0).alias("rank"), F.col("model").alias("as"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(F.lit(1).alias("rank"), a.alias("as"))))
    known = crosswalk.select("model", "publisher", "label", F.explode(names).alias("n")).select(canonical_model(F.col("n.as")).alias("key"), F.struct("n.rank", "model", "publisher", "label").alias("to"))
    best = known.where("key <> ''").groupBy("key").agg(F.min("to").alias("to"))
    return asked.withColumn("key", canonical_model(F.col("name"))).join(best, "key", "left").select(*asked.columns, "to.model", "to.publisher", "to.label")


def parse_meters(rows: DataFrame, crosswalk: DataFrame, assumed_deployment: str = "global", assumed_context: str = "short") -> DataFrame:
    """FLT15, J16: each retail row with its model and dimension, or the first reason that excludes it.

    ``crosswalk``: (model, publisher, label), of any size; the longest label that begins a meter's name wins.
    """
    excluded = fixed.METER_EXCLUDED
    known = [*fixed.METER_WORDS, *excluded]
    rows = rows.withColumn("t", label_tokens(F.col("meterName")))
    names = rows.select("t").distinct()
    rows = rows.join(longest_labels(names, crosswalk), "t", "left")
    rows = rows.withColumn("rest", F.when(F.col("m").isNotNull(), F.slice("t", F.col("m.n") + 1, F.greatest(F.size("t"), F.lit(1)))))
    has = lambda kind: F.arrays_overlap("rest", F.array(*[F.lit(w) for w, k in fixed.METER_WORDS.items() if k == kind]))
    every = F.concat("t", label_tokens(F.col("skuName")), label_tokens(F.col("armSkuName")))
    reason_of = F.create_map(*[F.lit(x) for pair in excluded.items() for x in pair])
    barred = F.get(F.filter(F.transform(every, lambda w: F.element_at(reason_of, w)), lambda r: r.isNotNull()), F.lit(0))
    strange = F.array_sort(F.array_distinct(F.filter("rest", lambda w: ~w.isin(*known))))
    stated = F.filter(F.array(*[F.when(has(d), F.lit(d)) for d in ("global", "data_zone", "regional")]), lambda d: d.isNotNull())
    dimension = F.when(has("cache") & has("write"), "cache_write").when(has("cache") & has("input"), "cached_input").when(has("output") & ~has("input"), "output").when(has("input") & ~has("output"), "input")
    rate = per_million(F.col("retailPrice"), F.col("unitOfMeasure"))
    tests = [
        (F.lower(F.coalesce("serviceName", F.lit(""))).isin("", SERVICE), "not-foundry-service"),
        (F.coalesce("reservationTerm", F.lit("")) == "", "reservation-meter"),
        (F.lower(F.coalesce("type", F.lit(""))) == "consumption", "non-consumption-meter"),
        (F.coalesce("tierMinimumUnits", F.lit(0.0)) == 0, "tiered-meter"),
        (F.coalesce(F.try_element_at("t", F.lit(-1)), F.lit("")).isin("token", "tokens"), "non-token-meter"),
        (F.col("m").isNotNull(), "model-not-in-crosswalk"),
        (barred.isNull(), F.concat(F.lit("excluded-"), barred)),
        (F.size(strange) == 0, "unrecognized-meter-token"),
        (dimension.isNotNull(), "dimension-ambiguous"),
        (F.size(stated) <= 1, "deployment-ambiguous"),
        (~(has("short") & has("long")), "context-ambiguous"),
        (rate.isNotNull(), "unit-of-measure-unsupported"),
    ]
    why = reduce(lambda rest, test: F.when(~F.coalesce(test[0], F.lit(False)), test[1] if isinstance(test[1], Column) else F.lit(test[1])).otherwise(rest), reversed(tests), F.lit(None).cast("string"))
    quarantined = ["unrecognized-meter-token", "dimension-ambiguous", "deployment-ambiguous", "context-ambiguous", "unit-of-measure-unsupported"]
    ok = F.col("rejected").isNull()
    assumed = F.array_compact(F.array(F.when(F.size(stated) == 0, f"deployment={assumed_deployment}"), F.when(~has("short") & ~has("long"), f"context={assumed_context}"), F.when(~has("standard"), "service_tier=standard"), F.lit("purchase_model=payg")))
    return rows.withColumn("rejected", why).select(
        "meterId", "meterName", "skuName", "armRegionName", "effectiveStartDate", "rejected", F.coalesce(F.col("rejected").isin(*quarantined), F.lit(False)).alias("quarantined"), F.col("m.model").alias("model"), F.when(ok, F.col("m.publisher")).alias("publisher"), F.when(ok, dimension).alias("dimension"),
        F.when(ok, F.coalesce(F.get(stated, F.lit(0)), F.lit(assumed_deployment))).alias("deployment"), F.when(ok, F.when(has("short"), "short").when(has("long"), "long").otherwise(assumed_context)).alias("context"), F.when(ok, F.round(rate, 10)).alias("per_million"), F.when(ok, assumed).alias("assumed"),
    )


def resolve_meters(parsed: DataFrame, account_region: str | None = None) -> DataFrame:
    """AGG37: one rate for (model, deployment, context, dimension): the account's region if it has one, the latest date, and only if the rates then agree."""
    keys = ["model", "deployment", "context", "dimension"]
    rows = parsed.where("rejected is null").withColumn("home", F.lower("armRegionName") == F.lit((account_region or "").lower()))
    best = Window.partitionBy(*keys).orderBy(F.desc("home"), F.desc_nulls_last(F.to_date("effectiveStartDate")))
    top = rows.withColumn("place", F.rank().over(best)).where("place = 1")
    out = top.groupBy(*keys).agg(F.min("per_million").alias("low"), F.max("per_million").alias("high"), F.min("meterId").alias("meter_id"), F.first("publisher").alias("publisher"))
    agree = F.col("low") == F.col("high")
    return out.select(*keys, "publisher", "meter_id", F.when(agree, F.col("low")).alias("per_million"), F.when(~agree, F.lit("region-rate-conflict")).alias("rejected"))


def meter_prices(resolved: DataFrame) -> DataFrame:
    """AGG36: entries of models that have both an input and an output rate, wide by dimension."""
    wide = resolved.where("rejected is null").groupBy("model", "publisher", "deployment", "context").pivot("dimension", ["input", "cached_input", "cache_write", "output"]).agg(F.first("per_million"))
    return wide.where("input is not null and output is not null")


# Imported billing rows and layers


def imported_prices(rows: DataFrame, requests: DataFrame, bin_days: int = 32) -> DataFrame:
    """J7: a request's (model, scope, component, at) exact rows: none, one, or AMBIGUOUS; a rate without a quantity is verified but has no usage.

    Requests and rows are never paired.  For each key and moment asked, the rows in force are those begun less those
    ended; if it is one, it is the one of all begun that ends last.  A row stands in every bin of days that its period
    touches, as far as requests reach, begun at the bin's start at the earliest, so a bin is counted through on its own.
    """
    keys = ["model", "processing_scope", "component"]
    day = lambda c: F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date"))
    of = lambda c: F.floor(c / bin_days).cast("int")
    least, most = requests.agg(F.min(of(day(F.col("at")))), F.max(of(day(F.col("at"))))).first()
    if least is None:
        least, most = 0, -1
    none = F.lit(None)
    asked = requests.groupBy(*keys, "at").agg(F.lit(1).alias("asked")).where("at is not null")
    wanted = asked.select(*keys).distinct()
    begin = F.greatest(of(day(F.col("effective_from"))), F.lit(least))
    end = F.least(F.coalesce(of(day(F.col("effective_to"))), F.lit(most)), F.lit(most))
    valid = rows.where(F.col("effective_from").isNotNull() & (F.col("effective_to").isNull() | (F.col("effective_to") >= F.col("effective_from")))).join(wanted, keys, "left_semi")
    fact = F.struct(F.col("effective_to").isNull().alias("open"), "effective_to", "unit_price", F.col("unit_multiplier").alias("multiplier"), "quantity", "currency")
    binned = valid.where(begin <= end).select(*keys, "effective_from", "effective_to", fact.alias("fact"), F.explode(F.sequence(begin, end)).alias("bin"))
    moment = lambda c: F.col(c).cast("timestamp")
    start = F.date_add(F.lit("1970-01-01").cast("date"), F.col("bin") * bin_days).cast("timestamp")
    # at one moment rows begin (0), requests are asked (1) and rows end (2)
    begun = binned.groupBy(*keys, "bin", F.greatest(moment("effective_from"), start).alias("t")).agg(F.count(F.lit(1)).alias("n"), F.max("fact").alias("fact")).withColumn("kind", F.lit(0))
    ended = binned.where(F.col("effective_to").isNotNull() & (of(day(F.col("effective_to"))) == F.col("bin"))).groupBy(*keys, "bin", moment("effective_to").alias("t")).agg((-F.count(F.lit(1))).alias("n")).withColumns({"fact": none, "kind": F.lit(2)})
    points = asked.select(*keys, of(day(F.col("at"))).alias("bin"), moment("at").alias("t"), F.lit(0).cast("long").alias("n"), none.alias("fact"), F.lit(1).alias("kind"), "at")
    line = points.unionByName(begun.withColumn("at", none)).unionByName(ended.withColumn("at", none))
    so_far = Window.partitionBy(*keys, "bin").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    facts = line.select(*keys, "at", "kind", F.sum("n").over(so_far).alias("n"), F.max("fact").over(so_far).alias("fact")).where("kind = 1 and n > 0").select(*keys, "at", "n", "fact.*")
    found = requests.select("request", *keys, "at").join(facts, [*keys, "at"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    state = F.when(F.col("n") == 0, "NO_PRICE").when(F.col("n") > 1, "AMBIGUOUS").when(F.col("quantity").isNull(), "RATE_VERIFIED_USAGE_MISSING").otherwise("RESOLVED")
    one = F.col("n") == 1
    return found.select("request", state.alias("state"), F.when(one, F.col("unit_price") / F.col("multiplier")).alias("rate"), F.when(one & F.col("quantity").isNotNull(), F.round(F.col("unit_price") * F.col("quantity") / F.col("multiplier"), 6)).alias("amount"), F.when(one, F.col("currency")).alias("currency"))


def layered_prices(layers: Sequence[DataFrame], currency: str) -> DataFrame:
    """J6, J8, J9: the first layer that resolves a request in the currency; (request, layer, rate), layer null for none."""
    tagged = [d.select("request", "state", "rate", "currency").withColumn("layer", F.lit(i)) for i, d in enumerate(layers)]
    rows = reduce(DataFrame.unionByName, tagged)
    good = F.col("state").isin("RESOLVED", "RATE_VERIFIED_USAGE_MISSING") & (F.col("currency") == currency)
    return rows.groupBy("request").agg(F.min_by(F.when(good, F.col("rate")), F.when(good, F.col("layer"))).alias("rate"), F.min(F.when(good, F.col("layer"))).alias("layer"))


def contract_entries(rows: DataFrame, provider: str = "contract") -> DataFrame:
    """SRC33: models whose contract has both input and output rates, per million."""
    rate = F.col("unit_price") / F.col("unit_multiplier") * 1_000_000
    wide = rows.groupBy("model").pivot("component", ["input_tokens", "cached_tokens", "output_tokens"]).agg(F.max(rate))
    return wide.where("input_tokens is not null and output_tokens is not null").select(F.lit(provider).alias("provider"), "model", F.col("input_tokens").alias("input_rate"), F.col("cached_tokens").alias("cached_rate"), F.col("output_tokens").alias("output_rate"))


def actual_cost(rows: DataFrame, known: DataFrame) -> DataFrame:
    """J10, AGG38: billed cost of known models and of the rest."""
    cost = F.sum(F.col("unit_price") * F.coalesce("quantity", F.lit(0.0)) / F.col("unit_multiplier"))
    of = lambda how, name: rows.join(known.select("model").distinct(), "model", how).agg(F.lit(name).alias("kind"), F.count(F.lit(1)).alias("rows"), F.round(F.coalesce(cost, F.lit(0.0)), 6).alias("cost"))
    return of("left_semi", "matched").unionByName(of("left_anti", "unmatched"))


# Published tables


def html_tables(pages: DataFrame, columns: Sequence[str], html: str = "html", key: str = "page_id", must: bool = False) -> DataFrame:
    """SRC28, SRC29: rows of the HTML tables whose header has exactly ``columns``: (key, table, row, cells).

    With ``must`` a page that has no such table is an error, as its layout has changed.
    """

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            out = []
            for k, text in zip(batch["k"], batch["html"], strict=True):
                rows = [(k, t, r, cells) for t, r, cells in table_rows(text or "", list(columns))]
                if must and not rows:
                    raise ValueError(f"page {k} has no table with the columns {', '.join(columns)}")
                out += rows
            yield pd.DataFrame(out, columns=["key", "table_number", "row_number", "cells"])

    return pages.select(F.col(key).cast("string").alias("k"), F.col(html).alias("html")).mapInPandas(run, "key string, table_number int, row_number int, cells array<string>")


def table_rows(html: str, columns: list[str]) -> Iterator[tuple[int, int, list[str]]]:
    """Rows below a header that has exactly these columns, lower-cased and with single spaces."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.tables, self.cell = [], None

        def handle_starttag(self, tag, attrs):
            if tag == "table":
                self.tables.append([])
            elif tag == "tr" and self.tables:
                self.tables[-1].append([])
            elif tag in ("td", "th") and self.tables and self.tables[-1]:
                self.cell = []

        def handle_endtag(self, tag):
            if tag in ("td", "th") and self.cell is not None:
                self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
                self.cell = None

        def handle_data(self, data):
            if self.cell is not None:
                self.cell.append(data)

    reader = Reader()
    reader.feed(html)
    want = [c.lower() for c in columns]
    for t, rows in enumerate(reader.tables):
        if rows and [c.lower() for c in rows[0]] == want:
            for r, cells in enumerate(rows[1:]):
                if len(cells) != len(want):
                    raise ValueError("a price table's row doesn't have its header's columns")
                yield t, r, cells


def dollars(cell: Column, published_unit: float = 1_000_000.0) -> Column:
    """``$N / MTok`` as dollars per million tokens; other cells are null."""
    return F.regexp_extract(cell, r"^\$\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double") * 1_000_000 / published_unit
