"""Price snapshots: stored, read, merged by currency; published tables; canonical spellings of price dimensions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import canonical_model
from ..operators.pricing import PRICE, Catalog

FACTS = "schema_version int, source string, source_url string, retrieved_at timestamp, content_hash string, currency string, feed_complete boolean, empty_reason string"
STORED = f"{FACTS}, prices array<struct<{', '.join(x.replace(' ', ':', 1) for x in PRICE.split(', '))}>>"


# Canonical spellings


def _spelling(value: Column) -> Column:
    return F.translate(F.lower(F.trim(F.coalesce(value, F.lit("")))), "- ", "__")


def _canonical(value: Column, spellings: dict[str, str], what: str) -> Column:
    known = F.create_map(*[F.lit(x) for pair in spellings.items() for x in pair])
    return F.coalesce(F.try_element_at(known, _spelling(value)), F.raise_error(F.concat(F.lit(f"not a {what}: "), F.coalesce(value, F.lit("null")))).cast("string"))


def canonical_deployment(value: Column) -> Column:
    """CST11: a deployment mode; a spelling that isn't known is an error."""
    return _canonical(value, fixed.DEPLOYMENT_SPELLINGS, "deployment mode")


def optional_deployment(value: Column) -> Column:
    """CST12: null where no mode is stated; an unknown spelling is still an error."""
    return F.when(~_spelling(value).isin(*fixed.UNSTATED), canonical_deployment(value))


def canonical_context(value: Column) -> Column:
    """CST13."""
    return _canonical(value, fixed.CONTEXT_SPELLINGS, "context window")


def canonical_tier(value: Column) -> Column:
    return _canonical(value, fixed.TIER_SPELLINGS, "service tier")


def canonical_inference(value: Column) -> Column:
    return _canonical(value, fixed.INFERENCE_SPELLINGS, "inference mode")


def consumption_units(dollars: Column) -> Column:
    """CST7: a hundred units a dollar."""
    return dollars / fixed.DOLLARS_PER_UNIT


def mode_multiplier(mode: Column) -> Column:
    """CST8: (multiplier, exact) of a canonical mode: an unstated one is taken as global and not exact; a mode that isn't published is null."""
    known = F.create_map(*[F.lit(x) for pair in fixed.MODE_MULTIPLIERS.items() for x in pair])
    return F.when(mode.isNull(), F.struct(F.lit(fixed.MODE_MULTIPLIERS["global"]).alias("multiplier"), F.lit(False).alias("exact"))).otherwise(F.when(mode.isin(*fixed.MODE_MULTIPLIERS), F.struct(F.try_element_at(known, mode).alias("multiplier"), F.lit(True).alias("exact"))))


# Published tables


def page_components(text: Column) -> Column:
    """HLP42: (input, output, cached_input, unit_price, unit) of a price cell; null if it holds no amount."""
    flat = F.regexp_replace(text, r"\s+", " ")
    part = lambda label: F.regexp_extract(flat, rf"(?i){label}\s*:\s*\$?\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    values = [part(label) for label in ("input", "output", "cached")]
    alone = F.regexp_extract(F.translate(flat, ",", ""), r"\$\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    unit = F.regexp_extract(flat, r"(?i)/\s*(?:1K|1M|1,000|1,000,000)\s*(?:Tokens?|Pages?|Characters?|Images?|Hours?|Seconds?)", 0)
    none = values[0].isNull() & values[1].isNull() & values[2].isNull()
    return F.when(~(none & alone.isNull()), F.struct(values[0].alias("input"), values[1].alias("output"), values[2].alias("cached_input"), F.when(none, alone).alias("unit_price"), F.when(unit != "", F.trim(unit)).otherwise("published unit").alias("unit")))


def page_prices(rows: DataFrame) -> DataFrame:
    """CST10: entries of page rows (label, components, see ``page_components``) that have input and output; the label's words tell the mode."""
    label = F.lower("label")
    model = F.when(label.contains("ministral 3b") | label.contains("ministral-3b"), "ministral-3b").otherwise(F.col("label"))
    region = F.when(label.contains("data zone"), "data_zone").when(label.contains("regional"), "regional").when(label.contains("global"), "global")
    c = lambda n: F.col(f"components.{n}")
    return rows.where(c("input").isNotNull() & c("output").isNotNull()).select(model.alias("model"), F.col("label").alias("alias"), region.alias("region"), c("input").alias("input_rate"), c("output").alias("output_rate"), c("unit").alias("unit"))


def table_prices(table: DataFrame, modes: Sequence[str | None] = (None,), models: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """HLP38: (entries, quarantined) of a published table (model, input, cached, write, output, in dollars per million) for deployment modes.

    A mode that isn't published puts its models in quarantine and costs the other modes nothing; a wanted model that
    isn't in the table is in quarantine too.  Rates are multiplied by the mode's factor; units are a hundred a dollar.
    """
    spark = table.sparkSession
    named = table.withColumn("name", canonical_model(F.col("model")))
    wanted = spark.createDataFrame([(m,) for m in models], "wanted string").select(canonical_model(F.col("wanted")).alias("name")).distinct() if models else None
    mine = named.join(F.broadcast(wanted), "name", "left_semi") if wanted is not None else named
    stated = F.array(*[F.lit(m).cast("string") for m in modes])
    each = mine.select("*", F.explode(stated).alias("asked")).withColumn("mode", optional_deployment(F.col("asked"))).withColumn("m", mode_multiplier(F.col("mode")))
    good = each.where("m is not null")
    rate = lambda c: (F.col(c) * F.col("m.multiplier")).alias(f"{c}_rate")
    assumed = F.array_sort(F.array_compact(F.array(F.when(~F.col("m.exact"), "deployment=global"), F.lit("purchase_model=payg"), F.lit("service_tier=standard"))))
    entries = good.select(F.col("name").alias("model"), F.col("model").alias("alias"), F.when(F.col("m.multiplier") > 1, "data_zone").otherwise("global").alias("region"), rate("input"), rate("cached"), rate("write"), rate("output"), consumption_units(F.col("input") * F.col("m.multiplier")).alias("input_units"), assumed.alias("assumed"))
    bad = each.where("m is null").select(F.lit("deployment-mode-not-published").alias("reason"), F.col("model").alias("subject"), F.col("mode").alias("detail"))
    if wanted is not None:
        bad = bad.unionByName(wanted.join(named.select("name").distinct(), "name", "left_anti").select(F.lit("model-not-published").alias("reason"), F.col("name").alias("subject"), F.lit(None).cast("string").alias("detail")))
    return entries, bad


# Snapshots


def write_snapshot(spark: SparkSession, folder: str, source: str, prices: DataFrame, currency: str, retrieved_at: datetime, complete: bool = True, source_url: str = "", empty_reason: str | None = None) -> None:
    """SNK18: store a source's prices as one JSON document in place of the one before; a feed that isn't complete is refused."""
    if not complete:
        raise ValueError("a price feed that was cut short is never stored; the snapshot before stays")
    rows = prices.select(F.struct(*[x.split()[0] for x in PRICE.split(", ")]).alias("p")).agg(F.collect_list("p").alias("prices"))  # a price list, not records
    facts = {"schema_version": F.lit(fixed.SNAPSHOT_VERSION), "source": F.lit(source), "source_url": F.lit(source_url), "retrieved_at": F.lit(retrieved_at), "content_hash": F.sha2(F.to_json("prices"), 256), "currency": F.lit(currency.upper()), "feed_complete": F.lit(True), "empty_reason": F.lit(empty_reason)}
    rows.select(*[c.alias(n) for n, c in facts.items()], "prices").coalesce(1).write.mode("overwrite").json(f"{folder}/source={source}")


def load_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """SRC30: the stored snapshots; documents that are broken or of another version are left out."""
    rows = spark.read.schema(STORED.replace("source string, ", "")).option("basePath", folder).option("mode", "PERMISSIVE").json(folder)
    return rows.where((F.col("schema_version") == fixed.SNAPSHOT_VERSION) & F.col("retrieved_at").isNotNull() & F.col("currency").isNotNull())


def stale(retrieved_at: Column, now: datetime, days: int = fixed.SNAPSHOT_DAYS) -> Column:
    """FLT16: older than so many days, or not there."""
    return F.coalesce(F.lit(now) - retrieved_at > F.make_dt_interval(days=F.lit(days)), F.lit(True))


def sync_needed(snapshots: DataFrame, sources: Iterable[str], now: datetime, days: int = fixed.SNAPSHOT_DAYS) -> DataFrame:
    """HLP41: (source, needed) of the sources that are asked for."""
    asked = snapshots.sparkSession.createDataFrame([(s,) for s in sources], "source string")
    return asked.join(snapshots.groupBy("source").agg(F.max("retrieved_at").alias("retrieved_at")), "source", "left").select("source", stale(F.col("retrieved_at"), now, days).alias("needed"))


def provenance(snapshots: DataFrame, currency: str) -> DataFrame:
    """SET4, HLP40: each snapshot with its number of entries, and whether its currency lets it take part (nothing is converted)."""
    same = F.upper("currency") == currency.upper()
    return snapshots.select("source", "retrieved_at", "content_hash", F.upper("currency").alias("currency"), F.size("prices").alias("entries"), same.alias("included"), F.when(~same, F.concat(F.lit("currency "), F.upper("currency"), F.lit(f" differs from {currency.upper()}"))).alias("excluded_reason"))


def public_prices(snapshots: DataFrame, currency: str) -> DataFrame:
    """SET3: the prices of all snapshots in one currency."""
    return snapshots.where(F.upper("currency") == currency.upper()).select("source", F.explode("prices").alias("p")).select("source", "p.*")


def public_catalog(snapshots: DataFrame, currency: str) -> Catalog:
    """SET3: those prices as a catalog of the newest snapshot's date."""
    newest = snapshots.where(F.upper("currency") == currency.upper()).agg(F.max("retrieved_at")).first()[0]
    return Catalog("public-prices", "reference", public_prices(snapshots, currency).drop("source"), currency.upper(), "analysis_date_snapshot", newest.date().isoformat() if newest else None)


def sync(spark: SparkSession, folder: str, readers: dict[str, object], currency: str, now: datetime) -> DataFrame:
    """HLP37, HLP39: read each source by its function (-> prices), store what succeeds; (source, ok, detail): one that fails costs the others nothing."""
    out = []
    for source, read in readers.items():
        try:
            write_snapshot(spark, folder, source, read(spark), currency, now)
            out.append((source, True, None))
        except Exception as error:  # noqa: BLE001 - any failure of one source is reported as its own
            out.append((source, False, f"{type(error).__name__}: {str(error).splitlines()[0][:200]}"))
    return spark.createDataFrame(out, "source string, ok boolean, detail string")


def pages_of(first: str, fetch, allowed: Sequence[str], max_pages: int = 40, max_items: int = 40_000) -> Iterable[dict]:
    """SRC27: pages of a feed that ``fetch`` (address -> {Items, NextPageLink}) gives; a feed that goes on past a bound is an error, never cut short."""
    at, items, pages = first, 0, 0
    while at:
        if not any(at.startswith(prefix) for prefix in allowed):
            raise ValueError("a page's address isn't on the list of allowed ones")
        if pages >= max_pages:
            raise ValueError(f"the feed has more than {max_pages} pages")
        page = fetch(at)
        pages, items = pages + 1, items + len(page.get("Items", []))
        if items > max_items:
            raise ValueError(f"the feed has more than {max_items} items")
        yield page
        at = page.get("NextPageLink")


def customer_catalog(spark: SparkSession, path: str) -> Catalog | None:
    """SRC34: the customer's own catalog, a JSON document {currency, catalog_name, prices}; none if there is no file."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    entry = f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in PRICE.split(', '))}>>"
    document = spark.read.schema(f"currency string, catalog_name string, prices {entry}").option("multiLine", True).option("mode", "FAILFAST").json(path)
    facts = document.select("currency", "catalog_name").first()
    return Catalog(facts["catalog_name"] or "customer", "customer", document.select(F.explode("prices").alias("p")).select("p.*"), (facts["currency"] or "USD").upper())
