"""Queries of stored distributions, appended records and feeds; registered with the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import catalog as K
from . import catalog_sql as S
from .operators import distributions as D
from .sinks.tables import written
from .sources import prices as Y
from .sources import views as V

query, KEY = K.query, K.KEY

# Distributions


def stored_latencies(spark, folder, exact: int = D.EXACT) -> DataFrame:
    """Latencies by deployment and day, as they are kept."""
    return written(D.daily_distributions(V.request_traces(spark, folder), "latency_ms", KEY, F.to_date("ts"), exact), "distributions")


GRAINS_SQL = "(SELECT 'day' AS grain UNION ALL SELECT 'week' UNION ALL SELECT 'all') g"
WINDOW_SQL = "CASE grain WHEN 'all' THEN 'all' ELSE strftime(date_trunc(grain, ts), '%Y-%m-%d') END"


def windows(stored: DataFrame) -> DataFrame:
    """Each day in its own window, its week's and the one of all days."""
    start = lambda grain: F.date_format(F.date_trunc(grain, "day"), "yyyy-MM-dd")
    into = F.array(*[F.struct(F.lit(g).alias("grain"), w.alias("start")) for g, w in (("day", start("day")), ("week", start("week")), ("all", F.lit("all")))])
    return stored.withColumn("w", F.explode(into)).select(*stored.columns, "w.grain", "w.start")


@query(
    f"WITH {S.REQUEST_TRACES_SQL}, x AS (SELECT deployment_name, grain, {WINDOW_SQL} AS start, latency_ms AS v FROM traces, {GRAINS_SQL} WHERE latency_ms IS NOT NULL) "
    "SELECT deployment_name, grain, start, count(*) AS n, round(min(v), 6) AS least, round(max(v), 6) AS most, count(*) <= 10000 AS exact, "
    + ", ".join(f"CASE WHEN count(*) <= 10000 THEN round(quantile_cont(v, {p}), 6) END AS {name}" for name, p in D.SHARES.items())
    + " FROM x GROUP BY ALL"
)
def bounded_percentiles(spark, folder):
    """PCT6 to PCT8, AGG44: days merged into weeks and into one window; exact up to 10,000 values, only told when exact."""
    out = D.merged_distributions(windows(stored_latencies(spark, folder)), [*KEY, "grain", "start"])
    six = lambda c: F.round(c, 6)
    return out.select(*KEY, "grain", "start", "n", six("least").alias("least"), six("most").alias("most"), "exact", *[F.when(F.col("exact"), six(name)).alias(name) for name in D.SHARES])


@query(
    f"WITH {S.REQUEST_TRACES_SQL}, x AS (SELECT deployment_name, grain, {WINDOW_SQL} AS start, latency_ms AS v FROM traces, {GRAINS_SQL} WHERE latency_ms IS NOT NULL), "
    "ranked AS (SELECT deployment_name, grain, start, v, count(*) OVER w AS n, rank() OVER (w ORDER BY v) - 1 AS below FROM x WINDOW w AS (PARTITION BY deployment_name, grain, start)) "
    f"SELECT deployment_name, grain, start, max(n) AS n, max(n) <= 50 AS exact, max(below) < max(n) AS within FROM ranked GROUP BY ALL"
)
def sketched_percentiles(spark, folder):
    """PCT6, AGG44: the same from sketches alone beyond 50 values a window; whether each answer's exact rank is within the sketch's bound."""
    stored = windows(stored_latencies(spark, folder, 50))
    merged = written(D.merged_distributions(stored, [*KEY, "grain", "start"], 50), "merged")
    rows = windows(V.request_traces(spark, folder).select(*KEY, F.to_date("ts").alias("day"), "latency_ms"))
    misses = D.rank_misses(rows, "latency_ms", [*KEY, "grain", "start"], merged)
    # an exact answer lies between two neighbours, so it may miss a rank by one place
    bound = F.when(F.col("exact"), 1 / F.col("n")).otherwise(F.lit(D.rank_error()) + 1 / F.col("n"))
    return merged.join(misses, [*KEY, "grain", "start"]).select(*KEY, "grain", "start", "n", "exact", (F.col("miss") <= bound).alias("within"))


# Appends


@query(
    "SELECT strftime(CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 40 DAY ELSE ts END, '%Y-%m-%d') AS event_date, CASE WHEN event_id % 3 = 0 THEN 'second' ELSE 'first' END AS batch, count(*) AS records, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY ALL"
)
def appended_records(spark, folder):
    """SNK1 to SNK3: two thirds of the events, then all of them again under other dates; what is stored, by date and batch."""
    from .sinks.records import append_new
    from .sinks.tables import new_folder

    events = V.table(spark, folder, "events").select("event_id", "ts", "event_type", "value")
    place = new_folder(spark, "appended")
    append_new(events.where(F.col("event_id") % 3 != 0), place, "first")
    append_new(events.withColumn("ts", F.col("ts") + F.expr("interval 40 days")), place, "second")
    stored = spark.read.schema("event_id long, batch string, event_date string").json(place)
    return stored.groupBy("event_date", "batch").agg(F.count("*").alias("records"), F.sum("event_id").alias("ids"))


# Prices


WIDE_SQL = K.ORACLE_SQL["meter_candidates"]


@query(
    f"SELECT model, deployment, context, max(per_million) FILTER (dimension = 'input') AS input, max(per_million) FILTER (dimension = 'cached_input') AS cached_input, max(per_million) FILTER (dimension = 'output') AS output FROM ({WIDE_SQL}) WHERE rejected IS NULL GROUP BY ALL HAVING input IS NOT NULL AND output IS NOT NULL"
)
def meter_entries(spark, folder):
    """AGG36: models, modes and contexts whose meters give both an input and an output rate."""
    return Y.meter_prices(Y.resolve_meters(K.parsed_meters(spark, folder))).select("model", "deployment", "context", "input", "cached_input", "output")


@query(
    "WITH c AS (SELECT DISTINCT 'Model ' || (p_partkey % 50) AS model, 'publisher-' || (p_partkey % 50 % 3) AS publisher, 'L' || (p_partkey % 50) AS label, ['alias_' || (p_partkey % 50 // 2), 'model-' || (p_partkey % 50 + 1)] AS aliases FROM part WHERE p_partkey % 50 < 40), "
    "k AS (SELECT lower(regexp_replace(trim(n.a), '[\\s_]+', '-', 'g')) AS key, n.rank, model, publisher, label FROM (SELECT *, unnest([{'rank': 0, 'a': model}, {'rank': 1, 'a': aliases[1]}, {'rank': 1, 'a': aliases[2]}]) AS n FROM c)), "
    "best AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY rank, model) = 1), "
    "asked AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN ' MODEL_' || (p_partkey % 60) WHEN 1 THEN 'alias ' || (p_partkey % 60) ELSE p_name END AS name FROM part) "
    "SELECT p_partkey, model, publisher, label FROM asked LEFT JOIN best ON best.key = lower(regexp_replace(trim(name), '[\\s_]+', '-', 'g'))"
)
def crosswalk_lookup(spark, folder):
    """J17: names as a model, an alias or neither, by equality of canonical names."""
    part = V.table(spark, folder, "part")
    n = F.col("p_partkey") % 50
    known = part.where(n < 40).select(F.concat(F.lit("Model "), n).alias("model"), F.concat(F.lit("publisher-"), n % 3).alias("publisher"), F.concat(F.lit("L"), n).alias("label"), F.array(F.concat(F.lit("alias_"), F.floor(n / 2)), F.concat(F.lit("model-"), n + 1)).alias("aliases")).distinct()
    number = F.col("p_partkey") % 60
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" MODEL_"), number)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("alias "), number)).otherwise(F.col("p_name"))
    return Y.crosswalk_models(part.select("p_partkey", name.alias("name")), known).select("p_partkey", "model", "publisher", "label")


# Feeds


@query(
    "SELECT 'dep-' || (user_id % 5) AS resource, strftime(ts, '%Y-%m-%d') AS day, count(*) AS points, count(DISTINCT hour(ts) // 6) AS pages, CAST(sum(event_id) AS BIGINT) AS ids, round(sum(value), 6) AS total FROM events GROUP BY ALL"
)
def paged_metrics(spark, folder):
    """SRC17, SRC27: metric points by deployment and day as paged feeds, a page every six hours, written and read as a data source."""
    from .sinks.tables import new_folder
    from .sources.feeds import read_feeds

    e = V.table(spark, folder, "events").select("event_id", "value", F.concat(F.lit("dep-"), F.col("user_id") % 5).alias("resource"), F.date_format("ts", "yyyy-MM-dd").alias("window"), F.floor(F.hour("ts") / 6).cast("int").alias("hour"))
    pages = e.groupBy("resource", "window", "hour").agg(F.collect_list(F.struct("event_id", "value")).alias("Items"))
    hours = F.array_sort(F.collect_set("hour").over(Window.partitionBy("resource", "window")))  # at most 4
    place = F.array_position(hours, F.col("hour")).cast("int")
    pages = pages.select("resource", "window", "Items", place.alias("page"), F.size(hours).alias("last"))
    link = F.when(F.col("page") < F.col("last"), F.concat(F.lit("page="), F.col("page") + 1))
    path = new_folder(spark, "feeds")
    text = F.to_json(F.struct("Items", link.alias("NextPageLink")))
    pages.select("resource", "window", "page", text.alias("value")).repartition("resource", "window").write.partitionBy("resource", "window", "page").text(path)
    points = read_feeds(spark, path, max_items=1 << 40).withColumn("i", F.from_json("item", "event_id long, value double"))
    return points.groupBy("resource", F.col("window").alias("day")).agg(F.count("*").alias("points"), F.count_distinct("page").alias("pages"), F.sum("i.event_id").alias("ids"), F.round(F.sum("i.value"), 6).alias("total"))
