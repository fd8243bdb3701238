"""Idempotent append of records.

A folder of records holds ``batch=<name>/event_date=<day>/`` with JSON lines, and beside them, hidden from readers:
``_ids/batch=<name>/bucket=<n>/`` with the event ids of each batch, dealt by hash, and ``_batches/<name>`` with the number of
rows of each batch that is whole.  An id is looked for in its bucket alone, whatever its date; files of a bucket carry Parquet's
Bloom filters, which a small batch's ids are tested against.  A batch is written under its name, first its rows, then its ids, then its mark, and each
overwrites what an interrupted attempt left, so the same batch twice is there once.
"""

from __future__ import annotations

import hashlib
import uuid
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Folder

BUCKETS = 64
FEW_IDS = 200  # a batch of so few ids is looked for by value, so that files are skipped by their Bloom filters


def record_id() -> Column:
    """The event id; null if it is empty."""
    return F.nullif(F.col("event_id").cast("string"), F.lit(""))


def bucket_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def batch_name(records: DataFrame) -> str:
    """A name that equal batches share, whatever the order of their rows."""
    row = F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in records.columns])))
    facts = records.select(row.alias("h")).agg(F.count("*"), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)")), F.min("h"), F.max("h")).first()
    return hashlib.sha256(repr(tuple(facts)).encode()).hexdigest()[:32]


def known_ids(folder: str, ids: DataFrame, besides: str = "") -> DataFrame | None:
    """SNK3: (record_id) of those of ``ids`` (record_id, bucket) that any batch but ``besides`` holds, read from their buckets; null if there is no index."""
    spark = ids.sparkSession
    place = Folder(spark, folder)
    if not place.names("_ids"):
        return None
    gone = place.names("_purged")
    few = [r[0] for r in ids.select("record_id").limit(FEW_IDS + 1).collect()]
    buckets = [r[0] for r in ids.select("bucket").distinct().collect()]  # at most BUCKETS
    stored = spark.read.schema("record_id string, origin string, batch string, bucket int").parquet(f"{folder}/_ids")
    stored = stored.where(F.col("bucket").isin(*buckets) & ~F.col("origin").isin(besides, *gone))
    if few and len(few) <= FEW_IDS:
        stored = stored.where(reduce(lambda a, b: a | b, [F.col("record_id") == x for x in few]))
    return stored.select("record_id", "bucket").join(ids, ["record_id", "bucket"], "left_semi").select("record_id").distinct()


def append_new(records: DataFrame, folder: str, batch: str | None = None, max_file_bytes: int = 50 << 20, limit: int | None = None) -> int:
    """SNK1 to SNK4, SNK6, SNK7: append a batch's records that aren't there yet; gives how many it has added by this call.

    Records with an id are written once, in whichever batch they come first (the earliest of a batch).  Records without one
    are never compared: they are kept, equal or not, unless the whole batch has been written before.  ``batch`` names the batch; without a
    name its content does.  Files are cut at about ``max_file_bytes``.  With a ``limit``, only the first records by time, id and content are added.
    """
    spark = records.sparkSession
    place = Folder(spark, folder)
    batch = batch or batch_name(records)
    if place.exists(f"_batches/{batch}"):
        return 0
    keyed = records.withColumns({"record_id": record_id(), "event_date": F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("unknown"))})
    columns = [*records.columns, "event_date"]
    order = F.struct(F.col("ts").isNull(), "ts", F.xxhash64(F.to_json(F.struct(*records.columns))))
    named = keyed.where("record_id is not null").groupBy("record_id").agg(F.min_by(F.struct(*columns), order).alias("row")).select("record_id", bucket_of(F.col("record_id")).alias("bucket"), "row")
    before = known_ids(folder, named.select("record_id", "bucket"), batch)
    if before is not None:
        named = named.join(before, "record_id", "left_anti")
    rows = named.select("record_id", "bucket", "row.*").unionByName(keyed.where("record_id is null").withColumn("bucket", F.lit(None).cast("int")))
    if limit is not None:
        rows = rows.orderBy(F.col("ts").asc_nulls_last(), F.col("record_id").asc_nulls_last(), F.to_json(F.struct(*records.columns))).limit(limit)
    rows = rows.persist()
    length = F.octet_length(F.to_json(F.struct(*records.columns)))
    n, size = rows.agg(F.count("*"), F.avg(length)).first()
    if n:
        a_file = max(1, int(max_file_bytes / (size + 1)))
        rows.select(*columns).write.mode("overwrite").partitionBy("event_date").option("maxRecordsPerFile", a_file).json(f"{folder}/batch={batch}")
        ids = rows.where("record_id is not null").select("record_id", F.lit(batch).alias("origin"), "bucket")
        write_ids(ids, f"{folder}/_ids/batch={batch}")
    rows.unpersist()
    place.put(f"_batches/{batch}", str(n))
    return n


def write_ids(ids: DataFrame, folder: str) -> None:
    ids.repartition("bucket").sortWithinPartitions("bucket", "record_id").write.mode("overwrite").partitionBy("bucket").option("parquet.bloom.filter.enabled#record_id", "true").parquet(folder)


def compact_ids(spark: SparkSession, folder: str) -> int:
    """Bring the ids of all whole batches together, one file a bucket; gives how many batches' indexes went into it.

    Readers may meet an id twice while this runs, which changes nothing; an attempt that was interrupted is brought together again.
    """
    place = Folder(spark, folder)
    whole = set(place.names("_batches"))
    names = [n.removeprefix("batch=") for n in place.names("_ids") if n.startswith("batch=")]
    ready = [n for n in names if n in whole or n.startswith("together-")]
    if len(ready) < 2:
        return 0
    stored = spark.read.schema("record_id string, origin string, batch string, bucket int").parquet(f"{folder}/_ids").where(F.col("batch").isin(*ready) & ~F.col("origin").isin("", *place.names("_purged")))
    write_ids(stored.select("record_id", "origin", "bucket").distinct(), f"{folder}/_ids/batch=together-{uuid.uuid4().hex}")
    for name in ready:
        place.delete(f"_ids/batch={name}")
    return len(ready)


def purge(spark: SparkSession, folder: str, now: datetime, keep_days: int = 30, keep: str = "") -> int:
    """SNK5: delete batches whose files were last written more than so many days before ``now``; gives how many went.

    The age of the files decides, never the dates of the records in them, so a back-filled batch stays as long as any other; the batch
    ``keep``, just written, always stays.  Ids of deleted batches are forgotten.  Whatever else is in the folder stays.
    """
    place = Folder(spark, folder)
    before = (now - timedelta(days=keep_days)).timestamp()
    old = [n for n in place.names() if n.startswith("batch=") and n != f"batch={keep}" and place.newest(n) < before] if keep_days > 0 else []
    for name in old:
        place.put(f"_purged/{name.removeprefix('batch=')}", "")
        place.delete(name)
        place.delete(f"_ids/{name}")
        place.delete(f"_batches/{name.removeprefix('batch=')}")
    return len(old)
