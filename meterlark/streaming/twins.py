"""Streaming forms of de-duplication, buckets, span import and the append sink.

Sinks take a micro-batch and its number; the number names what is written, so a batch that is run again replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.dedupe import stream_key
from ..sinks.records import append_new
from ..sinks.tables import Folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def dedupe_stream(records: DataFrame, delay: str = "1 day") -> DataFrame:
    """STR1: the first row of each stream key; keys are forgotten once the watermark passes them by."""
    return records.withWatermark("ts", delay).withColumn("stream_key", stream_key()).dropDuplicatesWithinWatermark(["stream_key"])


class FirstOfKey(StatefulProcessor):
    """The first row of a key, by ``order``; a key that isn't seen for ``idle`` of event time is forgotten and may come again."""

    def __init__(self, idle: timedelta, order: str):
        self.idle, self.order = idle, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "until long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        first, latest = None, 0
        for row in rows:
            latest = max(latest, int(row["ts"].timestamp() * 1000))
            if first is None or row[self.order] < first[self.order]:
                first = row
        until = latest + int(self.idle.total_seconds() * 1000)
        if self.seen.exists():
            before = self.seen.get()[0]
            if until > before:
                self.handle.deleteTimer(before)
                self.handle.registerTimer(until)
                self.seen.update((until,))
            return
        self.handle.registerTimer(until)
        self.seen.update((until,))
        yield first

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def pull_stream(records: DataFrame, idle: timedelta = timedelta(days=1), order: str = "ingest_seq") -> DataFrame:
    """STR1, SRC4: the first row of each stream key, with a timer for each key.

    Rows without a time can't be timed: give ``ts`` one before, or leave them out.  ``order`` chooses within a micro-batch.
    """
    records.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    keyed = records.where("ts is not null").withColumn("stream_key", stream_key()).withWatermark("ts", f"{int(idle.total_seconds())} seconds")
    return keyed.groupBy("stream_key").transformWithState(FirstOfKey(idle, order), keyed.schema, "append", "eventTime")


def five_minute_buckets(records: DataFrame, delay: str = "1 hour") -> DataFrame:
    """STR7: sums by deployment and five minutes, in batch and in streams; late rows beyond the delay are not counted."""
    rows = records.withWatermark("ts", delay) if records.isStreaming else records
    return rows.groupBy(F.window("ts", "5 minutes").alias("w"), "deployment_name").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count(F.lit(1)).alias("requests")).select(F.col("w.start").alias("bucket_start"), "deployment_name", "input_tokens", "output_tokens", "requests")


Sink = Callable[[DataFrame, int], None]


def append_sink(folder: str, spark: SparkSession | None = None, name: str = "stream") -> Sink:
    """STR3: a ``foreachBatch`` function that appends what isn't there yet, each micro-batch under its number."""
    return lambda batch, number: append_new(batch, folder, f"{name}-{number}") and None


def limited_sink(folder: str, max_records: int, order: str = "ingest_seq") -> Sink:
    """STR1: a ``foreachBatch`` function that writes the first ``max_records`` rows over all micro-batches, in ``order`` within each.

    What earlier micro-batches have written is known from their marks, so a restart goes on where the last whole one ended.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        place = Folder(spark, folder)
        sizes = {int(a): int(b) for a, b in (n.split("-") for n in place.names("_batches"))}
        left = max_records - sum(n for k, n in sizes.items() if k < number)
        whole = batch.persist()  # all of it is read, so that its state is committed, even if nothing is taken
        n = min(whole.count(), max(left, 0))
        whole.orderBy(order).limit(n).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        for k in [k for k in sizes if k >= number]:
            place.delete(f"_batches/{k}-{sizes[k]}")
        place.put(f"_batches/{number}-{n}", "")
        whole.unpersist()

    return write


def table_sink(folder: str) -> Sink:
    """A ``foreachBatch`` function that writes each micro-batch to a place of its own number, which a second attempt overwrites."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")


def whole_sink(folder: str) -> Sink:
    """A ``foreachBatch`` function for complete results: the latest replaces the one before."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(folder)


def run(stream: DataFrame, sink: Sink, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there now."""
    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_to_end(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and give its result, a table written beside its checkpoint."""
    folder = f"{checkpoint}/{name}"
    run(stream, table_sink(folder) if mode == "append" else whole_sink(folder), f"{checkpoint}/state", mode)
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)


def span_documents(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """STR4: (file, v) of OTLP documents, one a file or one a line, as files arrive in a folder; what isn't JSON is left out."""
    from ..sources.records import parsed

    whole = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_a_batch).load(folder)
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    # the parser stops at the end of a first value, so a file is one document only if its first line isn't one already
    one = F.try_parse_json(F.get(lines, F.lit(0))).isNull() & F.try_parse_json("value").isNotNull()
    rows = whole.select(F.col("_metadata.file_path").alias("file"), F.explode(F.when(one, F.array("value")).otherwise(lines)).alias("value"))
    return parsed(rows, reject=False)


def span_stream(documents: DataFrame) -> DataFrame:
    """STR4: spans that name a model as canonical rows."""
    from ..sources.records import map_spans, spans_of

    return map_spans(spans_of(documents))


def import_spans(spark: SparkSession, incoming: str, folder: str, checkpoint: str, files_a_batch: int = 1000) -> None:
    """STR4: append the spans of the documents that have arrived, each span once, whatever is run again."""
    run(span_stream(span_documents(spark, incoming, files_a_batch)), append_sink(folder, name="spans"), checkpoint)
