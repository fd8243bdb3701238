"""Appends known by id across dates, retention by age, streams that are restarted and run again."""

import json
import os
import time
from datetime import UTC, datetime, timedelta

import pytest

from meterlark.sinks import records as sink
from meterlark.streaming import twins

T0 = datetime(2026, 9, 14, 12)
EVENTS = "event_id string, ts timestamp, n long"


def events(spark, *rows):
    return spark.createDataFrame([(i, t, n) for i, t, n in rows], EVENTS)


def stored(spark, folder):
    return sorted((r["event_id"] or "", r["n"], str(r["event_date"])) for r in spark.read.schema(EVENTS + ", batch string, event_date string").json(folder).collect())


def test_ids_are_known_across_dates(spark, tmp_path):
    folder = str(tmp_path / "log")
    assert sink.append_new(events(spark, ("a", T0, 1), ("b", T0, 2)), folder) == 2
    late = events(spark, ("a", T0 + timedelta(days=40), 3), ("c", T0, 4), ("c", T0 - timedelta(days=1), 5))
    assert sink.append_new(late, folder) == 1
    assert stored(spark, folder) == [("a", 1, "2026-09-14"), ("b", 2, "2026-09-14"), ("c", 5, "2026-09-13")]
    # the few ids of a batch reach the scan of their buckets
    ids = events(spark, ("a", T0, 1)).select("event_id").toDF("record_id").withColumn("bucket", sink.bucket_of(sink.F.col("record_id")))
    known = sink.known_ids(folder, ids)
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0] and "EqualTo(record_id,a)" in plan
    assert [r[0] for r in known.collect()] == ["a"]


def test_interrupted_and_repeated_batches(spark, tmp_path):
    folder = str(tmp_path / "log")
    rows = events(spark, ("a", T0, 1), (None, T0, 2), (None, T0, 2))
    assert sink.append_new(rows, folder, "b1") == 3
    os.remove(tmp_path / "log" / "_batches" / "b1")  # its mark was never written
    assert sink.append_new(rows, folder, "b1") == 3 and len(stored(spark, folder)) == 3
    assert sink.append_new(rows, folder, "b1") == 0
    assert sink.append_new(rows, folder, "b2") == 2 and len(stored(spark, folder)) == 5
    assert sink.append_new(rows.limit(0), folder) == 0


def test_many_ids_and_their_index_brought_together(spark, tmp_path):
    folder = str(tmp_path / "log")
    many = spark.range(3000).selectExpr("cast(id as string) event_id", "timestamp'2026-01-01' + make_interval(0, 0, 0, cast(id % 50 as int)) ts", "id n")
    assert sink.append_new(many.where("n < 2000"), folder) == 2000
    assert sink.append_new(many.where("n >= 1000"), folder) == 1000
    assert sink.compact_ids(spark, folder) == 2 and len(os.listdir(tmp_path / "log" / "_ids")) == 1
    assert sink.append_new(many.withColumn("n", -sink.F.col("n")), folder) == 0
    assert sink.compact_ids(spark, folder) == 0


def test_files_are_cut_by_size(spark, tmp_path):
    rows = spark.range(500).coalesce(1).selectExpr("cast(id as string) event_id", "timestamp'2026-01-01' ts", "id n")
    sink.append_new(rows, str(tmp_path / "log"), "b", max_file_bytes=5000)
    files = [f for d, _, names in os.walk(tmp_path / "log" / "batch=b") for f in names if f.endswith(".json")]
    assert len(files) > 3


def test_retention_by_age_of_files(spark, tmp_path):
    folder, now = str(tmp_path / "log"), datetime.now(UTC)
    sink.append_new(events(spark, ("new", datetime(2020, 1, 1), 1)), folder, "back-filled")
    sink.append_new(events(spark, ("old", now.replace(tzinfo=None), 2)), folder, "aged")
    (tmp_path / "log" / "notes.txt").write_text("mine")
    aged = time.time() - 40 * 86400
    for d, _, names in os.walk(tmp_path / "log" / "batch=aged"):
        for n in names:
            os.utime(os.path.join(d, n), (aged, aged))
    os.utime(tmp_path / "log" / "notes.txt", (aged, aged))
    assert sink.purge(spark, folder, now, keep="aged") == 0 and sink.purge(spark, folder, now, keep_days=0) == 0
    sink.compact_ids(spark, folder)
    assert sink.purge(spark, folder, now) == 1
    assert [r[0] for r in stored(spark, folder)] == ["new"] and (tmp_path / "log" / "notes.txt").exists()
    # what is gone may come again, what stays is still known
    assert sink.append_new(events(spark, ("old", T0, 3), ("new", T0, 4)), folder) == 1


STREAM = "ingest_seq long, request_id string, event_id string, ts timestamp, deployment_name string, model_name string"


def arrive(spark, folder, *rows):
    spark.createDataFrame([(n, r, None, T0 + timedelta(minutes=m), "d", "m") for n, r, m in rows], STREAM).coalesce(1).write.mode("append").parquet(folder)


def test_pull_stream_restarts_and_forgets(spark, tmp_path):
    incoming, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    read = lambda: spark.readStream.schema(STREAM).parquet(incoming)
    go = lambda limit: twins.run(twins.pull_stream(read(), timedelta(minutes=10)), twins.limited_sink(out, limit), state)
    seen = lambda: sorted(r["ingest_seq"] for r in spark.read.schema(STREAM).parquet(out).collect())
    arrive(spark, incoming, (1, "a", 0), (0, "a", 1), (2, "b", 1))
    go(5)
    assert seen() == [0, 2]
    arrive(spark, incoming, (3, "a", 2), (4, "c", 3))  # restarted from the checkpoint, the keys are still known
    go(5)
    assert seen() == [0, 2, 4]
    arrive(spark, incoming, (5, "z", 60))  # the watermark passes a, b and c by
    go(5)
    arrive(spark, incoming, (6, "a", 61), (7, "b", 62), (8, "e", 62))
    go(5)
    assert seen() == [0, 2, 4, 5, 6]  # a has come again; the limit of five is held over restarts
    arrive(spark, incoming, (9, "f", 63))
    go(5)
    assert len(seen()) == 5


def test_a_limited_batch_replaces_itself(spark, tmp_path):
    write = twins.limited_sink(str(tmp_path / "out"), 3)
    first, second = (spark.createDataFrame([(i, "x") for i in ids], "ingest_seq long, v string") for ids in ([5, 1], [9, 7, 8]))
    write(first, 0)
    write(second, 1)
    write(second, 1)
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("ingest_seq").collect()) == [1, 5, 7]


def document(*ids):
    spans = [{"spanId": i, "startTimeUnixNano": "1000000000000000000", "endTimeUnixNano": "1000000000250000000", "attributes": {"gen_ai.request.model": "m", "gen_ai.prompt": "secret"}} for i in ids]
    return json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": spans}]}]})


def test_spans_arrive_once(spark, tmp_path):
    incoming = tmp_path / "in"
    incoming.mkdir()
    folder, state = str(tmp_path / "log"), str(tmp_path / "state")
    (incoming / "1.json").write_text(document("a", "b"))
    (incoming / "2.json").write_text(document("b", "c") + "\nnot json\n" + document("d"))
    ids = lambda: sorted(r["event_id"] for r in spark.read.json(folder).select("event_id").collect())
    twins.import_spans(spark, str(incoming), folder, state, files_a_batch=1)
    assert len(ids()) == 4
    (incoming / "3.json").write_text(json.dumps(json.loads(document("a", "e")), indent=1))
    twins.import_spans(spark, str(incoming), folder, state)
    assert len(ids()) == 5
    # a lost checkpoint runs everything again, under the same numbers or others
    twins.import_spans(spark, str(incoming), folder, str(tmp_path / "new"))
    assert len(ids()) == len(set(ids())) == 5


def test_the_same_batch_twice(spark, tmp_path):
    batch = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    for _ in range(2):
        twins.table_sink(str(tmp_path / "t"))(batch, 7)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    nameless = events(spark, (None, T0, 1), (None, T0, 1))
    for _ in range(2):
        twins.append_sink(str(tmp_path / "log"))(nameless, 7)
    assert len(stored(spark, str(tmp_path / "log"))) == 2


def test_only_json_objects_become_spans(spark, tmp_path):
    with pytest.raises(Exception, match="JSON object"):
        from meterlark.sources import records

        records.parsed(spark.createDataFrame([("f", "no")], "file string, value string")).collect()


# Distributions


def test_distributions_merge(spark):
    """Exact up to the limit, whatever days they come from; beyond it within the sketch's bound, over 100,000 values."""
    import numpy as np
    from pyspark.sql import functions as F

    from meterlark.operators import distributions as D

    rows = spark.range(100_000).select((F.col("id") % 40).alias("day"), F.when(F.col("id") % 40 < 3, "small").alias("k"), (F.rand(7) * 1000).alias("v")).unionByName(spark.createDataFrame([(5, None, None), (6, "none", None)], "day long, k string, v double"))
    stored = D.daily_distributions(rows, "v", ["k"], F.col("day"))
    assert max(len(r["sketch"]) for r in stored.collect()) < 80_000
    got = {r["k"]: r for r in D.merged_distributions(stored, ["k"]).collect()}
    values = {k: np.array([r["v"] for r in rows.where(F.col("k").eqNullSafe(F.lit(k)) & F.col("v").isNotNull()).collect()]) for k in got}
    assert set(got) == {"small", None} and got["small"]["n"] == 7500 and got["small"]["exact"] and not got[None]["exact"] and got[None]["n"] == 92_500
    assert [got["small"][p] for p in D.SHARES] == pytest.approx([np.quantile(values["small"], q) for q in D.SHARES.values()])
    assert all(abs((values[None] <= got[None][p]).mean() - q) < D.rank_error() for p, q in D.SHARES.items())
    misses = {r["k"]: r["miss"] for r in D.rank_misses(rows, "v", ["k"], D.merged_distributions(stored, ["k"])).collect()}
    assert misses[None] < D.rank_error() and misses["small"] <= 1 / 7500


def test_distributions_of_small_and_repeated_values(spark):
    from pyspark.sql import functions as F

    from meterlark.operators import distributions as D

    rows = spark.createDataFrame([(1, float(v)) for v in range(1, 101)] + [(2, 7.0)] * 50 + [(3, 4.0)], "day int, v double")
    stored = D.daily_distributions(rows, "v", [], F.col("day"))
    by_day = {r["day"]: r for r in D.merged_distributions(stored, ["day"]).collect()}
    assert (by_day[1]["p50"], by_day[1]["p95"], by_day[2]["p99"], by_day[3]["p50"]) == (50.5, 95.05, 7.0, 4.0)
    whole = D.merged_distributions(stored, []).first()
    assert whole["n"] == 151 and whole["exact"] and D.merged_distributions(stored.limit(0), ["day"]).count() == 0
