"""Streams fed in several batches, with a restart in between, against the batch rules."""

import datetime as dt
import random

from pyspark.sql import functions as F

from scanloom.streaming import stability

T0 = dt.datetime(2024, 1, 1)
DDL = "item long, poll_ts timestamp_ntz, size long, mod_time timestamp"


def looks(seed=1, polls=12):
    rng = random.Random(seed)
    rows, size = [], {k: 0 for k in range(6)}
    for p in range(polls):
        for k in size:
            if rng.random() < 0.5:
                size[k] += rng.randrange(1, 4)
            rows.append((k, T0 + dt.timedelta(seconds=30 * p), size[k], T0 + dt.timedelta(seconds=30 * p)))
    return rows


def drive(spark, build, batches, folder):
    """One run per batch of files: the query stops and starts again from its checkpoint."""
    for batch in batches:
        spark.createDataFrame(batch, DDL).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = build(spark.readStream.schema(DDL).parquet(f"{folder}/in"))
        query = (stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log")
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    return sorted((r.item, r.poll_ts, r.size) for r in spark.read.schema(stability.SERIES_OUTPUT).parquet(f"{folder}/out").collect())


def split(rows, polls):
    return [[r for r in rows if (r[1] - T0).seconds // 30 in chunk] for chunk in polls]


def test_series_across_restarts(spark, tmp_path):
    rows = looks()
    got = drive(spark, lambda s: stability.stable_series(s.select("item", "poll_ts", "size")), split(rows, [range(0, 5), range(5, 6), range(6, 12)]), tmp_path)
    want = []
    for k in range(6):
        seen, armed = None, True
        for _, ts, size, _ in (r for r in rows if r[0] == k):
            if seen is None:
                seen = size
            elif size > seen:
                seen, armed = size, True
            elif armed:
                want.append((k, ts, seen))
                armed = False
    assert got == sorted(want)
    batch = stability.stable_series_batch(spark.createDataFrame(rows, DDL))
    assert sorted((r.item, r.poll_ts, r.size) for r in batch.collect()) == sorted(want)


def test_incomplete_transfer_is_tried_again(spark, tmp_path):
    rows = [(1, T0, 5, 5), (1, T0 + dt.timedelta(seconds=30), 5, 4), (1, T0 + dt.timedelta(seconds=60), 5, 5), (1, T0 + dt.timedelta(seconds=90), 5, 5)]
    ddl = "item long, poll_ts timestamp_ntz, size long, received long"
    spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/in")
    query = (stability.stable_series(spark.readStream.schema(ddl).parquet(f"{tmp_path}/in")).writeStream.format("parquet")
             .option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start())
    query.awaitTermination()
    assert [r.poll_ts for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [T0 + dt.timedelta(seconds=60)]


def emitted(rows):
    out, last = [], {}
    for k, ts, size, _ in rows:
        before, armed = last.get(k, (None, True))
        if size == before and armed:
            out.append((k, ts, size))
        last[k] = (size, size != before)
    return sorted(out)


def test_unchanged_files_over_batches_and_restarts(spark, tmp_path):
    """The older file keeps its mod_time while a newer one is looked at: neither is lost."""
    start = [T0 + dt.timedelta(minutes=k) for k in range(6)]
    rows = [(k, ts, size, start[k]) for k, ts, size, _ in looks(2)]
    got = drive(spark, stability.stable_files, split(rows, [range(0, 2), range(2, 3), range(3, 7), range(7, 12)]), tmp_path)
    assert got == emitted(rows)
    batch = stability.stable_files_batch(spark.createDataFrame(rows, DDL))
    assert got == sorted((r.item, r.poll_ts, r.size) for r in batch.collect())


def test_mark_moves_on_emit_only(spark, tmp_path):
    poll = lambda n: T0 + dt.timedelta(seconds=30 * n)
    old, new = T0 - dt.timedelta(days=2), T0 - dt.timedelta(days=1)
    out = lambda: spark.read.schema(stability.FILES_OUTPUT).parquet(f"{tmp_path}/out")
    drive(spark, stability.stable_files, [[(1, poll(0), 5, new), (2, poll(0), 7, T0)], [(1, poll(1), 5, new), (2, poll(1), 8, T0)]], tmp_path)
    mark = stability.high_water_mark(out())
    assert mark == new  # file 2 was seen, but still grows
    late = [(3, poll(2), 9, old), (3, poll(3), 9, old), (2, poll(2), 8, T0)]
    got = drive(spark, lambda s: stability.stable_files(s, since=mark), [late], tmp_path)
    assert got == [(1, poll(1), 5), (2, poll(2), 8)]  # older than the mark: ignored


def test_state_expires(spark, tmp_path):
    rows = [(k, T0, 5, T0) for k in range(3)]
    far = [(9, T0 + dt.timedelta(days=5), 1, T0)]
    again = [(0, T0 + dt.timedelta(days=5, seconds=30), 5, T0)]
    assert drive(spark, stability.stable_files, [rows, far, far, again], tmp_path) == [(9, T0 + dt.timedelta(days=5), 1)]


def test_quiet_containers_stream(spark, tmp_path):
    rows = [(1, T0 + dt.timedelta(seconds=s)) for s in (0, 10, 25, 100, 300)] + [(2, T0 + dt.timedelta(seconds=s)) for s in (5, 200)]
    spark.createDataFrame(rows, "container_id long, updatetime timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("container_id long, updatetime timestamp").parquet(f"{tmp_path}/in")
    query = (stability.quiet_containers(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out")
             .option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start())
    query.awaitTermination()
    got = {(r.container_id, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert {(1, 3), (2, 1)} <= got and (1, 5) not in got


def test_sink_ignores_a_repeated_batch(spark, tmp_path):
    from scanloom.streaming.ingest_sink import IngestSink
    from tests.test_ingest import NOW, SCHEMA, check, empty, records, simulate

    rows = records(11, 30)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).withColumn("source", F.lit("stage/x"))
    bad = df.limit(1).withColumn("patient_id", F.lit(None).cast("string")).withColumn("source", F.lit("/a/b"))
    start = empty(spark)
    sink = IngestSink(str(tmp_path), start, start, NOW)
    sink(df.unionByName(bad), 0)
    sink(df.unionByName(bad), 0)
    check(sink.snapshot(spark, 0), simulate(rows))
    assert [r.preserved_as for r in spark.read.parquet(f"{tmp_path}/dead/0").collect()] == ["a_b"]


def test_change_far_ahead(spark, tmp_path):
    """A file's change may lie beyond what nanoseconds since 1970 can hold."""
    far = dt.datetime(2300, 5, 1, 12)
    rows = [(k, T0 + dt.timedelta(seconds=30 * p), 7, far) for k in (1, 2) for p in range(3)]
    spark.createDataFrame(rows, DDL).write.parquet(f"{tmp_path}/in")
    stream = stability.stable_files(spark.readStream.schema(DDL).parquet(f"{tmp_path}/in"))
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(
        availableNow=True).start().awaitTermination()
    found = spark.read.schema(stability.FILES_OUTPUT).parquet(f"{tmp_path}/out").collect()
    assert sorted((r.item, r.poll_ts, r.size, r.mod_time) for r in found) == [(k, T0 + dt.timedelta(seconds=30), 7, far) for k in (1, 2)]
