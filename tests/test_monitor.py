"""Streams with keyed state over several batches and restarts, against sequential simulations."""

import datetime as dt
import random

import pandas as pd

from scanloom.streaming import monitor, stability

T0 = dt.datetime(2024, 1, 1)
LISTED = "scanner long, poll_ts timestamp_ntz, exam_id long, exam_ts timestamp_ntz, series_id long, size long, received long"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def run(spark, folder, batches, ddl, start):
    """One query run per batch, each from the checkpoint of the one before."""
    for rows in batches:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        start(spark.readStream.schema(ddl).parquet(f"{folder}/in")).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()


def listings(seed, scanners=3, polls=40):
    """Exams come, grow, stall and go; one row per series and poll."""
    rng, rows = random.Random(seed), []
    for scanner in range(scanners):
        exams, made = {}, 0
        for poll in range(polls):
            if rng.random() < 0.3:
                exams[made] = (at(made * 100), {s: rng.randrange(1, 9) for s in range(rng.randrange(0, 4))})
                made += 1
            if exams and rng.random() < 0.05:
                exams.pop(rng.choice(list(exams)))
            for _, series in exams.values():
                for s in series:
                    series[s] += rng.randrange(1, 3) if rng.random() < 0.2 else 0
            listed = [(e, ts, s, n, rng.choice([None, None, n, 0])) for e, (ts, series) in exams.items() for s, n in (series.items() or [(None, None)])]
            rows += [(scanner, at(30 * poll), *row) for row in listed or [(None,) * 5]]
    return rows


def simulate(rows, limit=2):
    """The polling loop, one scanner and poll after the other, vanished exams first."""
    out = []
    for scanner in sorted({r[0] for r in rows}):
        watched, mark = [], None
        for poll in sorted({r[1] for r in rows if r[0] == scanner}):
            listing = [r for r in rows if r[0] == scanner and r[1] == poll and r[2] is not None]
            while True:
                listed = sorted({(r[3], r[2]) for r in listing if mark is None or r[3] >= mark})
                if watched and listed and watched[0]["id"] != listed[0][1]:
                    watched.pop(0)
                elif len(watched) > 1 and len(listed) > 1 and watched[1]["id"] != listed[1][1]:
                    watched.pop()
                else:
                    break
            new = None
            if len(watched) < limit and len(watched) < len(listed):
                new = listed[len(watched)]
            elif len(watched) == limit < len(listed) and all(not needed for _, needed in watched[0]["series"].values()):
                watched.pop(0)
                new = listed[limit]
            if new:
                watched.append({"id": new[1], "ts": new[0], "series": {}})
                if len(watched) == limit and new == listed[min(limit, len(listed) - 1)] and len(listed) > limit:
                    mark = watched[0]["ts"]
            for exam in watched:
                for r in listing:
                    if r[2] != exam["id"] or r[4] is None:
                        continue
                    known = exam["series"].get(r[4])
                    if known is None or r[5] > known[0]:
                        exam["series"][r[4]] = (r[5], True)
                    elif known[1] and r[6] in (None, known[0]):
                        exam["series"][r[4]] = (known[0], False)
                        out.append((scanner, r[2], r[4], poll, known[0]))
    return sorted(out)


def test_monitored_exams_over_batches_and_restarts(spark, tmp_path):
    rows = listings(4)
    polls = sorted({r[1] for r in rows})
    cuts = [polls[0], polls[7], polls[8], polls[25], at(10**6)]
    batches = [[r for r in rows if low <= r[1] < high] for low, high in zip(cuts, cuts[1:])]
    split = batches[1] + batches[2][:len(batches[2]) // 2], batches[2][len(batches[2]) // 2:]  # a poll's rows over two batches
    end = [(s, at(10**5), None, None, None, None, None) for s in range(3)]
    start = lambda s: monitor.monitored_series(s, late_after="1 hour").writeStream.format("parquet").option("path", f"{tmp_path}/out")
    run(spark, tmp_path, [batches[0], *split, batches[3], end], LISTED, start)
    got = sorted(tuple(r) for r in spark.read.schema(monitor.MONITORED).parquet(f"{tmp_path}/out").collect())
    want = simulate(rows)
    assert got == want and len(want) > 20


def test_exam_leaves_when_done(spark):
    m = monitor.Monitor(2)
    look = lambda *rows: m.look(pd.DataFrame(rows, columns=["exam_id", "exam_ts", "series_id", "size", "received"]))
    three = lambda n: [(1, 10, 1, 5, None), (2, 20, 1, n, None), (3, 30, 1, 7, None)]
    assert look(*three(1)) == [] and [e[0] for e in m.exams] == [1]
    assert look(*three(2)) == [(1, 1, 5)] and [e[0] for e in m.exams] == [1, 2]
    assert look(*three(3)) == [] and [e[0] for e in m.exams] == [2, 3] and m.mark == 20
    assert look(*three(3)[1:2]) == [(2, 1, 3)] and look((3, 30, 1, 7, None)) == [(3, 1, 7)] and [e[0] for e in m.exams] == [3]


def test_mark_moves_inside_one_run(spark, tmp_path):
    """One run of several micro-batches: a file older than the newest emission of this run is ignored."""
    ddl = "item long, poll_ts timestamp_ntz, size long, mod_time timestamp"
    looks = [[(1, at(0), 5, at(50)), (2, at(0), 7, at(10))], [(1, at(30), 5, at(50)), (2, at(30), 8, at(10))],
             [(2, at(60), 8, at(10)), (3, at(60), 1, at(50))], [(2, at(90), 8, at(10)), (3, at(90), 1, at(50))]]
    sink = monitor.MarkedSink(f"{tmp_path}/out")
    for n, rows in enumerate(looks):
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    stability.stable_files(stream).writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.item, r.poll_ts) for r in sink.rows(spark).collect()) == [(1, at(30)), (3, at(90))]  # 2 changed before 1
    marks = [r.mark for r in spark.read.parquet(f"{tmp_path}/out/marks").orderBy("batch").collect()]
    assert len(marks) >= 4 and marks[0] is None and marks[-1] == at(50) and sink.mark(spark) == at(50)


def test_repeated_batch_writes_the_same(spark, tmp_path):
    sink = monitor.MarkedSink(str(tmp_path))
    frame = lambda *rows: spark.createDataFrame(list(rows), stability.FILES_OUTPUT)
    sink(frame((1, at(0), 5, at(50))), 0)
    late = frame((2, at(1), 5, at(40)), (3, at(1), 5, at(60)), (4, at(1), 5, at(55)), (5, at(2), 5, at(55)))
    for _ in range(2):
        sink(late, 1)
        assert sorted(r.item for r in sink.rows(spark).collect()) == [1, 3, 4]  # 5 is looked at after 3 moved the mark
        assert sink.mark(spark, 1) == at(50) and sink.mark(spark) == at(60)


def test_recording_outcomes(spark, tmp_path):
    ddl = "kind string, id long, psd string, ts timestamp_ntz"
    scan, rec = (lambda i, s, psd="a": ("scan", i, psd, at(s))), (lambda i, s, psd="a": ("rec", i, psd, at(s)))
    clock = lambda s: [scan(-1, s, "clock"), rec(-1, s, "clock")]
    batches = [[scan(1, 100), scan(2, 100, "b"), scan(3, 5000)], [rec(10, 131), rec(11, 131), rec(12, 150), rec(13, 129), rec(14, 191, "b"), *clock(120)],
               [rec(20, 5089), rec(21, 5091), *clock(9000)], [rec(30, 135), rec(31, 145, "b"), *clock(9500)],  # too late for 1 and 2
               [scan(4, 9000), *clock(30000)]]

    def start(stream):
        scans = stream.where("kind = 'scan'").selectExpr("id as epoch_id", "psd", "ts as scan_ts")
        recordings = stream.where("kind = 'rec'").selectExpr("psd", "cast(id as string) as name", "ts as rec_ts")
        return monitor.recording_outcomes(scans, recordings, 30, 60, "10 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out")
    run(spark, tmp_path, batches, ddl, start)
    got = {r.epoch_id: (r.outcome, r.rec_ts, r.names) for r in spark.read.schema(monitor.OUTCOMES).parquet(f"{tmp_path}/out").collect() if r.epoch_id > 0}
    assert got == {1: (monitor.FOUND, at(131), ["10", "11"]), 2: (monitor.NOT_FOUND, None, []), 3: (monitor.FOUND, at(5089), ["20"]), 4: (monitor.NOT_FOUND, None, [])}


def test_sink_gathers_no_polls(spark, tmp_path, monkeypatch):
    """Marks of a batch's polls are computed in the cluster: the driver gets single rows only."""
    kind = type(spark.range(1))
    collect, largest = kind.collect, []

    def counted(self):
        rows = collect(self)
        largest.append(len(rows))
        return rows
    found = spark.createDataFrame([(n, at(n), 5, at(n % 7)) for n in range(50)], stability.FILES_OUTPUT)
    sink = monitor.MarkedSink(str(tmp_path))
    monkeypatch.setattr(kind, "collect", counted)
    sink(found, 0)
    monkeypatch.undo()
    assert max(largest, default=0) <= 1
    mark, want = None, []
    for n in range(50):
        if mark is None or n % 7 >= mark:
            want.append(n)
        mark = n % 7 if mark is None else max(mark, n % 7)
    assert sorted(r.item for r in sink.rows(spark).collect()) == want


def test_many_polls_in_one_batch_take_little_memory(spark):
    """A scanner's rows are kept as numbers: well under 200 bytes each, not lists of objects."""
    import tracemalloc

    steps = []

    class Listings:
        withColumn = withWatermark = groupBy = lambda self, *a: self

        def applyInPandasWithState(self, step, *a):
            steps.append(step)

    class State:
        exists, hasTimedOut = False, False
        update = setTimeoutTimestamp = lambda self, *a: None
        getCurrentWatermarkMs = lambda self: 0

    monitor.monitored_series(Listings())
    n = 20_000
    frame = pd.DataFrame({"poll_ts": [at(k // 1000) for k in range(n)], "exam_id": range(n), "exam_ts": at(0), "series_id": 1, "size": 2, "received": None})
    tracemalloc.start()
    try:
        list(steps[0]((0,), iter([frame]), State()))
        assert tracemalloc.get_traced_memory()[1] < 200 * n
    finally:
        tracemalloc.stop()
