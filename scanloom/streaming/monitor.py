"""Keyed stream state for the polling loops: monitored exams, the mark of emitted files, recordings looked for twice."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scanloom.operators.ordering import running_total

NOT_FOUND = "no physio files found"  # fixed values: outcomes of a lookup
FOUND = "physio files found"
MONITORED = "scanner long, exam_id long, series_id long, poll_ts timestamp_ntz, size long"
OUTCOMES = "epoch_id long, outcome string, rec_ts timestamp_ntz, names array<string>"


class Monitor:
    """At most ``limit`` exams of one scanner, oldest first; each listing moves them one step."""

    def __init__(self, limit: int, saved: dict | None = None):
        self.limit = limit
        saved = saved or {"mark": None, "exams": [], "done": None}
        self.mark, self.exams, self.done = saved["mark"], saved["exams"], saved["done"]

    def saved(self) -> dict:
        return {"mark": self.mark, "exams": self.exams, "done": self.done}

    def _watch(self, listed: list[list]) -> None:
        for place in range(min(self.limit, len(listed))):
            while place < len(self.exams) and self.exams[place][0] != listed[place][0]:
                self.exams.pop(place)  # gone from the scanner
        if len(self.exams) < min(self.limit, len(listed)):
            self.exams.append([*listed[len(self.exams)], {}])
        elif len(self.exams) == self.limit < len(listed) and not any(needed for _, needed in self.exams[0][2].values()):
            self.exams = [*self.exams[1:], [*listed[self.limit], {}]]
            self.mark = self.exams[0][1]

    def look(self, listing: pd.DataFrame) -> list[tuple[int, int, int]]:
        """One listing (exam_id, exam_ts, series_id, size, received); returns the series that stopped growing."""
        exams = listing.dropna(subset=["exam_id"])
        times = exams.groupby("exam_id")["exam_ts"].min()
        listed = sorted(([int(e), t] for e, t in times.items() if self.mark is None or t >= self.mark), key=lambda e: (e[1], e[0]))
        self._watch(listed)
        out = []
        for exam, _, series in self.exams:
            own = exams[(exams["exam_id"] == exam) & exams["series_id"].notna()]
            for row in own.itertuples():
                key, size = str(int(row.series_id)), int(row.size)
                known, needed = series.get(key, (None, True))
                if known is None or size > known:
                    series[key] = [size, True]
                elif needed and (pd.isna(row.received) or int(row.received) == known):
                    series[key] = [known, False]
                    out.append((exam, int(key), known))
        return out


def monitored_series(listings: DataFrame, limit: int = 2, late_after: str = "1 hour", forget_after: str = "1 day") -> DataFrame:
    """Series that stopped growing while their exam was watched: (scanner, exam_id, series_id, poll_ts, size).

    ``listings`` is a stream (or table) of scanner, poll_ts, exam_id, exam_ts, series_id, size, received: all exams a
    scanner lists at a poll, one row a series (``series_id`` NULL: an exam without; ``exam_id`` NULL: nothing listed;
    ``received`` NULL: not checked). Only the ``limit`` oldest exams are watched. The oldest leaves once all its series
    were emitted and a further exam waits; the mark then moves to the next, and older exams are ignored. An exam that is
    not listed any more leaves too. State of a scanner: those exams' series and the last poll's rows, which wait for a
    later poll or for the watermark, so a poll may be spread over batches. Looks at polls already done are dropped. A
    scanner without looks for ``forget_after`` is forgotten.
    """
    keep = pd.Timedelta(forget_after)
    columns = ["poll_ts", "exam_id", "exam_ts", "series_id", "size", "received"]

    def numbers(frame: pd.DataFrame) -> pd.DataFrame:
        """Whole numbers (nanoseconds for times), NULLs beside them: a few bytes a row."""
        clock = lambda c: frame[c].astype("datetime64[ns]").astype("int64").astype("Int64")
        seen = frame["exam_ts"].notna()
        return pd.DataFrame({c: clock(c) if c == "poll_ts" else clock(c).where(seen) if c == "exam_ts" else frame[c].astype("Int64") for c in columns})

    def plain(column: pd.Series) -> pd.Series:
        return column.astype("float64" if column.hasnans else "int64")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        saved, held = [json.loads(text) for text in state.get] if state.exists else (None, [])
        monitor = Monitor(limit, saved)
        if state.hasTimedOut and not held:
            state.remove()
            return
        parts = [pd.DataFrame(held, columns=columns).astype("Int64")]
        for frame in () if state.hasTimedOut else frames:
            part = numbers(frame)
            parts.append(part if monitor.done is None else part[part["poll_ts"] > monitor.done])
        rows = pd.concat(parts, ignore_index=True)
        parts.clear()
        polls, starts, order = [], [], []
        if len(rows):
            at = rows["poll_ts"].to_numpy("int64")
            order = np.argsort(at, kind="stable")
            found, first = np.unique(at[order], return_index=True)
            polls, starts = found.tolist(), [*first.tolist(), len(rows)]
        ready = polls if state.hasTimedOut else polls[:-1]
        out = []
        for n, poll in enumerate(ready):
            listing = rows.iloc[order[starts[n]:starts[n + 1]]].apply(plain)
            out += [(key[0], *series, pd.Timestamp(poll)) for series in monitor.look(listing)]
            monitor.done = poll
        last = rows.iloc[order[starts[len(ready)]:]] if len(ready) < len(polls) else rows.iloc[:0]
        held = [[None if pd.isna(v) else int(v) for v in r] for r in last.itertuples(index=False, name=None)]
        due = pd.Timestamp(polls[-1]) if held else pd.Timestamp(monitor.done or 0) + keep
        state.update((json.dumps(monitor.saved()), json.dumps(held)))
        state.setTimeoutTimestamp(max(due.value // 1_000_000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["scanner", "exam_id", "series_id", "size", "poll_ts"])[["scanner", "exam_id", "series_id", "poll_ts", "size"]]

    timed = listings.withColumn("_polled", F.col("poll_ts").cast("timestamp")).withWatermark("_polled", late_after)
    return timed.groupBy("scanner").applyInPandasWithState(step, MONITORED, "saved string, held string", "append", GroupStateTimeout.EventTimeTimeout)


class MarkedSink:
    """Writes files that stopped growing (``stable_files``), and moves the mark with them: ``foreachBatch(sink)``.

    A file changed before the mark, the latest change among files emitted at earlier looks, is ignored. Each batch
    writes its rows and its mark below its own number, so a repeated batch starts from the same mark and writes the
    same rows. The mark is read from the last batch alone.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def _marks(self, spark) -> DataFrame:
        return spark.read.schema("batch long, mark timestamp").parquet(f"{self.folder}/marks")

    def mark(self, spark, before: int | None = None):
        """The mark after all batches, or before batch ``before`` (None before the first emitted file)."""
        try:
            marks = self._marks(spark)
        except Exception as missing:  # before the first batch
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return None
        if before is not None:
            marks = marks.where(F.col("batch") < before)
        return marks.agg(F.max_by("mark", "batch")).first()[0]

    def rows(self, spark) -> DataFrame:
        return spark.read.option("basePath", f"{self.folder}/rows").parquet(f"{self.folder}/rows/*").drop("batch")

    def __call__(self, found: DataFrame, batch: int) -> None:
        spark = found.sparkSession
        start = self.mark(spark, batch)
        found = found.persist()
        try:
            polls = found.groupBy("poll_ts").agg(F.max("mod_time").alias("_latest"))  # one row a poll of this batch
            before = polls.select("poll_ts", F.lit(0).alias("_side"), F.lit(None).cast("timestamp").alias("_latest"))
            reached = running_total(before.unionAll(polls.select("poll_ts", F.lit(1), "_latest")), [], ["poll_ts", "_side"], F.col("_latest"), "_mark", how="max")
            known = reached.where("_side = 0").select("poll_ts", F.greatest("_mark", F.lit(start).cast("timestamp")).alias("_mark"))
            kept = found.join(known, "poll_ts").where(F.col("_mark").isNull() | (F.col("mod_time") >= F.col("_mark")))
            kept.select(found.columns).write.mode("overwrite").parquet(f"{self.folder}/rows/batch={batch}")
            after = found.agg(F.greatest(F.max("mod_time"), F.lit(start).cast("timestamp")).alias("mark"))
            after.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/marks/batch={batch}")
        finally:
            found.unpersist()


def recording_outcomes(scans: DataFrame, recordings: DataFrame, lag_seconds: int = 30, wait_seconds: int = 60, late_after: str = "10 minutes") -> DataFrame:
    """One outcome per scan, once its time is over: (epoch_id, outcome, rec_ts, names).

    A scan (epoch_id, psd, scan_ts) looks for recordings (psd, name, rec_ts) from ``lag_seconds`` to ``lag_seconds +
    wait_seconds`` after it, and gets all files of the earliest, or NOT_FOUND. State is kept per psd and time bucket; a
    recording is sent to its own bucket and the one before, so each scan's answer lies in one. Recordings later than
    ``late_after`` are too late. Both inputs are streams; the clock is that of the slower one.
    """
    width = lag_seconds + wait_seconds
    bucket = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / width)
    no = lambda kind: F.lit(None).cast(kind)
    asked = scans.select("psd", bucket("scan_ts").alias("bucket"), F.col("scan_ts").cast("timestamp").alias("at"), "epoch_id", no("string").alias("name"))
    given = (recordings.withColumn("bucket", F.explode(F.array(bucket("rec_ts"), bucket("rec_ts") - 1)))
             .select("psd", "bucket", F.col("rec_ts").cast("timestamp").alias("at"), no("long").alias("epoch_id"), "name"))
    lag, span = pd.Timedelta(seconds=lag_seconds).value, pd.Timedelta(seconds=width).value

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, known = [json.loads(text) for text in state.get] if state.exists else ([], [])
        for frame in () if state.hasTimedOut else frames:
            for at, epoch, name in zip(frame["at"], frame["epoch_id"], frame["name"]):
                (known if pd.isna(epoch) else waiting).append([pd.Timestamp(at).value, name if pd.isna(epoch) else int(epoch)])
        now = state.getCurrentWatermarkMs() * 1_000_000
        due = [(at, epoch) for at, epoch in waiting if at + span < now]
        waiting = [w for w in waiting if w[0] + span >= now]
        out = []
        for at, epoch in due:
            first = min((t for t, _ in known if at + lag <= t <= at + span), default=None)
            out.append((epoch, NOT_FOUND if first is None else FOUND, None if first is None else pd.Timestamp(first),
                        [] if first is None else sorted({n for t, n in known if t == first})))
        # recordings stay while a scan that is not late could still ask for them
        known = [k for k in known if k[0] - lag >= now or waiting]
        if waiting or known:
            state.update((json.dumps(waiting), json.dumps(known)))
            ends = min(t + span for t, _ in waiting) if waiting else max(t - lag for t, _ in known)
            state.setTimeoutTimestamp(max(ends // 1_000_000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["epoch_id", "outcome", "rec_ts", "names"])

    both = asked.withWatermark("at", late_after).unionByName(given.withWatermark("at", late_after))
    return both.groupBy("psd", "bucket").applyInPandasWithState(step, OUTCOMES, "waiting string, known string", "append", GroupStateTimeout.EventTimeTimeout)
