"""Emit items once they stopped growing: streaming operators and their batch forms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scanloom.operators.ordering import near, row_numbers, running_total

SERIES_OUTPUT = "item long, poll_ts timestamp_ntz, size long"
FILES_OUTPUT = "item long, poll_ts timestamp_ntz, size long, mod_time timestamp"


def _looks(observations: DataFrame, late_after: str) -> DataFrame:
    """Event time is when a look was taken: a file that no longer changes is still looked at."""
    return observations.withColumn("_polled", F.col("poll_ts").cast("timestamp")).withWatermark("_polled", late_after)


def _in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values("poll_ts", kind="stable", ignore_index=True)


def _expire(state: GroupState, last_look: object, forget_after: pd.Timedelta) -> None:
    last = pd.Timestamp(last_look) + forget_after
    state.setTimeoutTimestamp(max(last.value // 1_000_000, state.getCurrentWatermarkMs() + 1))


def stable_series(observations: DataFrame, key: str = "item", late_after: str = "1 hour", forget_after: str = "1 day") -> DataFrame:
    """Series whose image count stopped increasing between two looks (item, poll_ts, size).

    ``observations`` is a stream of key, poll_ts, size and optionally ``received``. The first look never emits; a
    larger count re-arms; a transfer whose ``received`` differs from the count stays armed (NULL: not checked). Limit the files per
    trigger so that one batch holds few looks at the same series. A series not looked at for ``forget_after`` is forgotten.
    """
    has_received = "received" in observations.columns
    keep = pd.Timedelta(forget_after)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        looks = _in_order(frames)
        known, armed = state.get if state.exists else (None, True)
        peak = looks["size"].cummax()
        before = peak.shift()
        if known is not None:
            peak, before = peak.clip(lower=known), before.fillna(known).clip(lower=known)
        up = before.isna() | (looks["size"] > before)
        run = up.cumsum()
        whole = looks["received"].isna() | (looks["received"] == peak) if has_received else True
        ready = looks.assign(size=peak, _run=run)[~up & whole]
        found = ready.drop_duplicates("_run")
        if not armed:
            found = found[found["_run"] > 0]
        last = int(run.iloc[-1])
        state.update((int(peak.iloc[-1]), bool((armed or last > 0) and not (found["_run"] == last).any())))
        _expire(state, looks["_polled"].max(), keep)
        if len(found):
            yield found.assign(item=k[0])[["item", "poll_ts", "size"]]

    return _looks(observations, late_after).groupBy(key).applyInPandasWithState(
        step, SERIES_OUTPUT, "size long, armed boolean", "append", GroupStateTimeout.EventTimeTimeout)


def stable_series_batch(observations: DataFrame, key: str = "item", order: tuple[str, ...] = ("poll_ts",)) -> DataFrame:
    """The same rule on a table: no increase at this look, after a first look or an increase."""
    numbered = row_numbers(observations, [key], list(order), "_n")
    peaked = running_total(numbered, [key], ["_n"], F.col("size"), "_peak", how="max")
    looked = near(peaked, [key], "_n", 1, 0, lambda w: {"_before": F.lag("_peak").over(w)})
    looked = looked.withColumn("_up", F.col("_before").isNull() | (F.col("size") > F.col("_before")))
    marked = near(looked, [key], "_n", 1, 0, lambda w: {"_was_up": F.lag("_up").over(w)})
    return marked.where(~F.col("_up") & F.col("_was_up")).select(key, "poll_ts", F.col("_peak").alias("size"))


def stable_files(observations: DataFrame, key: str = "item", since: object = None, late_after: str = "1 hour",
                 forget_after: str = "1 day") -> DataFrame:
    """Files whose size is equal in two looks (item, poll_ts, size, mod_time); emitted files stay silent until they change.

    ``mod_time`` is plain data: a file that stopped growing keeps it while newer files arrive. ``since`` is the
    high-water mark, see ``high_water_mark``; looks at files changed before it are ignored. A file not looked at for
    ``forget_after`` (emitted or gone from the listing) is forgotten.
    """
    keep = pd.Timedelta(forget_after)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        looks = list(frames)
        column = lambda name: np.concatenate([f[name].to_numpy() for f in looks])
        polls, changes = column("poll_ts"), column("_changed")
        order = np.argsort(polls, kind="stable")
        sizes = [None if v != v else int(v) for v in column("size")[order].tolist()]  # most items have few looks in a batch
        known, armed = state.get if state.exists else (None, True)
        before, found = known, []
        for place, size in enumerate(sizes):
            equal = size is not None and size == before
            if equal and armed:
                found.append(place)
            armed, before = not equal, known if size is None else size
        state.update((sizes[-1], armed))
        _expire(state, column("_polled").max(), keep)
        if found:
            at = order[found]
            yield pd.DataFrame({"item": k[0], "poll_ts": polls[at], "size": [sizes[n] for n in found], "_changed": changes[at]})

    if since is not None:
        observations = observations.where(F.col("mod_time") >= F.lit(since))
    # a change may lie outside what nanoseconds since 1970 can hold, so it travels as a number
    looks = observations.select(key, "poll_ts", "size", F.unix_micros(F.col("mod_time").cast("timestamp")).alias("_changed"))
    rows = _looks(looks, late_after).groupBy(key).applyInPandasWithState(
        step, "item long, poll_ts timestamp_ntz, size long, _changed long", "size long, armed boolean", "append", GroupStateTimeout.EventTimeTimeout)
    return rows.select("item", "poll_ts", "size", F.timestamp_micros("_changed").alias("mod_time"))


def high_water_mark(emitted: DataFrame):
    """Latest ``mod_time`` written so far (None before the first): it moves only with what was emitted, and survives
    a restart because it is read from the output. Pass it to ``stable_files`` when a query is started."""
    return emitted.agg(F.max("mod_time")).first()[0]


def stable_files_batch(observations: DataFrame, key: str = "item", order: tuple[str, ...] = ("poll_ts",)) -> DataFrame:
    """The same rule on a table: equal to the look before, which was the first or a change."""
    numbered = row_numbers(observations, [key], list(order), "_n")
    seen = near(numbered, [key], "_n", 2, 0, lambda w: {"_p1": F.lag("size", 1).over(w), "_p2": F.lag("size", 2).over(w)})
    changed = F.col("_p2").isNull() | (F.col("_p1") != F.col("_p2"))
    return seen.where((F.col("size") == F.col("_p1")) & changed).select(key, "poll_ts", "size")


def accept_above_mark(rows: DataFrame, time: str, emitted: str, order: tuple[str, ...]) -> DataFrame:
    """Rows not older than the high-water mark when they arrive; the mark is the latest emitted time so far."""
    marked = running_total(rows, [], list(order), F.when(F.col(emitted), F.col(time)), "_mark", how="max")
    return marked.where(F.col("_mark").isNull() | (F.col(time) >= F.col("_mark"))).drop("_mark")


def vanished(monitored: DataFrame, latest: DataFrame, key: str = "exam_id") -> DataFrame:
    """Monitored exams missing from the latest listing."""
    return monitored.join(latest.select(key), key, "left_anti")


def advance_monitor(monitored: DataFrame, outstanding: DataFrame, open_series: DataFrame, limit: int = 2) -> DataFrame:
    """Exams to watch next (exam_id, exam_ts): those still listed, the oldest leaving once all its series are done
    and a newer exam waits; free places go to the oldest exams listed. At most ``limit`` rows."""
    kept = monitored.select("exam_id").join(outstanding, "exam_id", "left_semi")
    kept = outstanding.join(kept, "exam_id", "left_semi").select("exam_id", "exam_ts")
    oldest = kept.orderBy("exam_ts", "exam_id").limit(1)
    finished = oldest.join(open_series.select("exam_id"), "exam_id", "left_anti")
    full = kept.agg(F.count(F.lit(1)) >= limit).scalar()
    waiting = outstanding.join(kept, "exam_id", "left_anti")
    more = waiting.agg(F.count(F.lit(1)) > 0).scalar()
    stay = kept.join(finished.where(full & more), "exam_id", "left_anti")
    newest = kept.agg(F.max("exam_ts")).scalar()
    fresh = waiting.where(newest.isNull() | (F.col("exam_ts") >= newest)).select("exam_id", "exam_ts")
    ranked = stay.withColumn("_p", F.lit(0)).unionAll(fresh.withColumn("_p", F.lit(1)))
    return ranked.orderBy("_p", "exam_ts", "exam_id").limit(limit).select("exam_id", "exam_ts")


def quiet_containers(updates: DataFrame, gap: str = "30 seconds", delay: str = "0 seconds") -> DataFrame:
    """Containers whose updates paused for ``gap``: (container_id, first_update, last_update, n). Stream or batch."""
    rows = updates.withWatermark("updatetime", delay) if updates.isStreaming else updates
    grouped = rows.groupBy(F.session_window("updatetime", gap).alias("w"), "container_id").agg(
        F.min("updatetime").alias("first_update"), F.max("updatetime").alias("last_update"), F.count(F.lit(1)).alias("n"))
    return grouped.select("container_id", "first_update", "last_update", "n")


def earliest_recordings(attached: DataFrame) -> DataFrame:
    """Of each scan all files of its earliest recording."""
    first = attached.groupBy("epoch_id").agg(F.min("rec_ts").alias("rec_ts"))
    return attached.join(first, ["epoch_id", "rec_ts"], "left_semi")


def attach_recordings(scans: DataFrame, recordings: DataFrame, lag_seconds: int = 30, wait_seconds: int = 60) -> DataFrame:
    """Recordings of a scan arriving at most ``wait_seconds`` after it is looked for: (epoch_id, name, rec_ts). Which
    of them is the earliest is known when the bound has passed: apply ``earliest_recordings`` to the table written.

    ``scans``: epoch_id, psd, scan_ts; ``recordings``: psd, name, rec_ts. Both may be streams; the bound lets the
    state of both sides expire. Time buckets make it an equi-join.
    """
    width = lag_seconds + wait_seconds
    bucket = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / width)
    if scans.isStreaming:
        scans = scans.withWatermark("scan_ts", "1 hour")
        recordings = recordings.withWatermark("rec_ts", "1 hour")
    left = scans.withColumn("_b", F.explode(F.array(bucket("scan_ts"), bucket("scan_ts") + 1))).alias("s")
    right = recordings.withColumn("_b", bucket("rec_ts")).alias("r")
    bound = F.make_dt_interval
    on = ((F.col("s.psd") == F.col("r.psd")) & (F.col("s._b") == F.col("r._b"))
          & (F.col("r.rec_ts") >= F.col("s.scan_ts") + bound(secs=F.lit(lag_seconds)))
          & (F.col("r.rec_ts") <= F.col("s.scan_ts") + bound(secs=F.lit(width))))
    return left.join(right, on).select("s.epoch_id", "r.name", "r.rec_ts")
