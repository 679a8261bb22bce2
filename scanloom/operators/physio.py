"""Physiological-noise regressors from respiration and pulse recordings.

Inputs: ``signal`` (acq_id, kind, idx, value) with kinds resp_wave, resp_trig, card_wave, card_trig, and
``timing`` (acq_id, tr, nframes, slice, onset, slice_window, card_dt, resp_dt). Everything is keyed joins and
aggregations over samples, triggers and slice times; neighbours come from bounded blocks or as-of buckets.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.catalog import Catalog
from scanloom.operators.matching import asof, bracket, physio_files, range_join, window_moments
from scanloom.operators.ordering import convolve, near
from scanloom.session import cut_lineage

# Regressor names in their output order, and limits of plausible recordings.
REGRESSORS = ("c1_c", "s1_c", "c2_c", "s2_c", "c1_r", "s1_r", "c2_r", "s2_r",
              "rv_rrf", "rv_rrf_d", "hr_crf", "hr_crf_d", "hr")
MIN_FRAMES = 8
MIN_CARD_STD = 4.0
MIN_RESP_RATIO = 40.0
MIN_GOOD_RATE = 0.2
MIN_TREND_FRAMES = 3
REJECTED = "rejected: too few frames"
HISTOGRAM_BINS = 100
FILTER_TAPS = 20
FILTER_CUTOFF = 1.0
HALF_WINDOW = 3.0
RESPONSE_SECONDS = 40.0


def scan_lengths(timing: DataFrame) -> DataFrame:
    """One row per acquisition: tr, nframes, duration and sampling steps."""
    return timing.groupBy("acq_id").agg(*[F.first(c).alias(c) for c in ("tr", "nframes", "card_dt", "resp_dt")]).withColumn(
        "duration", F.col("tr") * F.greatest(F.col("nframes"), F.lit(1)))


def align(signal: DataFrame, timing: DataFrame) -> DataFrame:
    """Signals with ``time``, zero at the start of the scan: recordings end with it.

    Pulse triggers use the pulse clock; respiration triggers keep their sample index.
    """
    scan = scan_lengths(timing)
    sizes = signal.where(F.col("kind").isin("resp_wave", "card_wave")).groupBy("acq_id").agg(
        F.max(F.when(F.col("kind") == "resp_wave", F.col("idx"))).alias("_r"),
        F.max(F.when(F.col("kind") == "card_wave", F.col("idx"))).alias("_c"))
    rows = signal.join(scan, "acq_id").join(sizes, "acq_id")
    resp_offset = F.col("resp_dt") * (F.col("_r") + 1) - F.col("duration")
    card_offset = F.col("card_dt") * (F.col("_c") + 1) - F.col("duration")
    time = (F.when(F.col("kind") == "resp_wave", F.col("resp_dt") * F.col("idx") - resp_offset)
            .when(F.col("kind") == "card_wave", F.col("card_dt") * F.col("idx") - card_offset)
            .when(F.col("kind") == "card_trig", F.col("value") * F.col("card_dt") - card_offset))
    return rows.select("acq_id", "kind", "idx", "value", time.alias("time"))


def chopped(aligned: DataFrame, kind: str) -> DataFrame:
    """Samples or triggers from the first positive time on (all of them when none is positive), renumbered."""
    rows = aligned.where(F.col("kind") == kind)
    start = rows.groupBy("acq_id").agg(F.min(F.when(F.col("time") > 0, F.col("idx"))).alias("_start"), F.min("idx").alias("_first"))
    start = start.select("acq_id", F.coalesce("_start", "_first").alias("_start"))
    return rows.join(start, "acq_id").where(F.col("idx") >= F.col("_start")).select(
        "acq_id", (F.col("idx") - F.col("_start")).alias("idx"), "value", "time")


def slice_window(onsets: DataFrame) -> DataFrame:
    """Gap between sorted distinct onsets per acquisition: (acq_id, slice_window, uneven).

    0 with a single onset; ``uneven`` marks acquisitions whose gaps differ (a window must be given then).
    An acquisition has as many onsets as slices.
    """
    w = Window.partitionBy("acq_id").orderBy("onset")
    gaps = onsets.select("acq_id", "onset").distinct().withColumn("gap", F.col("onset") - F.lag("onset").over(w))
    first = gaps.groupBy("acq_id").agg(F.min_by("gap", F.when(F.col("gap").isNotNull(), F.col("onset"))).alias("first"),
                                       F.max("gap").alias("high"), F.min("gap").alias("low"))
    slack = F.lit(1e-8) + F.lit(1e-5) * F.abs("first")
    uneven = (F.abs(F.col("high") - F.col("first")) > slack) | (F.abs(F.col("low") - F.col("first")) > slack)
    return first.select("acq_id", F.coalesce("first", F.lit(0.0)).alias("slice_window"), F.coalesce(uneven, F.lit(False)).alias("uneven"))


def slice_times(timing: DataFrame) -> DataFrame:
    """Middle of every slice's acquisition: (acq_id, slice, frame, time), exactly ``nframes`` per slice."""
    return timing.withColumn("frame", F.explode(F.sequence(F.lit(0), F.col("nframes").cast("int") - 1))).select(
        "acq_id", "slice", "frame", (F.col("onset") + F.col("slice_window") / 2 + F.col("frame") * F.col("tr")).alias("time"))


def trigger_neighbours(times: DataFrame, triggers: DataFrame, timing: DataFrame) -> DataFrame:
    """Last trigger before and first after each slice time; 0 and the scan's end where there is none."""
    sides = bracket(times, triggers.select("acq_id", "time"), ["acq_id"], "time", [], False)
    sides = sides.select("acq_id", "time", F.col("before.matched_at").alias("_b"), F.col("after.matched_at").alias("_a"))
    scan = scan_lengths(timing).select("acq_id", (F.col("nframes") * F.col("tr")).alias("_end"))
    return (times.join(sides, ["acq_id", "time"]).join(scan, "acq_id")
            .select(*times.columns, F.coalesce("_b", F.lit(0.0)).alias("t1"), F.coalesce("_a", "_end").alias("t2")))


def cardiac_phase(times: DataFrame, triggers: DataFrame, timing: DataFrame) -> DataFrame:
    """Phase inside the heart beat at each slice time: (acq_id, slice, frame, phase)."""
    rows = trigger_neighbours(times, triggers, timing)
    turn = (F.col("time") - F.col("t1")) * F.lit(2.0 * math.pi)
    return rows.select("acq_id", "slice", "frame", F.try_divide(turn, F.col("t2") - F.col("t1")).alias("phase"))


def stepped(df: DataFrame, resp_dt: float | DataFrame) -> DataFrame:
    """``df`` with ``_dt``: one sampling step for all recordings, or a table (acq_id, resp_dt) of their own."""
    if isinstance(resp_dt, DataFrame):
        return df.join(resp_dt.select("acq_id", F.col("resp_dt").cast("double").alias("_dt")), "acq_id")
    return df.withColumn("_dt", F.lit(float(resp_dt)))


def lowpass_taps(dt: float, taps: int = FILTER_TAPS, cutoff: float = FILTER_CUTOFF) -> np.ndarray:
    """Windowed-sinc (Hamming) low-pass of unit gain at zero frequency."""
    relative = cutoff * 2.0 * dt
    place = np.arange(taps) - (taps - 1) / 2.0
    kernel = relative * np.sinc(relative * place) * np.hamming(taps)
    return kernel / kernel.sum()


def lowpass_weights(dt: str | Column, taps: int = FILTER_TAPS, cutoff: float = FILTER_CUTOFF) -> Column:
    """Array of the 2 * taps - 1 weights of the low-pass run forward and backward, for a column of sampling steps."""
    relative = (F.col(dt) if isinstance(dt, str) else dt) * (2.0 * cutoff)
    shape = []
    for place, window in zip(np.arange(taps) - (taps - 1) / 2.0, np.hamming(taps)):
        angle = relative * float(math.pi * place)
        shape.append((F.lit(1.0) if place == 0 else F.when(angle == 0, 1.0).otherwise(F.sin(angle) / angle)) * float(window))
    kernel = F.array(*shape)
    scaled = lambda k: F.transform(k, lambda v: v / F.aggregate(k, F.lit(0.0), lambda a, b: a + b))
    both = lambda k: F.transform(F.sequence(F.lit(1 - taps), F.lit(taps - 1)), lambda o: F.aggregate(
        F.transform(F.sequence(F.lit(0), F.lit(taps - 1)), lambda i: F.get(k, i) * F.coalesce(F.get(k, i + o), F.lit(0.0))), F.lit(0.0), lambda a, b: a + b))
    return both(scaled(kernel))


def zero_phase(wave: DataFrame, resp_dt: float | DataFrame) -> DataFrame:
    """The wave filtered forward and backward: (acq_id, idx, smooth).

    Both passes together are one symmetric kernel of 2 * taps - 1 weights, of each recording's own sampling step. Ends
    are continued by point reflection, which the kernel reaches by at most taps - 1 samples.
    """
    reach = FILTER_TAPS - 1
    ends = wave.groupBy("acq_id").agg(F.min_by("value", "idx").alias("_head"), F.max_by("value", "idx").alias("_tail"),
                                      F.max("idx").alias("_n"))
    rows = wave.select("acq_id", "idx", "value").join(ends, "acq_id")
    place = lambda idx, value: F.struct(idx.cast("long").alias("idx"), value.alias("value"))
    i, v = F.col("idx"), F.col("value")
    copies = F.filter(F.array(
        place(i, v),
        F.when((i >= 1) & (i <= reach), place(-i, 2 * F.col("_head") - v)),
        F.when((i < F.col("_n")) & (i >= F.col("_n") - reach), place(2 * F.col("_n") - i, 2 * F.col("_tail") - v))),
        lambda s: s.isNotNull())
    extended = rows.select("acq_id", "_n", F.explode(copies).alias("_s")).select("acq_id", "_n", "_s.idx", "_s.value")

    def around(w):
        return {"_around": F.array(*[F.coalesce(F.lag("value", -offset).over(w), F.lit(0.0)) for offset in range(-reach, reach + 1)])}
    found = near(extended, ["acq_id"], "idx", reach, reach, around)
    found = found.where((F.col("idx") >= 0) & (F.col("idx") <= F.col("_n"))).select("acq_id", "idx", "_around")
    weights = stepped(ends.select("acq_id"), resp_dt)
    kernels = weights.select("_dt").distinct().withColumn("_weights", lowpass_weights("_dt"))  # one row per step in use
    smooth = F.aggregate(F.zip_with("_around", "_weights", lambda x, w: x * w), F.lit(0.0), lambda a, b: a + b)
    return found.join(weights.join(kernels, "_dt"), "acq_id").select("acq_id", "idx", smooth.alias("smooth"))


def slope_sign(smooth: DataFrame) -> DataFrame:
    """Sign of the step to the next sample: (acq_id, idx, sign); the last sample has none."""
    step = near(smooth, ["acq_id"], "idx", 0, 1, lambda w: {"_next": F.lead("smooth", 1).over(w)})
    return step.where("_next is not null").select("acq_id", "idx", F.signum(F.col("_next") - F.col("smooth")).alias("sign"))


def wave_levels(wave: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Range of the (zero-based) wave per acquisition: (acq_id, low, n, start, step) of an equal-width histogram."""
    span = wave.groupBy("acq_id").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n"))
    width = F.col("high") - F.col("low")
    flat = width == 0
    return span.select("acq_id", "low", "n", F.when(flat, -0.5).otherwise(0.0).alias("start"),
                       (F.when(flat, 1.0).otherwise(width) / float(bins)).alias("step"))


def histogram(wave: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts per bin: (acq_id, bin, n_bin, below) with ``below`` = samples in lower bins; the last bin is closed.

    Empty bins are absent; every acquisition has at most ``bins`` rows.
    """
    rows = wave.join(wave_levels(wave, bins), "acq_id")
    v = F.col("value") - F.col("low")
    edge = lambda k: F.col("start") + k * F.col("step")
    guess = F.least(F.floor((v - F.col("start")) / F.col("step")), F.lit(bins - 1))
    placed = rows.withColumn("_g", guess)
    settled = F.when(v < edge(F.col("_g")), F.col("_g") - 1).when(
        (v >= edge(F.col("_g") + 1)) & (F.col("_g") < bins - 1), F.col("_g") + 1).otherwise(F.col("_g"))
    counts = placed.withColumn("bin", settled).groupBy("acq_id", "bin").agg(F.count(F.lit(1)).alias("n_bin"))
    w = Window.partitionBy("acq_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("below", F.coalesce(F.sum("n_bin").over(w), F.lit(0)))


def respiratory_phase(times: DataFrame, wave: DataFrame, resp_dt: float | DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Phase from the amplitude histogram, signed by the slope: (acq_id, slice, frame, phase).

    The sample nearest in time (half to even, kept inside the slope's range) gives the amplitude; its nearest bin
    edge (the lower one on ties) gives the share of samples below.
    """
    levels = wave_levels(wave, bins)
    sample = F.greatest(F.lit(0), F.bround(F.col("time") / F.col("_dt"))).cast("long")
    asks = stepped(times.join(levels, "acq_id"), resp_dt).withColumn("idx", F.least(sample, F.col("n") - 2))
    signs = slope_sign(zero_phase(wave, resp_dt))
    hit = asks.join(wave.select("acq_id", F.col("idx").cast("long").alias("idx"), "value"), ["acq_id", "idx"]).join(
        signs, ["acq_id", "idx"])
    nearest = F.ceil((F.col("value") - F.col("low") - F.col("start")) / F.col("step") - 0.5)
    hit = cut_lineage(hit.withColumn("edge", F.greatest(F.lit(0), F.least(nearest, F.lit(bins)))))
    counts = histogram(wave, bins)
    shares = (hit.select("acq_id", "edge").distinct().join(counts.select("acq_id", "bin", "n_bin"), "acq_id")
              .where(F.col("bin") < F.col("edge")).groupBy("acq_id", "edge").agg(F.sum("n_bin").alias("below")))
    joined = hit.join(shares, ["acq_id", "edge"], "left")
    phase = F.lit(math.pi) * F.col("sign") * (F.coalesce("below", F.lit(0)).cast("double") / F.col("n"))
    return joined.select("acq_id", "slice", "frame", phase.alias("phase"))


def fourier_terms(cardiac: DataFrame, respiratory: DataFrame) -> DataFrame:
    """Cosine and sine of one and two times both phases, one column per regressor."""
    rows = cardiac.withColumnRenamed("phase", "c").join(respiratory.withColumnRenamed("phase", "r"), ["acq_id", "slice", "frame"])
    out = [fn(F.col(p) * k).alias(f"{short}{k}_{p}") for p in ("c", "r") for k in (1, 2) for fn, short in ((F.cos, "c"), (F.sin, "s"))]
    return rows.select("acq_id", "slice", "frame", *out)


def _kernel(shape) -> Column:
    """Array of ``shape(t)`` on 0, tr, 2 tr, … below 40 s - tr, scaled to a maximum of 1."""
    count = F.ceil((F.lit(RESPONSE_SECONDS) - F.col("tr")) / F.col("tr")).cast("int")
    values = F.transform(F.sequence(F.lit(0), count - 1), lambda k: shape(k.cast("double") * F.col("tr")))
    return F.transform(values, lambda v: v / F.array_max(values))


def respiration_response(t: Column) -> Column:
    return F.lit(0.6) * F.pow(t, F.lit(2.1)) * F.exp(-t / 1.6) - F.lit(0.0023) * F.pow(t, F.lit(3.54)) * F.exp(-t / 4.25)


def cardiac_response(t: Column) -> Column:
    normal = F.exp(-F.pow((t - 12.0) / 3.0, F.lit(2.0)) / 2.0) / F.lit(3.0 * math.sqrt(2.0 * math.pi))
    return F.lit(0.6) * F.pow(t, F.lit(2.7)) * F.exp(-t / 1.6) - F.lit(16.0) * normal


def _response(df: DataFrame, timing: DataFrame, value: str, shape, name: str) -> DataFrame:
    """Demeaned ``value`` per slice convolved with a response, and its difference (first repeated)."""
    place = ["acq_id", "slice"]
    mean = df.groupBy(*place).agg(F.avg(value).alias("_mean"))
    centred = df.join(mean, place).withColumn("_v", F.col(value) - F.col("_mean")).join(
        scan_lengths(timing).select("acq_id", _kernel(shape).alias("_kernel")), "acq_id")
    centred = cut_lineage(centred)
    folded = convolve(centred.select(*place, "frame", "_v", "_kernel"), place, "frame", "_v", F.col("_kernel"), name)
    step = near(folded.select(*place, "frame", name), place, "frame", 1, 1, lambda w: {
        f"{name}_d": F.coalesce(F.col(name) - F.lag(name).over(w), F.lead(name).over(w) - F.col(name))})
    return step.select(*place, "frame", name, f"{name}_d")


def windowed_deviation(times: DataFrame, wave: DataFrame, resp_dt: float | DataFrame) -> DataFrame:
    """Population deviation of the wave within 3 s around each slice time: (acq_id, slice, frame, rv)."""
    n = wave.groupBy("acq_id").agg(F.count(F.lit(1)).alias("n"))
    index = lambda shift: F.floor((F.col("time") + F.lit(shift)) / F.col("_dt"))
    spans = stepped(times.join(n, "acq_id"), resp_dt).select(
        "acq_id", "slice", "frame", F.greatest(F.lit(0), index(-HALF_WINDOW)).alias("low"),
        (F.least(F.col("n"), index(HALF_WINDOW)) - 1).alias("high"))
    points = wave.select("acq_id", F.col("idx").cast("long").alias("point"), "value")
    found = window_moments(spans, points, ["acq_id"], "low", "high", "point", "value", 256)
    return found.select("acq_id", "slice", "frame", F.col("_std").alias("rv"))


def respiration_variation(times: DataFrame, wave: DataFrame, timing: DataFrame, resp_dt: float | DataFrame) -> DataFrame:
    return _response(cut_lineage(windowed_deviation(times, wave, resp_dt)), timing, "rv", respiration_response, "rv_rrf")


def heart_rates(triggers: DataFrame, low: float = 30.0, high: float = 180.0) -> DataFrame:
    """Plausible instantaneous rates at the middle of each beat: (acq_id, time, rate)."""
    last = cut_lineage(asof(triggers, triggers, ["acq_id"], "time", [], "backward", False).where("matched_at is not null"))
    gap = F.col("time") - F.col("matched_at")
    return last.select("acq_id", (F.col("matched_at") + gap / 2).alias("time"), (F.lit(60.0) / gap).alias("rate")).where(
        (F.col("rate") >= low) & (F.col("rate") <= high))


def interpolate_rate(times: DataFrame, rates: DataFrame) -> DataFrame:
    """Rate at slice times: linear between beats, clamped at the ends, 0 with two or fewer plausible beats."""
    count = rates.groupBy("acq_id").agg(F.count(F.lit(1)).alias("n"))
    sides = bracket(times, rates, ["acq_id"], "time", ["rate"], True).select(
        "acq_id", "time", F.col("before.matched_at").alias("x0"), F.col("before.rate").alias("y0"),
        F.col("after.matched_at").alias("x1"), F.col("after.rate").alias("y1"))
    rows = times.join(sides, ["acq_id", "time"]).join(count, "acq_id", "left")
    slope = (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))
    line = (F.when(F.col("x0").isNull(), F.col("y1")).when(F.col("x1").isNull() | (F.col("x1") == F.col("x0")), F.col("y0"))
            .otherwise(slope * (F.col("time") - F.col("x0")) + F.col("y0")))
    return rows.select("acq_id", "slice", "frame", F.when(F.coalesce("n", F.lit(0)) > 2, line).otherwise(0.0).alias("hr"))


def window_rate(times: DataFrame, triggers: DataFrame) -> DataFrame:
    """Earlier rate rule: beats per minute over the triggers within 3 s; the previous frame's value (60 at first)
    where fewer than two fall in."""
    spans = times.select("acq_id", "slice", "frame", (F.col("time") - HALF_WINDOW).alias("low"), (F.col("time") + HALF_WINDOW).alias("high"))
    met = range_join(spans, triggers.select("acq_id", F.col("time").alias("point")), ["acq_id"], "low", "high", "point", 8.0)
    stats = met.groupBy("acq_id", "slice", "frame").agg(
        F.count(F.lit(1)).alias("n"), F.min("point").alias("first"), F.max("point").alias("last")).where("n >= 2")
    rated = stats.select("acq_id", "slice", F.col("frame").cast("double").alias("at"),
                         ((F.col("n") - 1) * 60.0 / (F.col("last") - F.col("first"))).alias("rate"))
    asks = times.select("acq_id", "slice", "frame", F.col("frame").cast("double").alias("at"))
    filled = asof(asks, rated, ["acq_id", "slice"], "at", ["rate"], "backward", True, 1024.0)
    return asks.join(filled, ["acq_id", "slice", "at"], "left").select(
        "acq_id", "slice", "frame", F.coalesce("rate", F.lit(60.0)).alias("hr"))


def heart_rate_response(times: DataFrame, triggers: DataFrame, timing: DataFrame, legacy: bool = False) -> DataFrame:
    """(acq_id, slice, frame, hr_crf, hr_crf_d, hr); ``hr`` is demeaned like the response's input."""
    rate = window_rate(times, triggers) if legacy else interpolate_rate(times, heart_rates(triggers))
    rate = cut_lineage(rate)
    place = ["acq_id", "slice"]
    folded = _response(rate, timing, "hr", cardiac_response, "hr_crf")
    return folded.join(rate, [*place, "frame"])


def quadratic_detrend(long: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """Remove the quadratic trend over a complete index 0 … n-1 with its discrete orthogonal polynomials."""
    sizes = long.groupBy(*keys).agg((F.max(index) + 1).cast("double").alias("_n"))
    p1 = F.col(index) - (F.col("_n") - 1) / 2
    p2 = p1 * p1 - (F.col("_n") * F.col("_n") - 1) / 12
    rows = long.join(sizes, keys).withColumn("_p1", p1).withColumn("_p2", p2)
    v = F.col(value)
    weights = rows.groupBy(*keys).agg(
        F.avg(v).alias("_w0"), F.try_divide(F.sum(v * F.col("_p1")), F.sum(F.col("_p1") * F.col("_p1"))).alias("_w1"),
        F.try_divide(F.sum(v * F.col("_p2")), F.sum(F.col("_p2") * F.col("_p2"))).alias("_w2"))
    flat = v - F.col("_w0") - F.coalesce(F.col("_w1") * F.col("_p1"), F.lit(0.0)) - F.coalesce(F.col("_w2") * F.col("_p2"), F.lit(0.0))
    return rows.join(weights, keys).select(*keys, index, flat.alias(value))


def too_short(timing: DataFrame) -> DataFrame:
    """Acquisitions whose frames are too few for a trend: (acq_id, slice, frame, name, value), one REJECTED row a slice."""
    return timing.where(F.coalesce("nframes", F.lit(0)) < MIN_TREND_FRAMES).select(
        "acq_id", F.col("slice").cast("int").alias("slice"), F.lit(None).cast("int").alias("frame"), F.lit(REJECTED).alias("name"), F.lit(None).cast("double").alias("value"))


def regressors(signal: DataFrame, timing: DataFrame, resp_dt: float | DataFrame | None = None, legacy: bool = False) -> DataFrame:
    """All 13 regressors, long: (acq_id, slice, frame, name, value), and REJECTED rows of acquisitions below 3 frames.

    The first twelve are freed from a quadratic trend; the heart rate is kept as it is. Each recording has its own
    sampling step, from ``timing`` unless ``resp_dt`` says otherwise.
    """
    rejected = too_short(timing)
    timing = cut_lineage(timing.where(F.col("nframes") >= MIN_TREND_FRAMES))
    resp_dt = scan_lengths(timing).select("acq_id", "resp_dt") if resp_dt is None else resp_dt
    aligned = cut_lineage(align(signal, timing))
    wave, triggers = chopped(aligned, "resp_wave"), chopped(aligned, "card_trig")
    times = cut_lineage(slice_times(timing))
    place = ["acq_id", "slice", "frame"]
    parts = [fourier_terms(cardiac_phase(times, triggers, timing), respiratory_phase(times, wave, resp_dt)),
             respiration_variation(times, wave, timing, resp_dt), heart_rate_response(times, triggers, timing, legacy)]
    pairs = lambda df: F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in REGRESSORS if n in df.columns])
    tall = [df.select(*place, F.explode(pairs(df)).alias("_p")).select(*place, "_p.name", "_p.value") for df in parts]
    long = cut_lineage(tall[0].unionByName(tall[1]).unionByName(tall[2]))
    flat = quadratic_detrend(long.where("name != 'hr'"), ["acq_id", "slice", "name"], "frame", "value")
    return flat.select(*place, "name", "value").unionByName(long.where("name = 'hr'")).unionByName(rejected)


# validity ----------------------------------------------------------------------------------------

def pulse_quality(signal: DataFrame) -> DataFrame:
    """Deviation of the pulse wave and share of plausible beats (30 to 200 per minute) per acquisition.

    Rates use trigger times in seconds; ``signal`` must carry ``time`` (see ``align``).
    """
    std = signal.where("kind = 'card_wave'").groupBy("acq_id").agg(F.stddev_pop("value").alias("card_std"))
    triggers = signal.where("kind = 'card_trig'").select("acq_id", "time")
    last = asof(triggers, triggers, ["acq_id"], "time", [], "backward", False).where("matched_at is not null")
    rate = F.lit(60.0) / (F.col("time") - F.col("matched_at"))
    good = last.groupBy("acq_id").agg(F.avg(F.when((rate >= 30) & (rate <= 200), 1.0).otherwise(0.0)).alias("good_rate"))
    return std.join(good, "acq_id", "left")


def chirp_bins(values: np.ndarray, start: int, first: int, count: int, n: int) -> np.ndarray:
    """``count`` bins from ``first`` of the transform of length ``n``, as far as samples from ``start`` on contribute.

    A chirp turns the sum into a convolution, done by FFTs of about len(values) + count. Exponents are taken modulo n
    as whole numbers, so long recordings lose no precision.
    """
    j, m = np.arange(len(values)), np.arange(count)
    turn = lambda k, of: np.exp(-2j * np.pi * (k % of) / of)
    size = 1 << (len(values) + count - 2).bit_length() if len(values) + count > 2 else 2
    chirp = turn(np.arange(max(len(values), count)) ** 2, 2 * n)
    kernel = np.zeros(size, complex)
    kernel[:count] = chirp[:count].conj()
    kernel[size - len(values) + 1:] = chirp[1:len(values)][::-1].conj()
    found = np.fft.ifft(np.fft.fft(values * turn(j * first, n) * chirp[:len(values)], size) * np.fft.fft(kernel))[:count]
    return found * chirp[:count] * turn((first + m) * start, n)


def band_ratio(wave: DataFrame, resp_dt: float | DataFrame, cutoff: float = 1.0, block: int = 65_536, part: int = 65_536) -> DataFrame:
    """Mean spectral amplitude below ``cutoff`` over the mean of as many highest bins: (acq_id, ratio).

    Only the bins of both bands are evaluated, in parts of ``part``. A block of samples gives its share of one part at a
    time (``chirp_bins``), so a task holds one block and one part however long the recording; the shares are summed by
    (acquisition, bin). NULL where the recording is too short to have the band.
    """
    sizes = stepped(wave.groupBy("acq_id").agg(F.count(F.lit(1)).alias("n")), resp_dt)
    low, total = F.bround(F.lit(float(cutoff)) * F.col("_dt") * F.col("n")).cast("long"), F.floor(F.col("n") / 2) + 1
    span = lambda band, first, count: F.transform(
        F.sequence(F.lit(0).cast("long"), F.floor((F.greatest(count, F.lit(1)) - 1) / part)),
        lambda k: F.struct(F.lit(band).alias("band"), (first + k * part).alias("first"), F.least(count - k * part, F.lit(part)).alias("count")))
    high = F.when(low > 0, low).otherwise(total)
    bands = F.filter(F.concat(span("low", F.lit(2).cast("long"), low - 2), span("high", total - high, high)), lambda b: b["count"] > 0)
    asked = sizes.where(low < total).select("acq_id", "n", F.explode(bands).alias("_b")).select("acq_id", "n", "_b.*")
    rows = wave.select("acq_id", F.col("idx").cast("long").alias("idx"), "value").withColumn("block", F.floor(F.col("idx") / block))

    def shares(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        start, first, count = int(pdf["idx"].iloc[0]), int(pdf["first"].iloc[0]), int(pdf["count"].iloc[0])
        values = np.zeros(int(pdf["idx"].iloc[-1]) - start + 1)
        values[pdf["idx"].to_numpy() - start] = pdf["value"].to_numpy()
        found = chirp_bins(values, start, first, count, int(pdf["n"].iloc[0]))
        return pd.DataFrame({"acq_id": pdf["acq_id"].iloc[0], "band": pdf["band"].iloc[0], "bin": np.arange(first, first + count), "re": found.real, "im": found.imag})

    parts = rows.join(asked, "acq_id").groupBy("acq_id", "block", "band", "first").applyInPandas(
        shares, "acq_id long, band string, bin long, re double, im double")
    amplitude = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    whole = parts.groupBy("acq_id", "band", "bin").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    means = whole.groupBy("acq_id").agg(F.avg(F.when(F.col("band") == "low", amplitude)).alias("_l"), F.avg(F.when(F.col("band") == "high", amplitude)).alias("_h"))
    return sizes.join(means, "acq_id", "left").select("acq_id", F.try_divide("_l", "_h").alias("ratio"))


def validity(signal: DataFrame, timing: DataFrame, resp_dt: float | DataFrame | None = None) -> DataFrame:
    """(acq_id, card_std, good_rate, ratio, valid): enough frames and a credible pulse or respiration."""
    resp_dt = scan_lengths(timing).select("acq_id", "resp_dt") if resp_dt is None else resp_dt
    aligned = align(signal, timing)
    pulse = pulse_quality(aligned)
    ratio = band_ratio(signal.where("kind = 'resp_wave'"), resp_dt)
    scan = scan_lengths(timing).select("acq_id", "nframes")
    rows = scan.join(pulse, "acq_id", "left").join(ratio, "acq_id", "left")
    beat = F.coalesce((F.col("card_std") > MIN_CARD_STD) & (F.col("good_rate") > MIN_GOOD_RATE), F.lit(False))
    breath = F.coalesce(F.col("ratio") > MIN_RESP_RATIO, F.lit(False))
    waves = signal.groupBy("acq_id").agg((F.max((F.col("kind") == "card_wave").cast("int")) + F.max(
        (F.col("kind") == "resp_wave").cast("int")) == 2).alias("_both"))
    rows = rows.join(waves, "acq_id", "left")
    return rows.withColumn("valid", (F.col("nframes") >= MIN_FRAMES) & F.coalesce("_both", F.lit(False)) & (beat | breath)).drop("_both")


def attach_outcome(recorded, has_slice_order, scanner, found, valid, excluded: tuple[str, ...] = ()) -> Column:
    """What a physio search reports for an epoch; NULL when it does not search at all. The texts are fixed values."""
    skip = ~F.coalesce(has_slice_order, F.lit(False)) | F.coalesce(scanner.isin(*excluded) if excluded else F.lit(False), F.lit(False))
    return (F.when(skip, F.lit(None).cast("string")).when(~F.coalesce(recorded, F.lit(False)), "physio not recorded")
            .when(~F.coalesce(found, F.lit(False)), "no physio files found")
            .when(F.coalesce(valid, F.lit(False)), "valid physio found").otherwise("invalid physio found and discarded"))


def attach(epochs: DataFrame, files: DataFrame, verdicts: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(id, outcome, file): what the search for an epoch's recording ends with, and the first file of a valid one.

    ``files``: name, psd, ts and the acq_id of the recording they hold; ``verdicts``: acq_id, valid (see ``validity``). A
    recording without a verdict is invalid. Only epochs that search and have a recording take part in the match.
    """
    skipped = (F.coalesce("num_slices", F.lit(0)) <= 1) | (F.coalesce(F.col("scanner_name").isin(*excluded), F.lit(False)) if excluded else F.lit(False))
    asks = epochs.where(F.col("physio_recorded") & ~skipped).select(F.col("id").alias("epoch_id"), "psd", "timestamp")
    judged = files.select("name", "acq_id").distinct().join(verdicts.select("acq_id", "valid"), "acq_id", "left")
    hits = physio_files(asks, files.select("name", "psd", "ts").distinct()).join(judged, "name").groupBy(F.col("epoch_id").alias("id")).agg(
        F.min("name").alias("file"), F.bool_or(F.coalesce("valid", F.lit(False))).alias("_valid"))
    outcome = attach_outcome(F.col("physio_recorded"), F.col("num_slices") > 1, F.col("scanner_name"), F.col("file").isNotNull(), F.col("_valid"), excluded)
    return epochs.join(hits, "id", "left").select("id", outcome.alias("outcome"), F.when(F.col("_valid") & outcome.isNotNull(), F.col("file")).alias("file"))


def recompute_scope(catalog: Catalog, experiment_id: int) -> DataFrame:
    """Epochs of an experiment whose physio dataset holds exactly one recording archive: (epoch_id, file)."""
    rows = catalog.chain("dataset", "subject", {
        "dataset": F.expr("dataset_kind = 'peripheral' and dataset_filetype = 'physio'"), "subject": F.col("experiment_id") == experiment_id})
    archives = F.filter("dataset_filenames", lambda f: f.endswith("_physio.tgz"))
    return rows.withColumn("_a", archives).where(F.size("_a") == 1).select("epoch_id", F.element_at("_a", 1).alias("file"))


def recompute(catalog: Catalog, experiment_id: int, signal: DataFrame, timing: DataFrame, resp_dt: float | DataFrame | None = None) -> DataFrame:
    """Regressors of every acquisition in an experiment's scope (``acq_id`` is the epoch id)."""
    ids = recompute_scope(catalog, experiment_id).select(F.col("epoch_id").alias("acq_id")).distinct()
    return regressors(signal.join(ids, "acq_id", "left_semi"), timing.join(ids, "acq_id", "left_semi"), resp_dt)


def design_scores(regressor: DataFrame) -> DataFrame:
    """Every regressor of every slice as z-scores over its frames."""
    keys = ["acq_id", "slice", "name"]
    regressor = regressor.where(F.col("frame").isNotNull())  # no rejected ones
    stats = regressor.groupBy(*keys).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    return regressor.join(stats, keys).select(
        *keys, "frame", F.try_divide(F.col("value") - F.col("_m"), F.col("_s")).alias("value"))


# denoising ---------------------------------------------------------------------------------------

def denoise(voxel: DataFrame, regressor: DataFrame) -> DataFrame:
    """Voxel series without the part explained by the regressors: (acq_id, x, y, z, t, v, variance_reduced).

    The design of a slice is constant, linear and quadratic time and its regressors (z-scored). Constant and time
    stay in the data, and so does the last regressor. One image row of one slice is solved per group (its size
    is one row of voxels times the frames), with the slice's design sent to each of its rows. The fit takes the
    frames that have both; an image frame without design keeps its values, design frames without image are not used.
    """
    rows = voxel.select("acq_id", "z", "y", "x", "t", "v")
    place = {n: i for i, n in enumerate(REGRESSORS)}
    order = F.try_element_at(F.create_map(*[F.lit(v) for p in place.items() for v in p]), F.col("name"))
    # a regressor that never changes explains nothing: its column is 0
    design = design_scores(regressor).select(
        "acq_id", F.col("slice").cast("int").alias("z"), F.col("frame").cast("int").alias("t"), order.alias("k"),
        F.coalesce("value", F.lit(0.0)).alias("value"))
    lines = rows.select(*[F.col(c).alias(c) for c in ("acq_id", "z", "y")]).distinct()
    spread = design.join(lines, ["acq_id", "z"])

    def grid(cells: pd.DataFrame, across: str, value: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Times, columns and their values in one array; NaN where there is none."""
        at, row = np.unique(cells["t"].to_numpy(), return_inverse=True)
        names, column = np.unique(cells[across].to_numpy(), return_inverse=True)
        if len(np.unique(row * len(names) + column)) < len(cells):
            raise ValueError(f"a value of t and {across} comes twice")
        filled = np.full((len(at), len(names)), np.nan)
        filled[row, column] = cells[value].to_numpy()
        return at, names, filled

    def solve(image: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if image.empty or model.empty:
            return pd.DataFrame({c: [] for c in ("acq_id", "x", "y", "z", "t", "v", "variance_reduced")})
        steps, _, x = grid(model, "k", "value")
        times, places, whole = grid(image, "x", "v")
        both, seen, used = np.intersect1d(times, steps, assume_unique=True, return_indices=True)
        x, data = x[used], whole[seen]
        t = np.arange(len(both), dtype=float)[:, None]
        drift = np.hstack([t, t ** 2])
        full = np.hstack([np.ones((len(both), 1)), (drift - drift.mean(0)) / drift.std(0), x])
        beta = np.linalg.pinv(full) @ data
        clean = data - full[:, 3:-1] @ beta[3:-1]
        before = data.var(axis=0, ddof=1)
        reduced = (before - clean.var(axis=0, ddof=1)) / before
        whole[seen] = clean
        row, column = np.nonzero(~np.isnan(whole))
        return pd.DataFrame({"acq_id": image["acq_id"].iloc[0], "x": places[column], "y": image["y"].iloc[0], "z": image["z"].iloc[0],
                             "t": times[row], "v": whole[row, column], "variance_reduced": reduced[column]})

    keys = ["acq_id", "z", "y"]
    return rows.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(
        solve, "acq_id long, x int, y int, z int, t int, v double, variance_reduced double")
