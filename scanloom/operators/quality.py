"""Image quality analytics on long voxel tables (acq_id, x, y, z, t, v).

The unmasked voxels are the rows that remain. All heavy steps are keyed aggregations that combine before the
shuffle; what is joined back is one row per slice, frame or acquisition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions.names import slice_color
from scanloom.operators.ordering import group_median, near
from scanloom.operators.polyfit import polyfit, polyval
from scanloom.session import cut_lineage

#: Radius in mm of the sphere that stands for a head.
HEAD_RADIUS = 80.0
VERSION = 1.0


def frame_flags(voxel: DataFrame) -> DataFrame:
    """(acq_id, t, bad): a frame is bad when any of its slices is empty."""
    peak = voxel.groupBy("acq_id", "t", "z").agg(F.max("v").alias("peak"))
    return peak.groupBy("acq_id", "t").agg(F.bool_or(F.col("peak") == 0).alias("bad"))


def bad_end(flags: DataFrame) -> DataFrame:
    """Frames from which on every frame is bad, i.e. those after the last good one."""
    last = flags.groupBy("acq_id").agg(F.max(F.when(~F.col("bad"), F.col("t"))).alias("_last"))
    return flags.join(last, "acq_id").select("acq_id", "t", (F.col("t") > F.coalesce("_last", F.lit(-1))).alias("masked"))


def brain_voxels(voxel: DataFrame, brain_mask: DataFrame, nskip: int = 6, drop_bad_end: bool = False) -> DataFrame:
    """Voxels left by the masks: inside the brain, after the skipped frames, before a corrupt end."""
    rows = voxel.where(F.col("t") >= nskip)
    if drop_bad_end:
        good = bad_end(frame_flags(voxel)).where("not masked").select("acq_id", "t")
        rows = rows.join(good, ["acq_id", "t"], "left_semi")
    inside = brain_mask.where("in_brain").select("acq_id", "x", "y", "z")
    return rows.join(inside, ["acq_id", "x", "y", "z"], "left_semi")


def mean_image(voxel: DataFrame, nskip: int = 6) -> DataFrame:
    """Mean over time of every voxel, without the first frames."""
    return voxel.where(F.col("t") >= nskip).groupBy("acq_id", "x", "y", "z").agg(F.avg("v").alias("mean"))


def slice_means(brain: DataFrame) -> DataFrame:
    """Mean of column means per slice and frame (columns weigh the same, however many voxels they keep)."""
    columns = brain.groupBy("acq_id", "z", "t", "y").agg(F.avg("v").alias("_c"))
    return columns.groupBy("acq_id", "z", "t").agg(F.avg("_c").alias("m"))


def global_signal(means: DataFrame) -> DataFrame:
    """Mean of slice means per frame: the third unweighted level."""
    return means.groupBy("acq_id", "t").agg(F.avg("m").alias("g"))


def slice_stats(means: DataFrame, suffix: str = "") -> DataFrame:
    return means.groupBy("acq_id", "z").agg(F.avg("m").alias(f"mean{suffix}"), F.stddev_pop("m").alias(f"std{suffix}"))


def _z(mean: str, std: str) -> Column:
    return F.try_divide(F.col("m") - F.col(mean), F.col(std))


def find_spikes(means: DataFrame, threshold: float = 6.0) -> DataFrame:
    """Two-pass z-score spikes: (acq_id, z, t, m, zscore, spike).

    The second pass takes the deviation without the first spikes but keeps the original mean.
    """
    first = means.join(slice_stats(means), ["acq_id", "z"])
    flagged = first.withColumn("_s1", F.coalesce(F.abs(_z("mean", "std")) > threshold, F.lit(False)))
    clean = slice_stats(flagged.where("not _s1"), "2").select("acq_id", "z", "std2")
    second = flagged.join(clean, ["acq_id", "z"], "left").withColumn("zscore", _z("mean", "std2"))
    again = F.coalesce(F.abs(F.col("zscore")) > threshold, F.lit(False))
    return second.select("acq_id", "z", "t", "m", "zscore", (F.col("_s1") | again).alias("spike"))


def global_free(means: DataFrame) -> DataFrame:
    """Slice means with the frame's global signal removed."""
    return means.join(global_signal(means), ["acq_id", "t"]).select("acq_id", "z", "t", (F.col("m") - F.col("g")).alias("m"))


def drift(signal: DataFrame, frames: DataFrame, degree: int = 3) -> DataFrame:
    """Slow trend of the global signal, fitted on the good frames (``signal``), evaluated at all ``frames``."""
    fit = polyfit(signal, ["acq_id"], "t", "g", degree)
    return frames.join(fit, "acq_id").select("acq_id", "t", polyval(F.col("t")).alias("trend"))


def voxel_tsnr(brain: DataFrame, trend: DataFrame) -> DataFrame:
    """Temporal mean over the deviation left after the trend, per voxel."""
    free = brain.join(trend, ["acq_id", "t"])
    stats = free.groupBy("acq_id", "x", "y", "z").agg(
        F.avg("v").alias("_m"), F.stddev_pop(F.col("v") - F.col("trend")).alias("_s"))
    return stats.select("acq_id", "x", "y", "z", F.try_divide("_m", "_s").alias("tsnr"))


_AFFINE = [f"a{i}{j}" for i in range(3) for j in range(3)]
_SHIFT = ["t0", "t1", "t2"]


def _length(affine: list[Column], shift: list[Column]) -> Column:
    square = lambda terms: sum((c * c for c in terms[1:]), terms[0] * terms[0])
    return F.sqrt(F.lit(HEAD_RADIUS ** 2 / 5.0) * square(affine) + square(shift))


def displacement(motion: DataFrame) -> DataFrame:
    """Mean displacement per frame: absolute (against identity) and relative (matrix change; first frame 0)."""
    identity = {"a00": 1.0, "a11": 1.0, "a22": 1.0}
    absolute = _length([F.col(n) - F.lit(identity.get(n, 0.0)) for n in _AFFINE], [F.col(n) for n in _SHIFT])
    stepped = near(motion, ["acq_id"], "t", 1, 0,
                   lambda w: {f"_p{n}": F.lag(n, 1).over(w) for n in _AFFINE + _SHIFT})
    change = lambda n: F.col(n) - F.col(f"_p{n}")
    relative = _length([change(n) for n in _AFFINE], [change(n) for n in _SHIFT])
    return stepped.select("acq_id", "t", absolute.alias("absolute"), F.coalesce(relative, F.lit(0.0)).alias("relative"),
                          *_SHIFT, *[F.degrees(r).alias(r) for r in ("rx", "ry", "rz")])


def _series(df: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    """One array per acquisition; its length is the number of frames (or slices)."""
    return df.groupBy("acq_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_k"), value.alias("_v")))).alias("_a")).select(
        "acq_id", F.transform("_a", lambda s: s["_v"]).alias(name))


def qa_reports(voxel: DataFrame, brain_mask: DataFrame, motion: DataFrame, tr: float = 2.0, threshold: float = 6.0,
               nskip: int = 6, drop_bad_end: bool = False, aligned: DataFrame | None = None) -> DataFrame:
    """One report per acquisition with at least ``nskip + 3`` frames. ``aligned`` defaults to ``voxel``."""
    enough = voxel.groupBy("acq_id").agg((F.max("t") + 1).alias("nframes")).where(F.col("nframes") >= nskip + 3)
    brain = brain_voxels(voxel, brain_mask, nskip, drop_bad_end).join(enough, "acq_id", "left_semi")
    means = cut_lineage(slice_means(brain))  # one row per slice and frame; read by everything below
    signal = global_signal(means)
    spikes = cut_lineage(find_spikes(global_free(means), threshold))
    steady = brain if aligned is None else brain_voxels(aligned, brain_mask, nskip, drop_bad_end)
    steady_signal = signal if aligned is None else cut_lineage(global_signal(slice_means(steady)))
    frames = enough.select("acq_id", F.explode(F.sequence(F.lit(0), (F.col("nframes") - 1).cast("int"))).alias("t"))
    tsnr = group_median(voxel_tsnr(steady, drift(steady_signal, frames)), ["acq_id"], "tsnr", "tsnr")
    moved = cut_lineage(displacement(motion))
    median = group_median(moved, ["acq_id"], "relative", "median_md")
    level = signal.groupBy("acq_id").agg(F.avg("g").alias("_fill"))
    filled = frames.join(signal, ["acq_id", "t"], "left").join(level, "acq_id")
    slices = means.select("acq_id", "z").distinct()
    scores = (frames.join(slices, "acq_id").join(spikes.select("acq_id", "z", "t", "zscore"), ["acq_id", "z", "t"], "left")
              .groupBy("acq_id", "z").agg(F.array_sort(F.collect_list(F.struct("t", F.bround(F.coalesce("zscore", F.lit(0.0)), 1).alias("s")))).alias("_r"))
              .select("acq_id", "z", F.transform("_r", lambda r: r["s"]).alias("row")))
    found = spikes.where("spike").groupBy("acq_id").agg(F.array_sort(F.collect_list(F.array(F.col("z").cast("int"), F.col("t").cast("int")))).alias("spikes"))
    motion_rows = F.array(*[F.bround(c, 4) for c in ("t0", "t1", "t2", "rx", "ry", "rz")])
    peak = moved.groupBy("acq_id").agg(F.bround(F.max("relative"), 3).alias("max md"))
    return (enough.join(_series(moved, "t", motion_rows, "transrot"), "acq_id")
            .join(_series(moved, "t", F.bround("absolute", 2), "mean displacement"), "acq_id")
            .join(_series(moved, "t", F.bround("relative", 2), "relative displacement"), "acq_id")
            .join(peak, "acq_id").join(median, "acq_id").join(tsnr, "acq_id")
            .join(_series(filled, "t", F.bround(F.coalesce("g", "_fill"), 3), "global mean signal"), "acq_id")
            .join(_series(scores, "z", F.col("row"), "timeseries zscore"), "acq_id")
            .join(found, "acq_id", "left")
            .select("acq_id", F.lit(VERSION).alias("version"), F.lit(tr).alias("tr"),
                    F.sequence(F.lit(0), (F.col("nframes") - 1).cast("int")).alias("frame #"), "transrot",
                    "mean displacement", "relative displacement", "max md", F.bround("median_md", 3).alias("median md"),
                    F.bround("tsnr", 3).alias("temporal SNR (median)"), "global mean signal", "timeseries zscore",
                    F.coalesce("spikes", F.array().cast("array<array<int>>")).alias("spikes"),
                    F.lit(float(threshold)).alias("spike thresh")))


def qa_summary(reports: DataFrame) -> DataFrame:
    """Version, median tSNR (2 digits) and number of spikes of every report."""
    return reports.select("report_id", "version", F.round("`temporal SNR (median)`", 2).alias("tsnr"),
                          F.size("spikes").alias("num_spikes"))


def motion_series(reports: DataFrame) -> DataFrame:
    """Chart points of both displacement curves: (report_id, key, color, x, y).

    Reports before version 1 copy the second absolute value over the first, and their relative curve is the
    difference of the absolute one at 3 digits.
    """
    md = F.col("`mean displacement`")
    old = F.col("version") < 1.0
    shown = F.when(old & (F.size(md) > 1), F.concat(F.array(F.element_at(md, 2)), F.slice(md, 2, 1 << 30))).otherwise(md)
    ready = reports.select("report_id", "version", F.col("`frame #`").alias("frames"), shown.alias("absolute"),
                           F.col("`relative displacement`").alias("stored"))
    steps = F.zip_with(F.slice(F.col("absolute"), 1, F.greatest(F.size("absolute") - 1, F.lit(0))),
                       F.slice(F.col("absolute"), 2, 1 << 30), lambda a, b: F.round(b - a, 3))
    relative = F.when(old, F.concat(F.array(F.lit(0.0)), steps)).otherwise(F.col("stored"))

    def curve(values: Column, key: str, color: str) -> DataFrame:
        n = F.least(F.size("frames"), F.size("_y"))
        return (ready.withColumn("_y", values).withColumn("_n", n)
                .select("report_id", F.posexplode(F.slice(F.arrays_zip(F.col("frames").alias("x"), F.col("_y").alias("y")), F.lit(1), F.col("_n"))).alias("_i", "_p"))
                .select("report_id", F.lit(key).alias("key"), F.lit(color).alias("color"), F.col("_p.x").alias("x"), F.col("_p.y").alias("y")))
    return curve(F.col("absolute"), "absolute", "blue").unionAll(curve(relative, "relative", "cyan"))


def zscore_series(reports: DataFrame) -> DataFrame:
    """Chart points of every slice's z-scores: (report_id, key, color, x, y)."""
    rows = reports.select("report_id", F.col("`frame #`").alias("frames"), F.size("`timeseries zscore`").alias("n"),
                          F.posexplode("`timeseries zscore`").alias("slice", "row"))
    points = rows.select("report_id", "slice", "n", F.explode(F.arrays_zip(F.col("frames").alias("x"), F.col("row").alias("y"))).alias("p"))
    return points.where("p.x is not null and p.y is not null").select(
        "report_id", F.concat(F.lit("slice"), F.col("slice").cast("string")).alias("key"),
        slice_color("slice", "n").alias("color"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))

