"""Repairs of image series: spikes, missing slices, coil combination, distortion inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.operators.quality import _z, brain_voxels, slice_means, slice_stats
from scanloom.session import cut_lineage

_FRAME = ["acq_id", "z", "t"]


def detect_spikes(voxel: DataFrame, brain_mask: DataFrame, threshold: float = 3.0, nskip: int = 6) -> DataFrame:
    """Three-pass detector on slice means: (acq_id, z, t, zscore, spike).

    The first pass masks both signs; later passes renew mean and deviation and mask what has been found. Only
    drops of the signal are reported. Corrupt frames at the end never take part.
    """
    rows = cut_lineage(slice_means(brain_voxels(voxel, brain_mask, nskip, drop_bad_end=True)))
    place = ["acq_id", "z"]
    first = rows.join(slice_stats(rows), place).withColumn("_z1", _z("mean", "std"))
    flagged = first.select(*_FRAME, "m", F.coalesce(F.col("_z1") < -threshold, F.lit(False)).alias("spike"),
                           F.coalesce(F.abs("_z1") > threshold, F.lit(False)).alias("_masked"))
    for _ in range(2):
        stats = slice_stats(flagged.where("not _masked"), "2")
        scored = flagged.join(stats, place, "left").withColumn("zscore", _z("mean2", "std2"))
        spike = F.col("spike") | F.coalesce(F.col("zscore") < -threshold, F.lit(False))
        flagged = scored.select(*_FRAME, "m", "zscore", spike.alias("spike"), (F.col("_masked") | spike).alias("_masked"))
    return flagged.select(*_FRAME, "zscore", "spike")


def spike_summary(spikes: DataFrame) -> DataFrame:
    """Number of spikes and of slices holding any, per acquisition."""
    return spikes.where("spike").groupBy("acq_id").agg(
        F.count(F.lit(1)).alias("n_spikes"), F.countDistinct("z").alias("n_slices"))


def replacement_plan(spikes: DataFrame, nframes: DataFrame, mode: str = "reference") -> DataFrame:
    """Source frames and weights of every spiking slice: (acq_id, z, t, source, weight).

    A neighbour that spikes as well is passed over by one more frame. With d frames between both sources the
    left one weighs (d - 1) / d; ``mode="linear"`` weighs by nearness instead. At an end one side is copied.
    """
    hit = spikes.where("spike").select(*_FRAME)
    flag = lambda step, name: hit.select("acq_id", "z", (F.col("t") + step).alias("t"), F.lit(1).alias(name))
    sides = (hit.join(flag(1, "_before"), _FRAME, "left").join(flag(-1, "_after"), _FRAME, "left")
             .join(nframes, "acq_id")
             .withColumn("_l", F.lit(1) + F.coalesce("_before", F.lit(0))).withColumn("_r", F.lit(1) + F.coalesce("_after", F.lit(0))))
    left, right = F.col("t") - F.col("_l"), F.col("t") + F.col("_r")
    apart = (F.col("_l") + F.col("_r")).cast("double")
    weight = (apart - 1) / apart if mode == "reference" else F.col("_r") / apart
    part = lambda source, w: F.struct(source.alias("source"), w.cast("double").alias("weight"))
    parts = (F.when(right >= F.col("nframes"), F.array(part(left, F.lit(1.0))))
             .when(left < 0, F.array(part(right, F.lit(1.0))))
             .otherwise(F.array(part(left, weight), part(right, F.lit(1.0) - weight))))
    return sides.select(*_FRAME, F.explode(parts).alias("_p")).select(*_FRAME, "_p.source", "_p.weight")


def despike(voxel: DataFrame, brain_mask: DataFrame, threshold: float = 3.0, nskip: int = 6, mode: str = "reference") -> DataFrame:
    """The image with spiking slices replaced by a blend of neighbouring frames.

    Untouched voxels pass through; only source frames of spikes are joined, so the work follows the spikes.
    """
    spikes = cut_lineage(detect_spikes(voxel, brain_mask, threshold, nskip))
    frames = voxel.groupBy("acq_id").agg((F.max("t") + 1).alias("nframes"))
    plan = replacement_plan(spikes, frames, mode).withColumnRenamed("t", "_to").withColumnRenamed("source", "t")
    rebuilt = (voxel.join(plan, _FRAME).groupBy("acq_id", "x", "y", "z", F.col("_to").alias("t"))
               .agg(F.sum(F.col("v") * F.col("weight")).alias("v")))
    bad = plan.select("acq_id", "z", F.col("_to").alias("t")).distinct()
    return voxel.join(bad, _FRAME, "left_anti").select("acq_id", "x", "y", "z", "t", "v").unionByName(
        rebuilt.select("acq_id", "x", "y", "z", "t", "v"))


def combine_coils(coils: DataFrame) -> DataFrame:
    """Root of the sum of squares over all but the last coil, rounded: (acq_id, x, y, z, v)."""
    last = coils.groupBy("acq_id").agg(F.max("coil").alias("_last"))
    others = coils.join(last, "acq_id").where(F.col("coil") < F.col("_last"))
    return others.groupBy("acq_id", "x", "y", "z").agg(F.bround(F.sqrt(F.sum(F.col("v") * F.col("v")))).alias("v"))


def sum_parts(parts: DataFrame) -> DataFrame:
    """Sum partial volumes (acq_id, part, x, y, z, t, v)."""
    return parts.groupBy("acq_id", "x", "y", "z", "t").agg(F.sum("v").alias("v"))


def fill_missing_slices(voxel: DataFrame, missing: DataFrame) -> DataFrame:
    """Replace missing slices by the mean of the adjacent ones, in every band; without both neighbours the value is NULL.

    ``missing``: acq_id, first_missing, nslices (per band), mux (bands). Only the missing slices and their neighbours
    meet; all others pass as they are, without a shuffle where the list of missing slices is small enough to broadcast.
    """
    kind = voxel.schema["z"].dataType
    bands = F.sequence(F.col("first_missing"), F.col("first_missing") + F.col("nslices") * (F.col("mux") - 1), F.col("nslices"))
    lost = missing.where("first_missing is not null and nslices > 0 and mux > 0").select("acq_id", F.explode(bands).alias("z")).select("acq_id", F.col("z").cast(kind).alias("z")).distinct()
    beside = lost.select("acq_id", F.col("z").alias("_z"), F.explode(F.array(F.col("z") - 1, F.col("z") + 1)).alias("z"))
    keys = ["acq_id", "x", "y", "t"]
    means = voxel.join(beside, ["acq_id", "z"]).groupBy(*keys, F.col("_z").alias("z")).agg(
        F.when(F.count("v") == 2, F.sum("v") / 2.0).alias("v"))
    places = voxel.join(lost, ["acq_id", "z"], "left_semi").select(*keys, "z")
    columns = ["acq_id", "x", "y", "z", "t", "v"]
    return voxel.join(lost, ["acq_id", "z"], "left_anti").select(*columns).unionByName(places.join(means, [*keys, "z"], "left").select(*columns))


# opposite phase-encode runs ----------------------------------------------------------------------

def pad_even_slices(voxel: DataFrame) -> DataFrame:
    """Append a zero slice to acquisitions with an odd number of slices."""
    top = voxel.groupBy("acq_id").agg(F.max("z").alias("_top")).where("_top % 2 = 0")
    zeros = voxel.join(top, "acq_id").where("z = _top").select(
        "acq_id", "x", "y", (F.col("z") + 1).cast("int").alias("z"), "t", F.lit(0.0).alias("v"))
    return voxel.select("acq_id", "x", "y", "z", "t", "v").unionByName(zeros)


def concat_runs(first: DataFrame, second: DataFrame, offset: DataFrame) -> DataFrame:
    """Frames of the second run after those of the first; ``offset``: acq_id, n (frames taken from the first)."""
    later = second.join(offset, "acq_id").withColumn("t", (F.col("t") + F.col("n")).cast("int")).drop("n")
    return first.unionByName(later.select(*first.columns))


def reference_frames(gradients: DataFrame, num_vols: int = 2) -> DataFrame:
    """Non-diffusion frames among the first ``num_vols``, renumbered: (acq_id, run, i, t). At most num_vols each."""
    w = Window.partitionBy("acq_id", "run").orderBy("i")
    return gradients.where((F.col("bval") < 10) & (F.col("i") < num_vols)).select(
        "acq_id", "run", "i", (F.row_number().over(w) - 1).alias("t"))


def polarity_pair(voxel: DataFrame, gradients: DataFrame, num_vols: int = 2) -> dict[str, DataFrame]:
    """Inputs of a distortion estimate from two runs of opposite polarity.

    ``voxel``: acq_id, run (1, 2), x, y, z, t, v; ``gradients``: acq_id, run, i, bval, bx, by, bz. Returns ``b0`` and
    ``dwi`` volumes (padded to an even slice count), the ``index`` of every dwi frame, and merged ``gradients``.
    """
    chosen = reference_frames(gradients, num_vols)
    b0 = voxel.withColumnRenamed("t", "i").join(chosen, ["acq_id", "run", "i"]).drop("i")
    counts = chosen.where("run = 1").groupBy("acq_id").agg(F.count(F.lit(1)).alias("n"))
    run = lambda df, k: df.where(F.col("run") == k).drop("run")
    rest = voxel.where(F.col("t") >= num_vols).withColumn("t", (F.col("t") - num_vols).cast("int"))
    lengths = rest.where("run = 1").groupBy("acq_id").agg((F.max("t") + 1).alias("n"))
    merged = gradients.where(F.col("i") >= num_vols).withColumn("t", (F.col("i") - num_vols).cast("int")).drop("i")
    frames = rest.select("acq_id", "run", "t").distinct()
    index = (frames.join(counts, "acq_id").withColumn("index", F.when(F.col("run") == 1, 1).otherwise(F.col("n") + 1).cast("int"))
             .select("acq_id", "run", "t", "index"))
    shift = lambda df: concat_runs(run(df, 1), run(df, 2), lengths)
    return {"b0": pad_even_slices(concat_runs(run(b0, 1), run(b0, 2), counts)), "dwi": pad_even_slices(shift(rest)),
            "index": shift(index), "gradients": shift(merged)}


def rotate_gradients(gradients: DataFrame, motion: DataFrame) -> DataFrame:
    """Gradient directions turned by each volume's rotation: (acq_id, i, bx, by, bz).

    The rotation is x · y · z; using the transpose of its inverse applies the rotation itself.
    """
    rows = gradients.join(motion.select("acq_id", "i", "rx", "ry", "rz"), ["acq_id", "i"])
    turn = lambda a, p, q: (F.cos(a) * p + F.sin(a) * q, F.cos(a) * q - F.sin(a) * p)
    bx, by = turn("rz", F.col("bx"), F.col("by"))
    step = rows.select("acq_id", "i", "rx", "ry", bx.alias("bx"), by.alias("by"), "bz")
    bx, bz = turn("ry", F.col("bx"), F.col("bz"))
    step = step.select("acq_id", "i", "rx", bx.alias("bx"), "by", bz.alias("bz"))
    by, bz = turn("rx", F.col("by"), F.col("bz"))
    return step.select("acq_id", "i", "bx", by.alias("by"), bz.alias("bz"))


def acquisition_parameter_row(direction: Column, readout: Column, dim: int) -> Column:
    """Text row of the acquisition-parameter file: the direction at the phase-encode axis, then the readout time."""
    cells = [direction.cast("string") if axis == dim else F.lit("0") for axis in range(3)]
    return F.concat_ws(" ", *cells, readout.cast("string"))
