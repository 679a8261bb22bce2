"""Queries over image and physiology time series derived from the vector and event tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from scanloom.operators import physio, quality, repair
from scanloom.operators.matching import asof, bracket, window_moments
from scanloom.operators.ordering import convolve, difference, group_median, near, row_numbers, running_total
from scanloom.operators.polyfit import detrend, polyfit, polyval
from scanloom.plans.registry import query
from scanloom.plans.catalog_queries import _PHYSIO, recording_files
from scanloom.plans.testbed import oracle, series_oracle
from scanloom.session import cut_lineage

_SKIP, _THRESHOLD = 6, 2.0


def series(name, sql=None):
    return query(name, sql, series_oracle)


def series_and_views(name, sql):
    return query(name, sql, lambda body: oracle(series_oracle(body)))


def _r(column, digits=6):
    return F.round(column, digits)


# image quality -----------------------------------------------------------------------------------

_BRAIN = f"""brain as (select v.* from voxel v join brain_mask m using (acq_id, x, y, z) where m.in_brain and v.t >= {_SKIP}),
    means as (select acq_id, z, t, avg(c) as m from (select acq_id, z, t, y, avg(v) as c from brain group by 1, 2, 3, 4) q group by 1, 2, 3),
    g as (select acq_id, t, avg(m) as g from means group by 1, 2),
    free as (select acq_id, z, t, m - g as m from means join g using (acq_id, t)),
    st as (select acq_id, z, avg(m) as mu, stddev_pop(m) as sd from free group by 1, 2),
    p1 as (select acq_id, z, t, m, mu, abs((m - mu) / sd) > {_THRESHOLD} as s from free join st using (acq_id, z)),
    st2 as (select acq_id, z, stddev_pop(m) as sd2 from p1 where not s group by 1, 2),
    p2 as (select acq_id, z, t, (m - mu) / sd2 as zs, s or abs((m - mu) / sd2) > {_THRESHOLD} as spike from p1 join st2 using (acq_id, z))"""


def _means(tb):
    return quality.slice_means(quality.brain_voxels(tb.voxel, tb.brain_mask, _SKIP))


@series("A6_slice_means", f"with {_BRAIN} select acq_id, z, t, round(m, 6) as m from means")
def _(tb):
    return _means(tb).select("acq_id", "z", "t", _r("m").alias("m"))


@series("A7_global_signal", f"with {_BRAIN} select acq_id, t, round(g, 6) as g from g")
def _(tb):
    return quality.global_signal(_means(tb)).select("acq_id", "t", _r("g").alias("g"))


@series("A8_slice_stats", f"with {_BRAIN} select acq_id, z, round(mu, 6) as mean, round(sd, 6) as std from st")
def _(tb):
    return quality.slice_stats(quality.global_free(_means(tb))).select("acq_id", "z", _r("mean").alias("mean"), _r("std").alias("std"))


@series("A9_median_displacement", """with d as (select acq_id, x, y, z, t, v - lag(v) over (partition by acq_id, x, y, z order by t) as d from voxel)
    select acq_id, x, y, z, round(median(d), 6) as median, round(max(d), 6) as high from d where d is not null group by 1, 2, 3, 4""")
def _(tb):
    place = ["acq_id", "x", "y", "z"]
    step = near(tb.voxel, place, "t", 1, 0, lambda w: {"d": F.col("v") - F.lag("v").over(w)})
    high = step.groupBy(*place).agg(_r(F.max("d")).alias("high"))
    return group_median(step, place, "d").join(high, place).select(*place, _r("median").alias("median"), "high")


@series("A10_frame_flags", """select acq_id, t, bool_or(p <= 96) as bad from (select acq_id, t, z, max(v) as p from voxel group by 1, 2, 3) q group by 1, 2""")
def _(tb):
    floored = tb.voxel.withColumn("v", F.when(F.col("v") <= 96, 0.0).otherwise(F.col("v")))
    return quality.frame_flags(floored)


@series("A18_mean_image", f"select acq_id, x, y, z, round(avg(v), 6) as mean from voxel where t >= {_SKIP} group by 1, 2, 3, 4")
def _(tb):
    return quality.mean_image(tb.voxel, _SKIP).select("acq_id", "x", "y", "z", _r("mean").alias("mean"))


@series("T1_frame_mask", """with f as (select acq_id, t, bool_or(p < 102) as bad from (select acq_id, t, z, max(v) as p from voxel group by 1, 2, 3) q group by 1, 2)
    select acq_id, t, bool_and(bad) over (partition by acq_id order by t rows between current row and unbounded following) or t < 6 as masked from f""")
def _(tb):
    low = tb.voxel.withColumn("v", F.when(F.col("v") < 102, 0.0).otherwise(F.col("v")))
    flags = quality.bad_end(quality.frame_flags(low))
    return flags.select("acq_id", "t", (F.col("masked") | (F.col("t") < _SKIP)).alias("masked"))


@series("W4_bad_run_to_end", """select user_id, event_id, bool_and(value > 20) over (partition by user_id order by event_id rows between current row and unbounded following) as masked from events""")
def _(tb):
    flags = tb.base("events").select(F.col("user_id").alias("acq_id"), F.col("event_id").alias("t"), (F.col("value") > 20).alias("bad"))
    return quality.bad_end(flags).select(F.col("acq_id").alias("user_id"), F.col("t").alias("event_id"), "masked")


@series("T2_find_spikes", f"with {_BRAIN} select acq_id, z, t, round(zs, 5) as zscore, spike from p2")
def _(tb):
    return quality.find_spikes(quality.global_free(_means(tb)), _THRESHOLD).select("acq_id", "z", "t", _r("zscore", 5).alias("zscore"), "spike")


@series("T3_global_free", f"with {_BRAIN} select acq_id, z, t, round(m, 6) as m from free")
def _(tb):
    return quality.global_free(_means(tb)).select("acq_id", "z", "t", _r("m").alias("m"))


_DRIFT = """k as (select acq_id, avg(t) as c, count(*)::double as n from g group by 1),
    o as (select acq_id, t, g, t - c as p1, (t - c)**2 - (n * n - 1) / 12 as p2, (t - c)**3 - (3 * n * n - 7) / 20 * (t - c) as p3 from g join k using (acq_id)),
    w as (select acq_id, avg(g) as w0, sum(g * p1) / sum(p1 * p1) as w1, sum(g * p2) / sum(p2 * p2) as w2, sum(g * p3) / sum(p3 * p3) as w3 from o group by 1),
    trend as (select acq_id, t, w0 + w1 * (t - c) + w2 * ((t - c)**2 - (n * n - 1) / 12) + w3 * ((t - c)**3 - (3 * n * n - 7) / 20 * (t - c)) as trend
      from (select acq_id, unnest(range(0, 50)) as t from k) f join k using (acq_id) join w using (acq_id))"""


def _trend(tb):
    frames = tb.voxel.select("acq_id", "t").distinct()
    return quality.drift(quality.global_signal(_means(tb)), frames)


@series("T4_cubic_drift", f"with {_BRAIN}, {_DRIFT} select acq_id, t, round(trend, 5) as trend from trend")
def _(tb):
    return _trend(tb).select("acq_id", F.col("t").cast("long").alias("t"), _r("trend", 5).alias("trend"))


@series("T5_voxel_tsnr", f"with {_BRAIN}, {_DRIFT} select acq_id, x, y, z, round(avg(v) / stddev_pop(v - trend), 5) as tsnr from brain join trend using (acq_id, t) group by 1, 2, 3, 4")
def _(tb):
    brain = quality.brain_voxels(tb.voxel, tb.brain_mask, _SKIP)
    return quality.voxel_tsnr(brain, _trend(tb)).select("acq_id", "x", "y", "z", _r("tsnr", 5).alias("tsnr"))


@series("T5_median_tsnr", f"with {_BRAIN}, {_DRIFT} select acq_id, round(median(s), 5) as tsnr from (select acq_id, x, y, z, avg(v) / stddev_pop(v - trend) as s from brain join trend using (acq_id, t) group by 1, 2, 3, 4) q group by 1")
def _(tb):
    brain = quality.brain_voxels(tb.voxel, tb.brain_mask, _SKIP)
    return group_median(quality.voxel_tsnr(brain, _trend(tb)), ["acq_id"], "tsnr", "m").select("acq_id", _r("m", 5).alias("tsnr"))


_AFF = [f"a{i}{j}" for i in range(3) for j in range(3)]
_ABS = "sqrt(1280.0::double * (" + " + ".join(f"({a} - {1 if a in ('a00', 'a11', 'a22') else 0})**2" for a in _AFF) + ") + t0**2 + t1**2 + t2**2)"
_REL = "sqrt(1280.0::double * (" + " + ".join(f"({a} - p{a})**2" for a in _AFF) + ") + " + " + ".join(f"(t{i} - pt{i})**2" for i in range(3)) + ")"


@series("T6_displacement", "with l as (select *, " + ", ".join(f"lag({a}) over w as p{a}" for a in _AFF + ["t0", "t1", "t2"])
        + f" from motion window w as (partition by acq_id order by t)) select acq_id, t, round({_ABS}, 6) as absolute, coalesce(round({_REL}, 6), 0) as relative from l")
def _(tb):
    return quality.displacement(tb.motion).select("acq_id", "t", _r("absolute").alias("absolute"), _r("relative").alias("relative"))


_MOVED = ("moved as (select acq_id, t, " + f"{_ABS} as absolute, coalesce({_REL}, 0) as relative, t0, t1, t2, degrees(rx) as rx, degrees(ry) as ry, degrees(rz) as rz from (select *, "
          + ", ".join(f"lag({a}) over w as p{a}" for a in _AFF + ["t0", "t1", "t2"]) + " from motion window w as (partition by acq_id order by t)) l)")


@series("A9_relative_motion", f"with {_MOVED} select acq_id, round(median(relative), 6) as median, round(max(relative), 6) as high from moved group by 1")
def _(tb):
    """Median and greatest displacement between neighbouring frames of each acquisition."""
    moved = quality.displacement(tb.motion)
    high = moved.groupBy("acq_id").agg(_r(F.max("relative")).alias("high"))
    return group_median(moved, ["acq_id"], "relative").join(high, "acq_id").select("acq_id", _r("median").alias("median"), "high")


@series("T7_rotation_degrees", "select acq_id, t, round(degrees(rx), 6) as rx, round(degrees(ry), 6) as ry, round(degrees(rz), 6) as rz from motion")
def _(tb):
    return quality.displacement(tb.motion).select("acq_id", "t", *[_r(c).alias(c) for c in ("rx", "ry", "rz")])


def _reports(tb):
    return quality.qa_reports(tb.voxel, tb.brain_mask, tb.motion, 2.0, _THRESHOLD, _SKIP)


@series("T8_qa_reports", f"""with {_BRAIN}, {_DRIFT}, ts as (select acq_id, median(s) as tsnr from (select acq_id, x, y, z, avg(v) / stddev_pop(v - trend) as s from brain join trend using (acq_id, t) group by 1, 2, 3, 4) q group by 1)
    select ts.acq_id as acq_id, 50 as nframes, round_even(tsnr, 3) as tsnr, (select count(*) from p2 where p2.acq_id = ts.acq_id and spike) as n_spikes,
      (select string_agg(z || ':' || t, ' ' order by z, t) from p2 where p2.acq_id = ts.acq_id and spike) as spikes from ts""")
def _(tb):
    return _reports(tb).select("acq_id", F.size("`frame #`").alias("nframes"), F.col("`temporal SNR (median)`").alias("tsnr"),
                               F.size("spikes").cast("long").alias("n_spikes"),
                               F.array_join(F.transform("spikes", lambda s: F.concat_ws(":", s[0], s[1])), " ").alias("spikes"))


@series("Q11_qa_summary", f"""with {_BRAIN}, {_DRIFT}, ts as (select acq_id, median(s) as tsnr from (select acq_id, x, y, z, avg(v) / stddev_pop(v - trend) as s from brain join trend using (acq_id, t) group by 1, 2, 3, 4) q group by 1)
    select acq_id as report_id, 1.0::double as version, round(round_even(tsnr, 3), 2) as tsnr, (select count(*) from p2 where p2.acq_id = ts.acq_id and spike) as num_spikes from ts""")
def _(tb):
    return quality.qa_summary(_reports(tb).withColumnRenamed("acq_id", "report_id")).select(
        "report_id", F.col("version").cast("double").alias("version"), "tsnr", F.col("num_spikes").cast("long").alias("num_spikes"))


@query("Q12_motion_series", """with r as (select event_id as report_id, event_id % 2 = 0 as old, [round(value, 2), round(value * 1.5, 4), round(value / 3, 2), round(value + 1, 2)] as md from events),
    a as (select report_id, old, case when old then [md[2], md[2], md[3], md[4]] else md end as md, md as raw from r)
    select report_id, 'absolute' as key, 'blue' as color, i as x, md[i + 1] as y from a, range(0, 4) q(i)
    union all select report_id, 'relative', 'cyan', i, case when not old then raw[i + 1] / 2 when i = 0 then 0 else round(md[i + 1] - md[i], 3) end from a, range(0, 4) q(i)""")
def _(tb):
    reports = tb.base("events").selectExpr(
        "event_id as report_id", "case when event_id % 2 = 0 then 0.1D else 1.0D end as version", "array(0, 1, 2, 3) as `frame #`",
        "array(round(value, 2), round(value * 1.5D, 4), round(value / 3, 2), round(value + 1, 2)) as `mean displacement`")
    reports = reports.withColumn("relative displacement", F.transform("mean displacement", lambda v: v / 2))
    return quality.motion_series(reports).withColumn("x", F.col("x").cast("long"))


@series("Q12_zscore_series", f"with {_BRAIN} select acq_id as report_id, 'slice' || z as key, t as x, round_even(zs, 1) as y from p2 union all select acq_id, 'slice' || z, f, 0 from (select distinct acq_id, z from p2) q, range(0, {_SKIP}) r(f)")
def _(tb):
    rows = quality.zscore_series(_reports(tb).withColumnRenamed("acq_id", "report_id"))
    return rows.select("report_id", "key", "x", "y")  # frames the analysis skips are charted as 0


# despiking and repairs ---------------------------------------------------------------------------

_SPIKES = f"""brain as (select v.* from voxel v join brain_mask m using (acq_id, x, y, z) where m.in_brain and v.t >= {_SKIP}),
    means as (select acq_id, z, t, avg(c) as m from (select acq_id, z, t, y, avg(v) as c from brain group by 1, 2, 3, 4) q group by 1, 2, 3),
    a1 as (select *, (m - avg(m) over w) / stddev_pop(m) over w as z1 from means window w as (partition by acq_id, z)),
    b1 as (select acq_id, z, t, m, z1 < -1.8 as s, abs(z1) > 1.8 as k from a1),
    a2 as (select *, (m - avg(case when not k then m end) over w) / stddev_pop(case when not k then m end) over w as z2 from b1 window w as (partition by acq_id, z)),
    b2 as (select acq_id, z, t, m, s or z2 < -1.8 as s, k or s or z2 < -1.8 as k from a2),
    a3 as (select *, (m - avg(case when not k then m end) over w) / stddev_pop(case when not k then m end) over w as z3 from b2 window w as (partition by acq_id, z)),
    b3 as (select acq_id, z, t, z3, s or z3 < -1.8 as spike from a3)"""


@series("T9_detect_spikes", f"with {_SPIKES} select acq_id, z, t, round(z3, 5) as zscore, spike from b3")
def _(tb):
    return repair.detect_spikes(tb.voxel, tb.brain_mask, 1.8, _SKIP).select("acq_id", "z", "t", _r("zscore", 5).alias("zscore"), "spike")


@series("A16_spike_summary", f"with {_SPIKES} select acq_id, count(*) as n_spikes, count(distinct z) as n_slices from b3 where spike group by 1")
def _(tb):
    return repair.spike_summary(repair.detect_spikes(tb.voxel, tb.brain_mask, 1.8, _SKIP))


@series("T9_despike", f"""with {_SPIKES}, s as (select acq_id, z, t from b3 where spike),
    n as (select *, 1 + (exists (select 1 from s p where p.acq_id = s.acq_id and p.z = s.z and p.t = s.t - 1))::int as l, 1 + (exists (select 1 from s p where p.acq_id = s.acq_id and p.z = s.z and p.t = s.t + 1))::int as r from s)
    select v.acq_id, v.x, v.y, v.z, v.t, round(case when n.l is null then v.v when n.t + n.r >= 50 then lv.v when n.t - n.l < 0 then rv.v
      else (n.l + n.r - 1)::double / (n.l + n.r) * lv.v + (1 - (n.l + n.r - 1)::double / (n.l + n.r)) * rv.v end, 6) as v
    from voxel v left join n on n.acq_id = v.acq_id and n.z = v.z and n.t = v.t
    left join voxel lv on lv.acq_id = v.acq_id and lv.x = v.x and lv.y = v.y and lv.z = v.z and lv.t = n.t - n.l
    left join voxel rv on rv.acq_id = v.acq_id and rv.x = v.x and rv.y = v.y and rv.z = v.z and rv.t = n.t + n.r""")
def _(tb):
    return repair.despike(tb.voxel, tb.brain_mask, 1.8, _SKIP).withColumn("v", _r("v"))


@query("W6_neighbour_frames", """with s as (select l_orderkey as acq_id, cast(l_linenumber as int) as z, cast(l_partkey % 12 as int) as t from lineitem group by 1, 2, 3),
    n as (select *, 1 + (exists (select 1 from s p where p.acq_id = s.acq_id and p.z = s.z and p.t = s.t - 1))::int as l, 1 + (exists (select 1 from s p where p.acq_id = s.acq_id and p.z = s.z and p.t = s.t + 1))::int as r from s)
    select acq_id, z, t, t - l as source, round(case when t + r >= 12 then 1 else (l + r - 1)::double / (l + r) end, 6) as weight from n where t + r >= 12 or t - l >= 0
    union all select acq_id, z, t, t + r, round(case when t - l < 0 then 1 else 1 - (l + r - 1)::double / (l + r) end, 6) from n where t + r < 12""")
def _(tb):
    spikes = tb.base("lineitem").selectExpr("l_orderkey as acq_id", "l_linenumber as z", "cast(l_partkey % 12 as int) as t").distinct().withColumn("spike", F.lit(True))
    frames = spikes.select("acq_id", F.lit(12).alias("nframes")).distinct()
    return repair.replacement_plan(spikes, frames).withColumn("weight", _r("weight"))


@series("T10_combine_coils", """select acq_id, x, y, z, round_even(sqrt(sum(v * v)), 0) as v from voxel where t < 49 group by 1, 2, 3, 4""")
def _(tb):
    return repair.combine_coils(tb.voxel.withColumnRenamed("t", "coil"))


@series("T11_fill_missing_slices", """select acq_id, x, y, z, t, round(case when z in (1, 3) and z - 1 >= 0 and z % 2 = 1 then case when z = 3 then null else (lag(v) over w + lead(v) over w) / 2 end else v end, 6) as v
    from voxel window w as (partition by acq_id, x, y, t order by z)""")
def _(tb):
    missing = tb.voxel.select("acq_id").distinct().select("acq_id", F.lit(1).alias("first_missing"), F.lit(2).alias("nslices"), F.lit(2).alias("mux"))
    return repair.fill_missing_slices(tb.voxel, missing).withColumn("v", _r("v"))


@query("W7_sum_parts", "select l_orderkey as acq_id, cast(l_linenumber as int) as z, sum(cast(l_quantity as bigint)) as v from lineitem group by 1, 2")
def _(tb):
    parts = tb.base("lineitem").selectExpr("l_orderkey as acq_id", "0 as x", "0 as y", "l_linenumber as z", "0 as t", "cast(l_quantity as bigint) as v")
    return repair.sum_parts(parts).select("acq_id", "z", "v")


_GRAD = "case when vec_id % 10 < 3 then 0 else 1000 end + vec_id % 7 as bval, embedding[{a}] as bx, embedding[{b}] as by, embedding[{c}] as bz"


def _gradients(tb):
    return tb.base("embeddings").selectExpr(
        "floor(vec_id / 100) as acq_id", "cast(floor(vec_id / 50) % 2 + 1 as int) as run", "cast(vec_id % 50 as int) as i",
        "cast(case when vec_id % 10 < 3 then 0 else 1000 end + vec_id % 7 as double) as bval",
        "cast(embedding[20] as double) as bx", "cast(embedding[21] as double) as by", "cast(embedding[22] as double) as bz")


def _runs(tb):
    return tb.voxel.select(F.floor(F.col("acq_id") / 2).alias("acq_id"), (F.col("acq_id") % 2 + 1).cast("int").alias("run"), "x", "y", "z", "t", "v")


@series("T12_polarity_pair", """with v as (select cast(floor(acq_id / 2) as bigint) as acq_id, acq_id % 2 + 1 as run, x, y, z, t, v from (select * from voxel union all select * replace (4 as z) from voxel where z = 0) q),
    gr as (select cast(floor(vec_id / 100) as bigint) as acq_id, floor(vec_id / 50)::int % 2 + 1 as run, vec_id % 50 as i, case when vec_id % 10 < 3 then 0 else 1000 end + vec_id % 7 as b from embeddings),
    ch as (select acq_id, run, i, row_number() over (partition by acq_id, run order by i) - 1 as k from gr where b < 10 and i < 5),
    n as (select acq_id, count(*) as n from ch where run = 1 group by 1),
    b0 as (select v.acq_id, x, y, z, case when v.run = 1 then k else k + n.n end as t, v from v join ch on ch.acq_id = v.acq_id and ch.run = v.run and ch.i = v.t join n on n.acq_id = v.acq_id where true),
    dw as (select acq_id, x, y, z, case when run = 1 then t - 5 else t - 5 + 45 end as t, v from v where t >= 5)
    select 'b0' as part, acq_id, x, y, z, t, round(v, 6) as v from b0 union all select 'b0', acq_id, x, y, 5, t, 0 from b0 where z = 4 and false
    union all select 'dwi', acq_id, x, y, z, t, round(v, 6) from dw
    union all select 'b0', acq_id, x, y, 5, t, 0 from b0 where z = 4 union all select 'dwi', acq_id, x, y, 5, t, 0 from dw where z = 4""")
def _(tb):
    runs = _runs(tb)  # four slices and the first once more: an odd number gets an empty slice
    out = repair.polarity_pair(runs.unionByName(runs.where("z = 0").withColumn("z", F.lit(4).cast(runs.schema["z"].dataType))), _gradients(tb), 5)
    pick = lambda name: out[name].select(F.lit(name).alias("part"), "acq_id", "x", "y", "z", "t", _r("v").alias("v"))
    return pick("b0").unionAll(pick("dwi"))


@series("U5_concatenated_runs", """with gr as (select cast(floor(vec_id / 100) as bigint) as acq_id, floor(vec_id / 50)::int % 2 + 1 as run, vec_id % 50 as i, (case when vec_id % 10 < 3 then 0 else 1000 end + vec_id % 7)::double as b from embeddings),
    n as (select acq_id, count(*) as n from gr where run = 1 and b < 10 and i < 5 group by 1)
    select acq_id, i - 5 + case when run = 2 then 45 else 0 end as t, b as bval, case when run = 1 then 1 else n + 1 end as index from gr join n using (acq_id) where i >= 5""")
def _(tb):
    out = repair.polarity_pair(_runs(tb), _gradients(tb), 5)
    return out["gradients"].join(out["index"], ["acq_id", "t"]).select("acq_id", "t", "bval", "index")


@series("T13_rotate_gradients", """with g as (select m.acq_id, m.t as i, e.embedding[21]::double as bx, e.embedding[22]::double as b2, e.embedding[23]::double as bz, rx, ry, rz from motion m join embeddings e on e.vec_id = m.acq_id * 50 + m.t),
    a as (select *, cos(rz) * bx + sin(rz) * b2 as x1, cos(rz) * b2 - sin(rz) * bx as y1 from g), b as (select *, cos(ry) * x1 + sin(ry) * bz as x2, cos(ry) * bz - sin(ry) * x1 as z2 from a)
    select acq_id, i, round(x2, 6) as bx, round(cos(rx) * y1 + sin(rx) * z2, 6) as "by", round(cos(rx) * z2 - sin(rx) * y1, 6) as bz from b""")
def _(tb):
    e = tb.base("embeddings").selectExpr("floor(vec_id / 50) as acq_id", "cast(vec_id % 50 as int) as i", "cast(embedding[20] as double) as bx",
                                         "cast(embedding[21] as double) as by", "cast(embedding[22] as double) as bz")
    turned = repair.rotate_gradients(e, tb.motion.withColumnRenamed("t", "i"))
    return turned.select("acq_id", "i", *[_r(c).alias(c) for c in ("bx", "by", "bz")])


# windows on driver tables ------------------------------------------------------------------------

@query("W2_first_difference", """select event_id, round(coalesce(value - lag(value) over w, lead(value) over w - value), 6) as d from events window w as (partition by floor(event_id / 500) order by event_id)""")
def _(tb):
    e = tb.base("events").select(F.floor(F.col("event_id") / 500).alias("acq_id"), "event_id", (F.col("event_id") % 500).alias("t"), "value")
    return difference(e, ["acq_id"], "t", "value", "d", "repeat", block=128).select("event_id", _r("d").alias("d"))


@query("W3_zscore", "select event_id, round((value - avg(value) over w) / stddev_pop(value) over w, 6) as z from events window w as (partition by event_type)")
def _(tb):
    e = tb.base("events").select("event_id", F.col("event_type").alias("acq_id"), F.lit(0).alias("z"), F.col("value").alias("m"))
    scored = e.join(quality.slice_stats(e), ["acq_id", "z"])
    return scored.select("event_id", _r((F.col("m") - F.col("mean")) / F.col("std")).alias("z"))


@query("W5_cumulative_counts", """with h as (select event_type as acq_id, least(floor((value - lo) / ((hi - lo) / 100)), 99)::bigint as bin from events join (select event_type, min(value) as lo, max(value) as hi from events group by 1) using (event_type)),
    c as (select acq_id, bin, count(*) as n_bin from h group by 1, 2) select acq_id, bin, n_bin, coalesce(sum(n_bin) over (partition by acq_id order by bin rows between unbounded preceding and 1 preceding), 0)::bigint as below from c""")
def _(tb):
    return physio.histogram(tb.base("events").select(F.col("event_type").alias("acq_id"), "value"))


@query("W9_convolution", "select a.event_id as event_id, round(sum(b.value * (1.0::double / (1 + a.event_id - b.event_id))), 5) as y from events a join events b on floor(a.event_id / 500) = floor(b.event_id / 500) and a.event_id - b.event_id between 0 and 7 group by 1")
def _(tb):
    e = tb.base("events").select(F.floor(F.col("event_id") / 500).alias("acq_id"), (F.col("event_id") % 500).alias("t"), "event_id", "value")
    kernel = F.array(*[F.lit(1.0 / (1 + k)) for k in range(8)])
    return convolve(e, ["acq_id"], "t", "value", kernel, "y").select("event_id", _r("y", 5).alias("y"))


@query("J14_range_join", """select a.event_id as event_id, count(*) as n, round(stddev_pop(b.value), 5) as sd from events a join events b on a.event_type = b.event_type
    and epoch(b.ts) between epoch(a.ts) - 1800 and epoch(a.ts) + 1800 group by 1""")
def _(tb):
    e = tb.base("events").select("event_type", "event_id", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    spans = e.select("event_type", "event_id", (F.col("at") - 1800).alias("low"), (F.col("at") + 1800).alias("high"))
    met = window_moments(spans, e.select("event_type", F.col("at").alias("point"), "value"), ["event_type"], "low", "high", "point", "value", 1800.0)
    return met.select("event_id", F.col("_n").alias("n"), _r("_std", 5).alias("sd"))


@query("J13_two_sided_asof", """with c as (select user_id, epoch_us(ts) / 1e6 as at from events where event_type = 'click'), v as (select user_id, event_id, epoch_us(ts) / 1e6 as at from events where event_type = 'view')
    select event_id, round(v.at - (select max(c.at) from c where c.user_id = v.user_id and c.at < v.at), 3) as since, round((select min(c.at) from c where c.user_id = v.user_id and c.at > v.at) - v.at, 3) as until from v""")
def _(tb):
    e = tb.base("events").select("event_type", "user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    views, clicks = e.where("event_type = 'view'"), e.where("event_type = 'click'").select("user_id", "at")
    sides = bracket(views, clicks, ["user_id"], "at", [], False, 3600.0)
    return views.join(sides, ["user_id", "at"]).select(
        "event_id", _r(F.col("at") - F.col("before.matched_at"), 3).alias("since"),
        _r(F.col("after.matched_at") - F.col("at"), 3).alias("until"))


@query("W11_forward_fill", """select event_id, coalesce(last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row), 60) as rate from events""")
def _(tb):
    e = tb.base("events").select("user_id", "event_id", F.col("event_id").cast("double").alias("at"), "event_type", "value")
    known = e.where("event_type = 'purchase'").select("user_id", "at", F.col("value").alias("rate"))
    filled = asof(e, known, ["user_id"], "at", ["rate"], "backward", True, 4096.0)
    return e.join(filled, ["user_id", "at"]).select("event_id", F.coalesce("rate", F.lit(60.0)).alias("rate"))


@query("running_totals", "select event_id, sum(event_id) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as total, max(value) over (partition by user_id order by ts, event_id rows unbounded preceding) as peak from events")
def _(tb):
    e = tb.base("events").select("user_id", "event_id", "ts", "value")
    total = running_total(e, ["user_id"], ["ts", "event_id"], F.col("event_id"), "total")
    return running_total(total, ["user_id"], ["ts", "event_id"], F.col("value"), "peak", how="max").select("event_id", "total", "peak")


@query("A21_polynomial_fit", """with e as (select event_type, event_id, value, (row_number() over (partition by event_type order by event_id) - 1)::double as i, count(*) over (partition by event_type)::double as n from events),
    o as (select *, i - (n - 1) / 2 as p1, (i - (n - 1) / 2)**2 - (n * n - 1) / 12 as p2 from e),
    w as (select event_type, avg(value) as w0, sum(value * p1) / sum(p1 * p1) as w1, sum(value * p2) / sum(p2 * p2) as w2 from o group by 1)
    select event_id, round(value - w0 - w1 * p1 - w2 * p2, 4) as rest from o join w using (event_type)""")
def _(tb):
    e = row_numbers(tb.base("events").select("event_type", "event_id", "value"), ["event_type"], ["event_id"], "i")
    return detrend(e, ["event_type"], "i", "value", 2, "rest").select("event_id", _r("rest", 4).alias("rest"))


@query("A21_third_degree_fit", """with e as (select event_type, event_id, value, (row_number() over (partition by event_type order by event_id) - 1)::double as i, count(*) over (partition by event_type)::double as n from events),
    o as (select *, i - (n - 1) / 2 as p1 from e), q as (select *, p1**2 - (n * n - 1) / 12 as p2, p1**3 - (3 * n * n - 7) / 20 * p1 as p3 from o),
    w as (select event_type, avg(value) as w0, sum(value * p1) / sum(p1 * p1) as w1, sum(value * p2) / sum(p2 * p2) as w2, sum(value * p3) / sum(p3 * p3) as w3 from q group by 1)
    select event_id, round(value - w0 - w1 * p1 - w2 * p2 - w3 * p3, 4) as rest from q join w using (event_type)""")
def _(tb):
    e = row_numbers(tb.base("events").select("event_type", "event_id", "value"), ["event_type"], ["event_id"], "i")
    return detrend(e, ["event_type"], "i", "value", 3, "rest").select("event_id", _r("rest", 4).alias("rest"))


@query("A21_cubic_fit", """select event_type, round(regr_slope(value, event_id), 8) as slope from events group by 1""")
def _(tb):
    fit = polyfit(tb.base("events"), ["event_type"], "event_id", "value", 1)
    return fit.select("event_type", _r(polyval(F.lit(1.0)) - polyval(F.lit(0.0)), 8).alias("slope"))


@query("A12_window_deviation", "select a.event_id as event_id, round(stddev_pop(b.value), 5) as sd from events a join events b on floor(a.event_id / 500) = floor(b.event_id / 500) and b.event_id between a.event_id - 75 and a.event_id + 74 group by 1")
def _(tb):
    e = tb.base("events").select(F.floor(F.col("event_id") / 500).alias("acq_id"), "event_id", "value")
    spans = e.select("acq_id", "event_id", (F.col("event_id") - 75).alias("low"), (F.col("event_id") + 74).alias("high"))
    met = window_moments(spans, e.select("acq_id", F.col("event_id").alias("point"), "value"), ["acq_id"], "low", "high", "point", "value", 128)
    return met.select("event_id", _r("_std", 5).alias("sd"))


@query("A11_histogram", """with h as (select event_type as acq_id, least(floor((value - lo) / ((hi - lo) / 100)), 99)::bigint as bin from events join (select event_type, min(value) as lo, max(value) as hi from events group by 1) using (event_type))
    select acq_id, bin, count(*) as n_bin from h group by 1, 2""")
def _(tb):
    return physio.histogram(tb.base("events").select(F.col("event_type").alias("acq_id"), "value")).drop("below")


@query("A13_root_sum_squares", "select l_orderkey, round_even(sqrt(sum(l_quantity * l_quantity)), 0) as v from lineitem join (select l_orderkey % 8 as a, max(l_linenumber) as last from lineitem group by 1) m on m.a = l_orderkey % 8 where l_linenumber < last group by 1")
def _(tb):
    coils = tb.base("lineitem").selectExpr("l_orderkey % 8 as acq_id", "l_orderkey as x", "0 as y", "0 as z", "l_linenumber as coil", "l_quantity as v")
    return repair.combine_coils(coils).select(F.col("x").alias("l_orderkey"), "v")


# physiology --------------------------------------------------------------------------------------

_TAPS = physio.lowpass_taps(0.04)
_WEIGHTS = ", ".join(f"({k - 19}, {float(w)!r}::double)" for k, w in enumerate(np.correlate(_TAPS, _TAPS, mode="full")))
_AL = """al as (select s.*, case when kind = 'card_trig' then value * 0.04::double - (0.04::double * n - 18.0::double) else 0.04::double * idx - (0.04::double * n - 18.0::double) end as time
      from signal s join (select acq_id, max(idx) + 1 as n from signal where kind = 'resp_wave' group by 1) using (acq_id)),
    times as (select acq_id, slice, f as frame, onset + slice_window / 2 + f * tr as time from timing, range(0, 18) q(f)),
    wave as (select acq_id, idx - min(idx) over (partition by acq_id) as idx, value from al where kind = 'resp_wave' and time > 0),
    trig as (select acq_id, time from al where kind = 'card_trig' and time > 0)"""
_CARD = """cp as (select acq_id, slice, frame, (time - t1) * (2.0::double * pi()) / (t2 - t1) as phase from (select *, coalesce((select max(g.time) from trig g where g.acq_id = t.acq_id and g.time < t.time), 0.0::double) as t1,
      coalesce((select min(g.time) from trig g where g.acq_id = t.acq_id and g.time > t.time), 18.0::double) as t2 from times t) q)"""
_SMOOTH = f"""wn as (select acq_id, max(idx) as n, arg_min(value, idx) as h, arg_max(value, idx) as e, min(value) as lo, max(value) as hi from wave group by 1),
    ext as (select acq_id, idx, value from wave union all select acq_id, -idx, 2 * h - value from wave join wn using (acq_id) where idx between 1 and 19
      union all select acq_id, 2 * n - idx, 2 * e - value from wave join wn using (acq_id) where idx between n - 19 and n - 1),
    smooth as (select w.acq_id, w.idx, sum(x.value * k.c) as s from wave w, (values {_WEIGHTS}) k(o, c), ext x where x.acq_id = w.acq_id and x.idx = w.idx + k.o group by 1, 2)"""
_RESP = """lv as (select acq_id, lo, (hi - lo) / 100 as step, n + 1 as n from wn),
    bins as (select acq_id, least(floor((value - lo) / step), 99) as bin, count(*) as c from wave join lv using (acq_id) group by 1, 2),
    hit as (select t.acq_id, slice, frame, w.value - lo as amp, step, n, sign(s2.s - s1.s) as sg from times t join lv using (acq_id)
      join wave w on w.acq_id = t.acq_id and w.idx = least(greatest(0, round_even(t.time / 0.04::double, 0))::int, n - 2)
      join smooth s1 on s1.acq_id = w.acq_id and s1.idx = w.idx join smooth s2 on s2.acq_id = w.acq_id and s2.idx = w.idx + 1),
    rp as (select acq_id, slice, frame, pi() * sg * (coalesce((select sum(c) from bins b where b.acq_id = h.acq_id and b.bin < greatest(0, least(ceil(amp / step - 0.5), 100))), 0)::double / n) as phase from hit h)"""


def _parts(tb):
    aligned = cut_lineage(physio.align(tb.signal, tb.timing))
    return physio.slice_times(tb.timing), physio.chopped(aligned, "resp_wave"), physio.chopped(aligned, "card_trig")


@series("P1_align", f"with {_AL} select acq_id, kind, idx, case when kind <> 'resp_trig' then round(time, 6) end as time from al")
def _(tb):
    return physio.align(tb.signal, tb.timing).select("acq_id", "kind", "idx", _r("time").alias("time"))


@query("P2_slice_window", """with o as (select distinct l_orderkey as acq_id, l_linenumber * 0.25::double as onset from lineitem), g as (select acq_id, onset, onset - lag(onset) over (partition by acq_id order by onset) as gap from o)
    select acq_id, coalesce(arg_min(gap, case when gap is not null then onset end), 0) as slice_window, coalesce(max(gap) <> min(gap), false) as uneven from g group by 1""")
def _(tb):
    onsets = tb.base("lineitem").selectExpr("l_orderkey as acq_id", "l_linenumber * 0.25D as onset")
    return physio.slice_window(onsets)


@series("P3_slice_times", f"with {_AL} select acq_id, slice, frame, round(time, 6) as time from times")
def _(tb):
    return physio.slice_times(tb.timing).select("acq_id", "slice", F.col("frame").cast("long").alias("frame"), _r("time").alias("time"))


@series("P4_cardiac_phase", f"with {_AL}, {_CARD} select acq_id, slice, frame, round(phase, 6) as phase from cp")
def _(tb):
    times, _, triggers = _parts(tb)
    return physio.cardiac_phase(times, triggers, tb.timing).withColumn("phase", _r("phase"))


@series("P5_respiratory_phase", f"with {_AL}, {_SMOOTH}, {_RESP} select acq_id, slice, frame, round(phase, 6) as phase from rp")
def _(tb):
    times, wave, _ = _parts(tb)
    return physio.respiratory_phase(times, wave, 0.04).withColumn("phase", _r("phase"))


@series("P6_zero_phase", f"with {_AL}, {_SMOOTH} select acq_id, idx, round(s, 5) as smooth from smooth")
def _(tb):
    _, wave, _ = _parts(tb)
    return physio.zero_phase(wave, 0.04).withColumn("smooth", _r("smooth", 5))


# every other recording sampled at 0.05 s
_STEP = "(case when {}acq_id % 2 = 0 then 0.04::double else 0.05::double end)"
_TAPS5 = physio.lowpass_taps(0.05)
_WEIGHTS2 = ", ".join(f"({k - 19}, {float(w)!r}::double, {float(v)!r}::double)" for k, (w, v) in enumerate(
    zip(np.correlate(_TAPS, _TAPS, mode="full"), np.correlate(_TAPS5, _TAPS5, mode="full"))))
_AL2 = _AL.replace("0.04::double", _STEP.format(""))
_SMOOTH2 = _SMOOTH.replace(_WEIGHTS, _WEIGHTS2).replace("k(o, c)", "k(o, c, d)").replace("x.value * k.c", "x.value * case when w.acq_id % 2 = 0 then k.c else k.d end")
_RESP2 = _RESP.replace("0.04::double", _STEP.format("t."))


def _mixed(tb):
    """Test bed with two sampling steps: times, respiration, steps, timing."""
    timing = tb.timing.withColumn("resp_dt", F.when(F.col("acq_id") % 2 == 0, 0.04).otherwise(0.05))
    aligned = cut_lineage(physio.align(tb.signal, timing))
    return physio.slice_times(timing), physio.chopped(aligned, "resp_wave"), physio.scan_lengths(timing).select("acq_id", "resp_dt"), timing


@series("P5_mixed_steps", f"with {_AL2}, {_SMOOTH2}, {_RESP2} select acq_id, slice, frame, round(phase, 6) as phase from rp")
def _(tb):
    times, wave, steps, _ = _mixed(tb)
    return physio.respiratory_phase(times, wave, steps).withColumn("phase", _r("phase"))


@series("P6_mixed_steps", f"with {_AL2}, {_SMOOTH2} select acq_id, idx, round(s, 5) as smooth from smooth")
def _(tb):
    _, wave, steps, _ = _mixed(tb)
    return physio.zero_phase(wave, steps).withColumn("smooth", _r("smooth", 5))


_TERMS = "select c.acq_id, c.slice, c.frame, cos(c.phase) as c1_c, sin(c.phase) as s1_c, cos(2 * c.phase) as c2_c, sin(2 * c.phase) as s2_c, cos(r.phase) as c1_r, sin(r.phase) as s1_r, cos(2 * r.phase) as c2_r, sin(2 * r.phase) as s2_r from cp c join rp r using (acq_id, slice, frame)"


@series("P7_fourier_terms", f"with {_AL}, {_CARD}, {_SMOOTH}, {_RESP}, f as ({_TERMS}) select acq_id, slice, frame, " + ", ".join(f"round({n}, 5) as {n}" for n in physio.REGRESSORS[:8]) + " from f")
def _(tb):
    times, wave, triggers = _parts(tb)
    terms = physio.fourier_terms(physio.cardiac_phase(times, triggers, tb.timing), physio.respiratory_phase(times, wave, 0.04))
    return terms.select("acq_id", "slice", "frame", *[_r(n, 5).alias(n) for n in physio.REGRESSORS[:8]])


_RRF = "0.6::double * pow(k, 2.1) * exp(-k / 1.6::double) - 0.0023::double * pow(k, 3.54) * exp(-k / 4.25::double)"
_CRF = "0.6::double * pow(k, 2.7) * exp(-k / 1.6::double) - 16 * exp(-pow((k - 12) / 3.0::double, 2) / 2) / (3 * sqrt(2 * pi()))"


def _fold(source: str, value: str, shape: str, out: str) -> str:
    return f"""{out}k as (select k, ({shape}) / max({shape}) over () as h from (select unnest(range(0, 39))::double as k)),
    {out}c as (select acq_id, slice, frame, {value} - avg({value}) over (partition by acq_id, slice) as v from {source}),
    {out}f as (select a.acq_id, a.slice, a.frame, sum(b.v * k.h) as y from {out}c a join {out}c b on a.acq_id = b.acq_id and a.slice = b.slice and b.frame <= a.frame join {out}k k on k.k = a.frame - b.frame group by 1, 2, 3),
    {out} as (select acq_id, slice, frame, y, coalesce(y - lag(y) over w, lead(y) over w - y) as d from {out}f window w as (partition by acq_id, slice order by frame))"""


_RV = """rv as (select t.acq_id, t.slice, t.frame, stddev_pop(w.value) as rv from times t join wn using (acq_id) left join wave w on w.acq_id = t.acq_id
      and w.idx >= greatest(0, floor((t.time - 3) / 0.04::double)) and w.idx < least(n + 1, floor((t.time + 3) / 0.04::double)) group by 1, 2, 3)"""
_RV2 = _RV.replace("0.04::double", _STEP.format("t."))
_HR = """beat as (select acq_id, p + (time - p) / 2 as time, 60.0::double / (time - p) as rate from (select acq_id, time, lag(time) over (partition by acq_id order by time) as p from trig) q where p is not null and 60.0::double / (time - p) between 30 and 180),
    nb as (select acq_id, count(*) as n from beat group by 1),
    b0 as (select t.*, n, (select max((b.time, b.rate)) from beat b where b.acq_id = t.acq_id and b.time <= t.time) as lo, (select min((b.time, b.rate)) from beat b where b.acq_id = t.acq_id and b.time >= t.time) as hi from times t left join nb using (acq_id)),
    hr as (select acq_id, slice, frame, case when coalesce(n, 0) <= 2 then 0 when lo is null then hi[2] when hi is null or hi[1] = lo[1] then lo[2] else (hi[2] - lo[2]) / (hi[1] - lo[1]) * (time - lo[1]) + lo[2] end as hr from b0)"""


@series("P8_respiration_variation", f"with {_AL}, {_SMOOTH}, {_RV}, {_fold('rv', 'rv', _RRF, 'rr')} select acq_id, slice, frame, round(y, 5) as rv_rrf, round(d, 5) as rv_rrf_d from rr")
def _(tb):
    times, wave, _ = _parts(tb)
    out = physio.respiration_variation(times, wave, tb.timing, 0.04)
    return out.select("acq_id", "slice", "frame", _r("rv_rrf", 5).alias("rv_rrf"), _r("rv_rrf_d", 5).alias("rv_rrf_d"))


@series("P8_mixed_steps", f"with {_AL2}, {_SMOOTH2}, {_RV2}, {_fold('rv', 'rv', _RRF, 'rr')} select acq_id, slice, frame, round(y, 5) as rv_rrf, round(d, 5) as rv_rrf_d from rr")
def _(tb):
    times, wave, steps, timing = _mixed(tb)
    out = physio.respiration_variation(times, wave, timing, steps)
    return out.select("acq_id", "slice", "frame", _r("rv_rrf", 5).alias("rv_rrf"), _r("rv_rrf_d", 5).alias("rv_rrf_d"))


@series("P10_too_few_frames", f"select acq_id, slice, '{physio.REJECTED}' as name from timing where acq_id % 3 = 1")
def _(tb):
    timing = tb.timing.withColumn("nframes", F.when(F.col("acq_id") % 3 == 1, 2).otherwise(F.col("nframes")))
    return physio.too_short(timing).select("acq_id", "slice", "name")


@series("P9_heart_rate", f"with {_AL}, {_HR}, {_fold('hr', 'hr', _CRF, 'hc')} select acq_id, slice, frame, round(hr, 5) as hr, round(y, 5) as hr_crf, round(d, 5) as hr_crf_d from hc join hr using (acq_id, slice, frame)")
def _(tb):
    times, _, triggers = _parts(tb)
    out = physio.heart_rate_response(times, triggers, tb.timing)
    return out.select("acq_id", "slice", "frame", *[_r(c, 5).alias(c) for c in ("hr", "hr_crf", "hr_crf_d")])


@series("W10_interpolated_rate", f"with {_AL}, {_HR} select acq_id, slice, frame, round(hr, 5) as hr from hr")
def _(tb):
    times, _, triggers = _parts(tb)
    return physio.interpolate_rate(times, physio.heart_rates(triggers)).withColumn("hr", _r("hr", 5))


@series("W13_design_scores", f"with {_AL}, {_HR} select acq_id, slice, frame, round((hr - avg(hr) over w) / nullif(stddev_pop(hr) over w, 0), 4) as score from hr window w as (partition by acq_id, slice)")
def _(tb):
    times, _, triggers = _parts(tb)
    rates = physio.interpolate_rate(times, physio.heart_rates(triggers))
    scores = physio.design_scores(cut_lineage(rates.select("acq_id", "slice", "frame", F.lit("hr").alias("name"), F.col("hr").alias("value"))))
    return scores.select("acq_id", "slice", "frame", _r("value", 4).alias("score"))


@series("P9_window_rate", f"""with {_AL}, r as (select t.acq_id, t.slice, t.frame, case when count(g.time) >= 2 then (count(g.time) - 1) * 60.0::double / (max(g.time) - min(g.time)) end as r from times t
    left join trig g on g.acq_id = t.acq_id and g.time between t.time - 3 and t.time + 3 group by 1, 2, 3)
    select acq_id, slice, frame, round(coalesce(last_value(r ignore nulls) over (partition by acq_id, slice order by frame rows unbounded preceding), 60), 5) as hr from r""")
def _(tb):
    times, _, triggers = _parts(tb)
    return physio.window_rate(times, triggers).withColumn("hr", _r("hr", 5))


_LONG = " union all ".join(f"select acq_id, slice, frame, '{n}' as name, {n} as v from f" for n in physio.REGRESSORS[:8])
_LONG += " union all select acq_id, slice, frame, 'rv_rrf', y from rr union all select acq_id, slice, frame, 'rv_rrf_d', d from rr union all select acq_id, slice, frame, 'hr_crf', y from hc union all select acq_id, slice, frame, 'hr_crf_d', d from hc"


# all thirteen regressors, detrended; "select" follows
_REGRESSORS = f"""with {_AL}, {_CARD}, {_SMOOTH}, {_RESP}, f as ({_TERMS}), {_RV}, {_fold('rv', 'rv', _RRF, 'rr')}, {_HR}, {_fold('hr', 'hr', _CRF, 'hc')}, lg as ({_LONG}),
    o as (select *, frame - 8.5 as p1, (frame - 8.5)**2 - 323.0::double / 12 as p2 from lg), q as (select acq_id, slice, name, avg(v) as w0, sum(v * p1) / sum(p1 * p1) as w1, sum(v * p2) / sum(p2 * p2) as w2 from o group by 1, 2, 3),
    done as (select acq_id, slice, frame, name, v - w0 - w1 * p1 - w2 * p2 as value from o join q using (acq_id, slice, name) union all select acq_id, slice, frame, 'hr', hr from hr)"""


@series("P10_regressors", f"{_REGRESSORS} select acq_id, slice, frame, name, round(value, 4) as value from done")
def _(tb):
    return physio.regressors(tb.signal, tb.timing).withColumn("value", _r("value", 4))


_PULSE = """tr2 as (select acq_id, time - lag(time) over (partition by acq_id order by time) as gap from al where kind = 'card_trig'),
    g as (select acq_id, avg(case when 60.0::double / gap between 30 and 200 then 1.0::double else 0 end) as good from tr2 where gap is not null group by 1),
    c as (select acq_id, stddev_pop(value) as sd from signal where kind = 'card_wave' group by 1)"""
_BANDS = """w as (select acq_id, idx, value, count(*) over (partition by acq_id) as n from signal where kind = 'resp_wave'),
    k as (select unnest(range(2, 251)) as k), sp as (select acq_id, k, sqrt(sum(value * cos(2 * pi() * ((k * idx) % n) / n))**2 + sum(value * sin(2 * pi() * ((k * idx) % n) / n))**2) as a from w, k where k < 20 or k > 230 group by 1, 2)"""


@series("P11_validity", f"""with {_AL}, {_PULSE}, {_BANDS}, b as (select acq_id, avg(case when k < 20 then a end) / avg(case when k > 230 then a end) as ratio from sp group by 1),
    r as (select acq_id, nframes, sd, good, ratio from (select distinct acq_id, nframes from timing) t left join c using (acq_id) left join g using (acq_id) left join b using (acq_id))
    select acq_id, round(sd, 5) as card_std, round(good, 6) as good_rate, round(ratio, 5) as ratio,
      nframes >= {physio.MIN_FRAMES} and (coalesce(sd > {physio.MIN_CARD_STD} and good > {physio.MIN_GOOD_RATE}, false) or coalesce(ratio > {physio.MIN_RESP_RATIO}, false)) as valid from r""")
def _(tb):
    return physio.validity(tb.signal, tb.timing).select("acq_id", _r("card_std", 5).alias("card_std"), _r("good_rate").alias("good_rate"),
                                                        _r("ratio", 5).alias("ratio"), "valid")


@series("A14_pulse_quality", f"with {_AL}, {_PULSE} select acq_id, round(sd, 5) as card_std, round(good, 6) as good_rate from c left join g using (acq_id)")
def _(tb):
    return physio.pulse_quality(physio.align(tb.signal, tb.timing)).select("acq_id", _r("card_std", 5).alias("card_std"), _r("good_rate").alias("good_rate"))


@series("A15_band_ratio", """with w as (select acq_id, idx, value, count(*) over (partition by acq_id) as n from signal where kind = 'resp_wave'),
    k as (select unnest(range(2, 251)) as k), sp as (select acq_id, k, sqrt(sum(value * cos(2 * pi() * ((k * idx) % n) / n))**2 + sum(value * sin(2 * pi() * ((k * idx) % n) / n))**2) as a from w, k where k < 20 or k > 230 group by 1, 2)
    select acq_id, round(avg(case when k < 20 then a end) / avg(case when k > 230 then a end), 5) as ratio from sp group by 1""")
def _(tb):
    return physio.band_ratio(tb.signal.where("kind = 'resp_wave'"), 0.04).withColumn("ratio", _r("ratio", 5))


@query("P12_attach_outcome", """select id, case when num_slices = 1 or scanner_name = 'scanner X' then null when not physio_recorded then 'physio not recorded' when id % 3 = 0 then 'no physio files found' when id % 2 = 0 then 'valid physio found' else 'invalid physio found and discarded' end as outcome from epoch""")
def _(tb):
    e = tb.catalog.epoch
    return e.select("id", physio.attach_outcome(F.col("physio_recorded"), F.col("num_slices") > 1, F.col("scanner_name"), F.col("id") % 3 != 0,
                                                F.col("id") % 2 == 0, ("scanner X",)).alias("outcome"))


@series_and_views("P12_attach_recordings", f"""with {_PHYSIO}, {_AL}, {_PULSE}, {_BANDS}, bands as (select acq_id, avg(case when k < 20 then a end) / avg(case when k > 230 then a end) as ratio from sp group by 1),
    verdict as (select acq_id, nframes >= {physio.MIN_FRAMES} and (coalesce(sd > {physio.MIN_CARD_STD} and good > {physio.MIN_GOOD_RATE}, false) or coalesce(ratio > {physio.MIN_RESP_RATIO}, false)) as valid
        from (select distinct acq_id, nframes from timing) t left join c using (acq_id) left join g using (acq_id) left join bands using (acq_id)),
    hit as (select epoch_id, any_value(s.psd) as psd, min(f.ts) as ts from scans s join files f on s.psd = f.psd and f.ts >= s.t
        and cast(f.ts as date) between cast(s.t as date) and cast(s.t as date) + 1 group by epoch_id)
    select e.id as id, case when e.num_slices = 1 or e.scanner_name = 'scanner X' then null when not e.physio_recorded then 'physio not recorded' when hit.ts is null then 'no physio files found'
        when coalesce(v.valid, false) then 'valid physio found' else 'invalid physio found and discarded' end as outcome,
      case when e.num_slices <> 1 and e.scanner_name <> 'scanner X' and e.physio_recorded and v.valid then 'RESPData_' || hit.psd || '_' || strftime(hit.ts, '%m%d%Y%H_%M_%S') || '_0' end as file
    from epoch e left join hit on hit.epoch_id = e.id left join verdict v on v.acq_id = extract(second from hit.ts) % 20""")
def _(tb):
    """Epochs, the files of J12 and the verdicts of P11 in one join; a file holds the recording its second tells."""
    files = recording_files(tb).withColumn("acq_id", (F.second("ts") % 20).cast("long"))
    return physio.attach(tb.catalog.epoch, files, physio.validity(tb.signal, tb.timing), ("scanner X",))


_DESIGN = 16  # columns of a slice's design: 1, t, t^2, the last regressor, then the twelve that are taken out
_ORDERED = ("hr", *physio.REGRESSORS[:-1])


def _least_squares() -> str:
    """The fit in SQL: the design's columns are made orthogonal one after another, then solved from the last one back."""
    scores = f"""scored as (select acq_id, slice as z, frame, name, coalesce((value - avg(value) over w) / nullif(stddev_pop(value) over w, 0), 0) as value
        from done window w as (partition by acq_id, slice, name)),
      x0 as (select acq_id, z, list(1.0::double order by frame) filter (name = 'hr') as c0, list(frame - 8.5::double order by frame) filter (name = 'hr') as c1,
        list((frame - 8.5::double)**2 order by frame) filter (name = 'hr') as c2, {', '.join(f"list(value order by frame) filter (name = '{n}') as c{3 + i}" for i, n in enumerate(_ORDERED))}
        from scored group by acq_id, z)"""
    steps = [scores, f"x1 as (select *, {', '.join(f'c{i} as o{i}' for i in range(4, _DESIGN))} from x0)"]
    for j in range(_DESIGN):
        share = lambda i: f"coalesce(list_dot_product(c{j}, c{i}) / nullif(list_dot_product(c{j}, c{j}), 0), 0)"
        later = range(j + 1, _DESIGN)
        less = ", ".join(f"list_transform(range(1, len(c{i}) + 1), lambda n: c{i}[n] - c{j}[n] * {share(i)}) as c{i}" for i in later)
        kept = "".join(f", {share(i)} as r{j}_{i}" for i in later) if j >= 4 else ""
        steps.append(f"x{j + 2} as (select *{f' replace ({less})' if less else ''}{kept} from x{j + 1})")
    back = [f"y as (select v.acq_id, v.x, v.y, v.z, list(v.v order by v.t) as whole, list(v.v order by v.t)[1:18] as seen from voxel v group by 1, 2, 3, 4)",
            f"b{_DESIGN} as (select * from y join x{_DESIGN + 1} using (acq_id, z))"]
    for j in range(_DESIGN - 1, 3, -1):
        rest = "".join(f" - r{j}_{i} * w{i}" for i in range(j + 1, _DESIGN))
        back.append(f"b{j} as (select *, coalesce(list_dot_product(c{j}, seen) / nullif(list_dot_product(c{j}, c{j}), 0), 0){rest} as w{j} from b{j + 1})")
    taken = " - ".join(["seen[n]", *(f"o{i}[n] * w{i}" for i in range(4, _DESIGN))])
    back.append(f"clean as (select acq_id, x, y, z, whole, seen, list_transform(range(1, 19), lambda n: {taken}) as less from b4)")
    back.append("fitted as (select acq_id, x, y, z, whole, less, (list_var_samp(seen) - list_var_samp(less)) / list_var_samp(seen) as gain from clean)")
    return ", ".join([*steps, *back])


@series("P13_denoise", f"""{_REGRESSORS}, {_least_squares()} select acq_id, x, y, z, t::int as t, round(case when t < 18 then less[t + 1] else whole[t + 1] end, 4) as v, round(gain, 4) as variance_reduced
    from (select *, unnest(range(0, len(whole))) as t from fitted)""")
def _(tb):
    return physio.denoise(tb.voxel, physio.regressors(tb.signal, tb.timing)).select(
        "acq_id", "x", "y", "z", "t", _r("v", 4).alias("v"), _r("variance_reduced", 4).alias("variance_reduced"))


@series("A22_slice_regression", f"{_REGRESSORS}, {_least_squares()} select acq_id, z, cast(sum(len(whole)) as bigint) as n, round(sum(gain * len(whole)) / sum(len(whole)), 4) as variance_reduced from fitted group by 1, 2")
def _(tb):
    out = physio.denoise(tb.voxel, physio.regressors(tb.signal, tb.timing))
    return out.groupBy("acq_id", "z").agg(F.count(F.lit(1)).alias("n"), _r(F.avg("variance_reduced"), 4).alias("variance_reduced"))


@query("A17_variance_reduced", "select event_type, round((var_samp(value) - var_samp(value / 2)) / var_samp(value), 6) as reduced from events group by 1")
def _(tb):
    v = lambda c: F.var_samp(c)
    return tb.base("events").groupBy("event_type").agg(_r((v("value") - v(F.col("value") / 2)) / v("value")).alias("reduced"))


@series_and_views("P14_recompute", f"""{_REGRESSORS}, scope as (select distinct e.id as id from dataset d join epoch e on d.container_id = e.id join session s on e.session_id = s.id join subject u on s.subject_id = u.id
    where u.experiment_id = 3 and d.kind = 'peripheral' and d.filetype = 'physio' and d.id % 3 = 0) select scope.id as acq_id, slice, frame, name, round(value, 4) as value from done join scope on scope.id % 20 = done.acq_id""")
def _(tb):
    """Regressors of all epochs of an experiment that hold one archive; those with two or none are left out."""
    archive = F.when(F.col("id") % 3 == 0, F.array(F.lit("a_physio.tgz"), F.lit("a_physio_regressors.csv.gz"))).when(
        F.col("id") % 3 == 1, F.array(F.lit("a_physio.tgz"), F.lit("b_physio.tgz"))).otherwise(F.col("filenames"))
    archived = tb.catalog.replace(dataset=tb.catalog.dataset.withColumn("filenames", F.when(F.col("filetype") == "physio", archive).otherwise(F.col("filenames"))))
    owners = tb.catalog.epoch.select(F.col("id"), (F.col("id") % 20).alias("acq_id"))  # a recording belongs to every epoch of its remainder
    held = physio.recompute_scope(archived, 3).select(F.col("epoch_id").alias("id")).distinct().join(owners, "id")
    own = lambda rows: rows.join(held, "acq_id").drop("acq_id").withColumnRenamed("id", "acq_id")
    return physio.recompute(archived, 3, own(tb.signal), own(tb.timing)).withColumn("value", _r("value", 4))


@query("P14_recompute_scope", """select e.id as epoch_id from dataset d join epoch e on d.container_id = e.id join session s on e.session_id = s.id join subject u on s.subject_id = u.id
    where u.experiment_id = 3 and d.kind = 'peripheral' and d.filetype = 'physio' and contains(d.filenames, '_physio.tgz')""")
def _(tb):
    return physio.recompute_scope(tb.catalog, 3).select("epoch_id")
