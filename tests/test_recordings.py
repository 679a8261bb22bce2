"""Recordings of their own sampling steps, bounded spectra, linear windows and lineage rounds against plain computations."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scanloom.operators import matching, physio


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl).repartition(3)


def test_chirp_bins_equal_the_transform():
    rng = np.random.default_rng(1)
    for n in (7, 64, 1009):
        x = rng.normal(size=n)
        whole = np.fft.fft(x)
        for first, count in ((0, n), (3, 2), (n - 1, 1)):
            total = sum(physio.chirp_bins(x[a:a + 50], a, first, count, n) for a in range(0, n, 50))
            assert np.allclose(total, whole[first:first + count], atol=1e-9 * n)


def expected_ratio(values, dt):
    a, low = np.abs(np.fft.rfft(values)), int(round(dt * len(values)))
    return a[2:low].mean() / a[-low:].mean()


def test_spectrum_of_long_recordings(spark):
    """300,000 samples beside short ones, each with its own step; no task holds more than one block and one part."""
    rng = np.random.default_rng(2)
    waves = {1: rng.normal(size=300_000).cumsum(), 2: rng.normal(size=900), 3: rng.normal(size=501)}
    steps = {1: 0.04, 2: 0.1, 3: 0.02}
    rows = pd.concat([pd.DataFrame({"acq_id": k, "idx": np.arange(len(v)), "value": v}) for k, v in waves.items()])
    table = spark.createDataFrame(list(steps.items()), "acq_id long, resp_dt double")
    got = {r.acq_id: r.ratio for r in physio.band_ratio(spark.createDataFrame(rows), table, block=20_000, part=5_000).collect()}
    for k, v in waves.items():
        assert got[k] == pytest.approx(expected_ratio(v, steps[k]), rel=1e-7)


def test_weights_equal_the_taps(spark):
    rows = spark.createDataFrame([(0.04,), (0.05,), (0.01,)], "dt double")
    for r in rows.select("dt", physio.lowpass_weights("dt").alias("w")).collect():
        taps = physio.lowpass_taps(r.dt)
        assert np.allclose(r.w, np.correlate(taps, taps, mode="full"), atol=1e-15)


def recording(rng, acq, n, dt):
    t = np.arange(n) * dt
    wave = np.sin(t * 1.7) + rng.normal(size=n) * 0.1
    beats = np.arange(3, n - 3, int(0.9 / dt))
    return ([(acq, "resp_wave", i, float(v)) for i, v in enumerate(wave)] + [(acq, "card_wave", i, float(v * 9)) for i, v in enumerate(wave)]
            + [(acq, "card_trig", i, float(b)) for i, b in enumerate(beats)])


def test_each_recording_has_its_own_step(spark):
    """Two recordings together give what each gives alone; one of two frames is handed back."""
    rng = np.random.default_rng(3)
    ddl, timed = "acq_id long, kind string, idx int, value double", "acq_id long, tr double, nframes int, slice int, onset double, slice_window double, card_dt double, resp_dt double"
    signals = {1: recording(rng, 1, 700, 0.04), 2: recording(rng, 2, 500, 0.06), 3: recording(rng, 3, 500, 0.04)}
    timing = {k: [(k, 1.0, n, s, 0.5 * s, 0.5, dt, dt) for s in (0, 1)] for k, n, dt in ((1, 12, 0.04), (2, 10, 0.06), (3, 2, 0.04))}
    both = physio.regressors(frame(spark, sum(signals.values(), []), ddl), frame(spark, sum(timing.values(), []), timed)).collect()
    got = {(r.acq_id, r.slice, r.frame, r.name): r.value for r in both}
    assert {k[:3] for k, v in got.items() if k[3] == physio.REJECTED} == {(3, 0, None), (3, 1, None)}
    assert not [k for k in got if k[0] == 3 and k[3] != physio.REJECTED]
    for k, dt in ((1, 0.04), (2, 0.06)):
        alone = physio.regressors(frame(spark, signals[k], ddl), frame(spark, timing[k], timed), dt).collect()
        want = {(r.acq_id, r.slice, r.frame, r.name): r.value for r in alone}
        assert {i for i in got if i[0] == k} == set(want)
        assert all(got[i] == pytest.approx(v, abs=1e-9) for i, v in want.items())


def test_window_moments(spark):
    """Ties, empty and reversed windows, bounds on points, far from zero; work does not follow the density."""
    rng = random.Random(5)
    points = [(k, float(rng.randrange(0, 200)), 1e6 + rng.gauss(0, 3)) for k in (1, 2) for _ in range(300)] + [(3, 5.0, 1.0)]
    spans = [(n, rng.choice([1, 2, 3, 4]), lo, lo + rng.choice([-1.0, 0.0, 3.0, 40.0, 500.0])) for n in range(200) for lo in [rng.randrange(-20, 230) / 2]]
    out = matching.window_moments(frame(spark, spans, "n int, k int, low double, high double"), frame(spark, points, "k int, p double, v double"),
                                  ["k"], "low", "high", "p", "v", 16.0)
    assert "range" not in out._jdf.queryExecution().executedPlan().toString().lower().replace("rangepartitioning", "")
    got = {r.n: r for r in out.collect()}
    assert len(got) == len(spans)
    for n, k, low, high in spans:
        inside = [v for g, p, v in points if g == k and low <= p <= high]
        assert got[n]._n == len(inside)
        if inside:
            assert got[n]._mean == pytest.approx(np.mean(inside), rel=1e-12) and got[n]._std == pytest.approx(np.std(inside), abs=1e-6)
        else:
            assert got[n]._mean is None and got[n]._std is None


def test_lineage_rounds_write_new_pairs_only(spark, monkeypatch):
    written = []
    cut = matching.cut_lineage

    def counted(df):
        out = cut(df)
        written.append({r.depth for r in out.select("depth").distinct().collect()})
        return out
    monkeypatch.setattr(matching, "cut_lineage", counted)
    edges = [(i, i + 1) for i in range(21)] + [(0, 5), (30, 31), (31, 32), (30, 32)]
    got = {(r.child_id, r.ancestor_id): r.depth for r in matching.ancestors(frame(spark, edges, "child_id long, parent_id long")).collect()}
    want = {}
    for start in {a for a, _ in edges}:
        front, depth = {start}, 0
        while front:
            depth += 1
            front = {b for a, b in edges if a in front and (start, b) not in want}
            want.update({(start, b): depth for b in front})
    assert got == want
    assert written == [{1}, {2}, {3, 4}, set(range(5, 9)), set(range(9, 17)), set(range(17, 21)), set()]
