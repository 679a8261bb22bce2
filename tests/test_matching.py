"""Joins and ordered operators against brute force, also with one key owning most rows."""

import difflib
import io
import random
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from scanloom.functions import text
from scanloom.operators import matching, ordering


def _rows(seed, n, keys):
    rng = random.Random(seed)
    # key 0 owns more than half of the rows
    return [(0 if rng.random() < 0.6 else rng.randrange(1, keys), float(rng.randrange(0, 3000)), i) for i in range(n)]


def test_bracket_equals_brute_force(spark):
    asks, hits = _rows(1, 400, 5), _rows(2, 150, 5)
    probe = spark.createDataFrame(asks, "k int, at double, id int")
    build = spark.createDataFrame(hits, "k int, at double, id int")
    for inclusive in (True, False):
        got = matching.bracket(probe, build, ["k"], "at", ["id"], inclusive, 100.0).collect()
        assert len(got) == len({(k, t) for k, t, _ in asks})
        for row in got:
            same = [(t, i) for k, t, i in hits if k == row.k]
            below = [h for h in same if h[0] < row.at or (inclusive and h[0] == row.at)]
            above = [h for h in same if h[0] > row.at or (inclusive and h[0] == row.at)]
            best_b = min(i for t, i in below if t == max(below)[0]) if below else None
            best_a = min(above)[1] if above else None
            assert (row.before.id if row.before else None) == best_b
            assert (row.after.id if row.after else None) == best_a


def test_range_join_equals_brute_force(spark):
    spans = [(k, t, t + 37.0, i) for k, t, i in _rows(3, 200, 4)]
    points = _rows(4, 300, 4)
    got = matching.range_join(spark.createDataFrame(spans, "k int, low double, high double, i int"),
                              spark.createDataFrame(points, "k int, point double, j int"), ["k"], "low", "high", "point", 20.0)
    want = sorted((i, j) for k, lo, hi, i in spans for q, t, j in points if k == q and lo <= t <= hi)
    assert sorted((r.i, r.j) for r in got.collect()) == want


def test_running_total_over_a_hot_key(spark):
    rows = _rows(5, 3000, 6)
    df = spark.createDataFrame(rows, "k int, t double, id int")
    got = {r.id: r for r in ordering.running_total(
        ordering.running_total(df, ["k"], ["t", "id"], F.col("id"), "total", ranges=7), ["k"], ["t", "id"], F.col("id"), "peak", ranges=5,
        how="max").collect()}
    assert len(got) == len(rows)
    for key in {k for k, _, _ in rows}:
        total, peak = 0, -1
        for k, t, i in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            total, peak = total + i, max(peak, i)
            assert (got[i].total, got[i].peak) == (total, peak)


def test_group_median(spark):
    rows = _rows(6, 501, 4)
    got = {r.k: r.median for r in ordering.group_median(spark.createDataFrame(rows, "k int, v double, id int"), ["k"], "v").collect()}
    for key, value in got.items():
        v = sorted(t for k, t, _ in rows if k == key)
        n = len(v)
        assert value == (v[(n - 1) // 2] + v[n // 2]) / 2


def test_near_over_block_edges(spark):
    df = spark.range(100).select(F.lit(1).alias("k"), F.col("id").alias("i"), (F.col("id") * F.col("id")).alias("v"))
    got = ordering.near(df, ["k"], "i", 2, 3, lambda w: {"p": F.lag("v", 2).over(w), "n": F.lead("v", 3).over(w)}, block=7).collect()
    assert len(got) == 100
    for r in got:
        assert r.p == ((r.i - 2) ** 2 if r.i >= 2 else None) and r.n == ((r.i + 3) ** 2 if r.i + 3 < 100 else None)


def test_chunked_lists_are_bounded_and_whole(spark):
    df = spark.range(95).select(F.lit("a").alias("k"), F.col("id").alias("o"), F.col("id").cast("string").alias("v"))
    got = sorted(ordering.chunked_lists(df, ["k"], ["o"], "v", chunk=10).collect(), key=lambda r: r.part)
    assert max(len(r["items"]) for r in got) == 10
    assert [v for r in got for v in r["items"]] == [str(i) for i in range(95)]


def test_lab_match_equals_close_matches(spark):
    rng = random.Random(7)
    known = ["".join(rng.choice("abc_") for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    known = sorted(set(known))
    asks = []
    for _ in range(300):
        text = list(rng.choice(known))
        for _ in range(rng.randrange(0, 4)):
            place = rng.randrange(0, len(text) + 1)
            if rng.random() < 0.5:
                text.insert(place, rng.choice("abcd"))
            elif text:
                text.pop(min(place, len(text) - 1))
        asks.append("".join(text))
    got = {r.lab_id: r.gid for r in matching.match_labs(
        spark.createDataFrame([(a,) for a in asks], "lab_id string"), spark.createDataFrame([(g,) for g in known], "gid string")).collect()}
    for ask in set(asks):
        close = difflib.get_close_matches(ask, known, cutoff=0.8)
        assert got.get(ask) == (close[0] if len(close) == 1 else None), ask


def test_pieces_lose_no_pair_at_any_cutoff(spark):
    """Random texts over few characters and their edits, of unequal lengths, non-ASCII and repeated letters among them."""
    rng = random.Random(8)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 16))) for _ in range(60)] + ["a" * 9, "z" * 300, ""]

    def edited(text):
        for _ in range(rng.randrange(0, 5)):
            at = rng.randrange(0, len(text) + 1)
            text = text[:at] + rng.choice(["", "a", "é", "xb"]) + text[at + rng.randrange(0, 3):]
        return text

    labs = sorted({edited(t) for t in base for _ in range(6)})
    gids = sorted(set(base))
    left = spark.createDataFrame([(t,) for t in labs], "lab string")
    right = spark.createDataFrame([(t,) for t in gids], "gid string")
    for cutoff in (0.6, 0.8, 0.93, 1.0):
        met = matching.shared_pieces(left, right, cutoff).collect()
        found = {(r.lab, r.gid) for r in met}
        assert len(met) == len(found)
        close = {(a, g) for a in labs for g in gids if a and g and difflib.SequenceMatcher(None, g, a).ratio() >= cutoff
                 or a and g and difflib.SequenceMatcher(None, a, g).ratio() >= cutoff}
        assert close <= found


def _plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_recording_names_are_parsed_once(spark):
    names = [f"RESPData_{psd}_0102201510_{minute:02d}_{second:02d}_{part}" for psd in ("a_b", "c")
             for minute, second, part in ((0, 5, 0), (0, 5, 25), (7, 0, 0))] + ["RESPData_c_0103201523_00_00_0", "nothing", "RESPData_c_9902201510_00_00_0"]
    raw = spark.createDataFrame([(n,) for n in names], "name string")
    files = raw.select("name", text.physio_file_psd("name").alias("psd"), text.physio_file_time("name").alias("ts"))
    scans = spark.createDataFrame([(1, "a_b", "2015-01-02 09:59:00"), (2, "a_b", "2015-01-02 10:00:00"), (3, "c", "2015-01-02 10:06:30"),
                                   (4, "c", "2015-01-02 20:00:00"), (5, "c", "2015-01-01 23:00:00"), (6, "c", "2015-01-04 00:00:00"), (7, None, "2015-01-02 10:00:00")],
                                  "epoch_id int, psd string, timestamp string").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    found = matching.physio_files(scans, files)
    assert "regexp_extract" not in _plan(found)
    assert sorted((r.epoch_id, r.name) for r in found.collect()) == [
        (1, "RESPData_a_b_0102201510_00_05_0"), (2, "RESPData_a_b_0102201510_07_00_0"),
        (3, "RESPData_c_0102201510_07_00_0"), (4, "RESPData_c_0103201523_00_00_0"), (5, "RESPData_c_0102201510_00_05_0")]


def test_calibration_scan_reads_epochs_once(spark):
    rng = random.Random(7)
    rows = [dict(id=i, session_id=rng.choice([None, 1, 1, 2, 3, 4]), size_x=rng.choice([64, 96]), size_y=64, series=rng.randrange(0, 9),
                 psd=rng.choice(["muxepi", "muxepi", "mux2", "spiral", None]), num_bands=rng.choice([1, 3, 3, 3, 3, 3, None]), num_mux_cal_cycle=rng.choice([0, 1, 2, 3, None]),
                 description=rng.choice(["a_pe1", "a_pe0", "b", None]), trash=rng.random() < 0.2) for i in range(200)]
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], "id int, session_id int, size_x int, size_y int, series int, psd string, num_bands int, "
                                  "num_mux_cal_cycle int, description string, trash boolean")
    epochs = (spark.range(200).withColumnRenamed("id", "_id").join(frame, F.col("_id") == F.col("id"))
              .withColumn("trashtime", F.when(F.col("trash"), F.lit("2001-01-01").cast("timestamp_ntz"))))
    found = matching.calibration_scan(epochs)
    assert "Range (" not in _plan(found)
    live = [r for r in rows if not r["trash"] and (r["psd"] or "").startswith("mux")]
    place = lambda r: (r["session_id"], r["size_x"], r["size_y"])
    single = {place(r) for r in live if r["num_bands"] == 1}
    cycles = lambda r: -1 if r["num_mux_cal_cycle"] is None else r["num_mux_cal_cycle"]
    want = {}
    for t in rows:
        if t["psd"] != "muxepi" or (t["num_bands"] or 0) <= 1 or t["session_id"] is None or t["description"] is None:
            continue
        if place(t) in single:
            pool = [r for r in live if r["num_bands"] == 1]
        elif 0 <= cycles(t) < 2:
            pool = [r for r in live if r["num_bands"] != 1 and cycles(r) >= 2]
        else:
            continue
        near = [(abs(r["series"] - t["series"]), r["series"] - t["series"], r["id"]) for r in pool
                if place(r) == place(t) and r["description"] is not None and ("pe1" in r["description"]) == ("pe1" in t["description"])]
        if near:
            want[t["id"]] = min(near)[2]
    assert {r.epoch_id: r.calibration_id for r in found.collect()} == want and len(want) > 10
