"""Missing slices against a direct computation: bands, edges, adjacent missing slices, acquisitions without any, repeated rows."""

import random

from scanloom.operators import repair


def test_equals_direct_computation(spark):
    r = random.Random(4)
    values = {(a, x, 0, z, t): r.random() for a in (1, 2, 3, 4) for x in range(2) for z in range(9) for t in range(3)}
    voxel = spark.createDataFrame([(*k, v) for k, v in values.items()], "acq_id long, x int, y int, z int, t int, v double").repartition(4)
    lists = [(1, 1, 3, 3), (1, 1, 3, 3), (2, 0, 4, 3), (3, 2, 1, 2), (5, 1, 2, 2), (4, None, 2, 2), (4, 1, 2, 0)]
    missing = spark.createDataFrame(lists, "acq_id long, first_missing int, nslices int, mux int")
    lost = {(a, f + b * n) for a, f, n, m in lists if f is not None for b in range(m)}
    want = {}
    for (a, x, y, z, t), v in values.items():
        sides = [values.get((a, x, y, z + d, t)) for d in (-1, 1)]
        want[a, x, y, z, t] = v if (a, z) not in lost else None if None in sides else sum(sides) / 2
    out = repair.fill_missing_slices(voxel, missing).collect()
    assert len(out) == len(values)
    assert {(o["acq_id"], o["x"], o["y"], o["z"], o["t"]): o["v"] for o in out} == want
