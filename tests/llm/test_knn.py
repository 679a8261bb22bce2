"""Top-k by inner product against brute force: ties, hot vectors, odd rows, many parts, large components."""

import numpy as np
import pytest

from pyspark.sql import functions as F
from scanloom.llm import knn
from scanloom.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=10):
    good = [(i, np.floor(1024 * np.array(v, np.float32).astype(float))) for i, v in rows
            if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    out = set()
    for q, a in good:
        if q % 100 == 0:
            scored = sorted((-int(sum(int(x) * int(y) for x, y in zip(a, b))), i) for i, b in good if i != q)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    return out


def rows():
    r = np.random.default_rng(6)
    centres = r.normal(size=(5, 8))
    out = [(i, (centres[i % 5] + 0.2 * r.normal(size=8)).tolist()) for i in range(1200)]
    out += [(2000 + i, centres[0].tolist()) for i in range(300)]  # one vector many times
    return out + [(None, [1.0] * 8), (5000, None), (5100, [1.0, None] * 4), (5200, [float("nan")] * 8), (5300, [float("inf")] * 8), (5400, []), (5500, [0.0] * 8)]


@pytest.mark.parametrize("part,cell", [(16_384, 2048), (100, 1)])
def test_equals_brute_force(spark, tmp_path, monkeypatch, part, cell):
    monkeypatch.setattr(knn, "PART_ROWS", part)
    monkeypatch.setattr(knn, "QUERIES_PER_CELL", cell)
    data = rows()
    spark.createDataFrame([(*x, 0) for x in data], SCHEMA).repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = QUERIES["op6_voronoi_top_k"](spark, str(tmp_path)).collect()
    assert len(out) == len({(r["query_id"], r["rank"]) for r in out})
    assert {tuple(r) for r in out} == brute(data)


@pytest.mark.parametrize("data", [[], [(1, [0.5])], [(100, [0.5])], [(100, [0.5]), (200, [-0.5]), (100, [0.5])]])
def test_few_rows(spark, tmp_path, data):
    spark.createDataFrame([(*x, 0) for x in data], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = {tuple(r) for r in QUERIES["op6_voronoi_top_k"](spark, str(tmp_path)).collect()}
    want = {(100, 1, 200, -262144), (200, 1, 100, -262144), (200, 2, 100, -262144)} if len(data) == 3 else set()
    assert out == want


def test_chunks_of_a_query_cell_and_rows_of_one_id(spark, monkeypatch):
    """One cell holds nearly all queries, many share a vector, and one id fills the first places of its own vector."""
    monkeypatch.setattr(knn, "CHUNK_ROWS", 3)
    monkeypatch.setattr(knn, "PART_ROWS", 50)
    r = np.random.default_rng(9)
    data = [(100 * i, (np.ones(4) + 0.01 * r.normal(size=4)).tolist()) for i in range(40)] + [(100 * i, [1.0] * 4) for i in range(40, 80)]
    data += [(300, [2.0] * 4)] * 25 + [(7, [3.0, 0.0, 0.0, 0.0])] * 15 + [(8, [-1.0] * 4)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(5)
    out = [tuple(x) for x in knn.top_k(knn.scaled_vectors(frame), F.col("vec_id") % 100 == 0).collect()]
    asked = {(i, tuple(v)) for i, v in data if i % 100 == 0}
    scaled = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in data]
    want = []
    for q, v in asked:
        a = [int(np.floor(1024 * float(np.float32(x)))) for x in v]
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in scaled if i != q)[:10]
        want += [(q, n + 1, i, -x) for n, (x, i) in enumerate(scored)]
    assert sorted(out) == sorted(want)


def test_no_id_takes_more_than_k():
    ids, scores = np.array([5] * 30 + [1, 2, 3]), np.array([9.0] * 30 + [1, 2, 9])
    assert ids[knn.spared(scores, ids, 3)].tolist() == [3, 5, 5, 5, 2, 1]
    assert ids[knn.spared(scores[:2], ids[:2], 3)].tolist() == [5, 5]


def test_only_near_cells_are_replicated():
    """Far apart groups: the bound of a query cell excludes the others' data."""
    pivots = np.array([[0.0, 0], [1000, 0]])
    assert knn.distances(pivots, pivots)[0, 1] == 1000
    lifted = knn.lifted(np.array([[3.0, 4], [0, 1]]), 25.0, False)
    assert np.allclose((lifted**2).sum(1), 25)


def test_products_beyond_doubles():
    a = np.array([[2.0**40, 3]])
    assert knn.products(a, a, 2.0**80)[0, 0] == 2**63 - 1
    assert knn.products(a[:, 1:], a[:, 1:], 9.0)[0, 0] == 9
