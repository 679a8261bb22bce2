"""Uniform sharding: exact sizes, gapless slots, the distribution of the matrix, odd input."""

import math
from collections import Counter

import numpy as np
import pytest

from scanloom.llm.queries import QUERIES
from scanloom.llm.sharding import communication_matrix, hypergeometric, shard_rows
from tests.llm.support import docs_frame, write_documents


def check(rows, shards):
    places = {}
    for r in rows:
        places.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(places.get(j, [])) for j in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in places.values())


def test_hypergeometric_follows_its_distribution():
    rng = np.random.default_rng(1)
    draws = Counter(hypergeometric(rng, 7, 13, 6) for _ in range(20_000))
    for k in range(7):
        p = math.comb(7, k) * math.comb(13, 6 - k) / math.comb(20, 6)
        assert abs(draws[k] / 20_000 - p) < 0.012
    big = [hypergeometric(rng, 4 * 10**9, 28 * 10**9, 10**6) for _ in range(200)]
    assert abs(np.mean(big) - 125_000) < 5 * 331 / math.sqrt(200)


def test_matrix_margins():
    sizes = {3: 17, 0: 0, 9: 1000, 4: 1}
    matrix, goal = communication_matrix(sizes, 8, 5)
    assert {p: sum(r) for p, r in matrix.items()} == sizes
    assert [sum(r[j] for r in matrix.values()) for j in range(8)] == goal
    assert max(goal) - min(goal) <= 1


@pytest.mark.parametrize("n", [0, 1, 7, 8, 4001])
def test_exact_sizes_and_gapless_slots(spark, n):
    rows = shard_rows(spark.range(n).toDF("doc_id"), 8).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(n))
    check(rows, 8)


def test_shuffle_is_uniform(spark):
    rows = shard_rows(spark.range(0, 8000, 1, 4).toDF("doc_id"), 8).collect()
    table = np.zeros((8, 8))
    for r in rows:
        table[r["doc_id"] // 1000, r["shard"]] += 1
    assert ((table - 125) ** 2 / 125).sum() < 100  # 49 degrees of freedom
    half = [r["slot"] < 500 for r in rows if r["doc_id"] < 4000]
    assert abs(np.mean(half) - 0.5) < 0.05


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(1, "a"), (1, "a"), (None, None), (2, ""), (3, "é" * 50_000)]
    out = QUERIES["op1_sharding"](spark, write_documents(spark, tmp_path, rows)).collect()
    assert sorted((r["size"] for r in out)) == [1, 1, 2, 2, 100_001]
    assert {r["law"] for r in out} == {"rows"} and {r["grown_shard"] for r in out} == {None}
    check(out, 8)


def test_clashing_columns_are_replaced(spark):
    df = docs_frame(spark, [(i, "x") for i in range(20)]).selectExpr("doc_id", "'old' as shard", "'old' as slot")
    out = shard_rows(df, 4)
    assert out.columns == ["doc_id", "shard", "slot"]
    check(out.collect(), 4)
