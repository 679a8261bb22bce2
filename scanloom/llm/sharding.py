"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.common import staged

ROWS_PER_BIN = 2048  # rows of a shard that one window group permutes
MATRIX_BROADCAST = 1_000_000  # cells of the matrix up to which it is broadcast


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` from ``good + bad`` are good: inversion of the distribution around its mode.

    Ratios of neighbouring probabilities are summed within 12 standard deviations, so populations of any
    size work; what lies outside is below the resolution of a double.
    """
    low, high, total = max(0, draws - bad), min(draws, good), good + bad
    if low == high:
        return low
    mode = (draws + 1) * (good + 1) // (total + 2)
    spread = math.sqrt(draws * (good / total) * (bad / total)) if total else 0.0
    width = int(12 * spread) + 40
    low, high = max(low, min(mode - width, high)), min(high, max(mode + width, low))
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(mass, rng.random() * mass[-1], side="right").clip(0, high - low))


def communication_matrix(sizes: dict[int, int], shards: int, seed: int) -> tuple[dict[int, list[int]], list[int]]:
    """Rows: what each partition sends to each shard. Row sums are partition sizes, column sums shard sizes."""
    rng, total = np.random.default_rng(seed), sum(sizes.values())
    goal = [total // shards + (j < total % shards) for j in range(shards)]
    room, matrix = list(goal), {}
    for part in sorted(sizes):
        left, free, row = sizes[part], sum(room), []
        for j in range(shards):
            free -= room[j]
            take = hypergeometric(rng, room[j], free, left)
            row.append(take)
            left -= take
        room = [r - t for r, t in zip(room, row)]
        matrix[part] = row
    return matrix, goal


def shard_rows(df: DataFrame, shards: int, seed: int = 17) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 within the shard).

    Every arrangement of the rows is equally likely; shard sizes differ by one at most. Each partition permutes
    its rows and writes them with their place, the matrix of counts is drawn, rows go where their place falls
    in their partition's row of the matrix, and each shard permutes again, in bins of bounded size.
    Nulls, repeated rows and empty tables are ordinary input; columns named ``shard`` or ``slot`` are replaced.
    """
    spark = df.sparkSession
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    permuted = (df.drop("shard", "slot")
                .withColumns({"__first": F.rand(seed), "__second": F.rand(seed + 1), "__part": F.spark_partition_id()})
                .sortWithinPartitions("__part", "__first")
                .withColumn("__place", place))
    permuted = staged(permuted, "shards")
    sizes = {r["__part"]: r["n"] for r in permuted.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    matrix, goal = communication_matrix(sizes, shards, seed)
    bins = max(1, -(-max(goal) // ROWS_PER_BIN))
    bounds = spark.createDataFrame([(p, np.cumsum(row).tolist()) for p, row in matrix.items()],
                                   "__part int, __bounds array<long>")
    if len(matrix) * shards <= MATRIX_BROADCAST:
        bounds = F.broadcast(bounds)
    sent = (permuted.join(bounds, "__part")
            .withColumn("shard", F.size(F.filter("__bounds", lambda b: b <= F.col("__place"))))
            .withColumn("__bin", F.floor(F.col("__second") * bins).cast("int"))
            .drop("__bounds"))
    earlier = Window.partitionBy("shard").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = (sent.groupBy("shard", "__bin").agg(F.count("*").alias("__n"))
              .select("shard", "__bin", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start")))
    within = Window.partitionBy("shard", "__bin").orderBy("__second", "__part", "__place")
    return (sent.withColumn("__rank", F.row_number().over(within) - 1)
            .join(starts, ["shard", "__bin"])
            .withColumn("slot", F.col("__start") + F.col("__rank"))
            .select(*[c for c in df.columns if c not in ("shard", "slot")], "shard", "slot"))
