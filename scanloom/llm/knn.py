"""Exact top-k by inner product as a Voronoi kNN join: pivots, bounds from summaries, only needed data replicated."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.common import arrow_map, staged

SCALE = 1024
QUERIES_PER_CELL = 2048
FEWEST_CELLS, MOST_CELLS = 8, 1024  # bounds the pivots that reach the driver and every task
PART_ROWS = 16_384  # data rows of one local join
QUERY_ROWS = 512  # queries multiplied at a time
CHUNK_ROWS = 4096  # query vectors of one local join


def scaled_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector, norm2): components floor(1024 x) as doubles, little-endian, for the rows that take part.

    Rows with a null id, a null vector, or a null or non-finite component take no part.
    """
    def step(batch: pa.RecordBatch):
        ids, vectors = batch.column(0).to_pylist(), batch.column(1)
        out = []
        for i, v in zip(ids, vectors):
            if i is None or not v.is_valid or v.values.null_count:
                continue
            x = np.floor(SCALE * v.values.to_numpy(zero_copy_only=False).astype(np.float64))
            if np.isfinite(x).all():
                out.append((i, x.tobytes(), float(x @ x)))
        cols = list(zip(*out)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.float64())],
                                         ["vec_id", "vector", "norm2"])
    read = df.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>"))
    return arrow_map(read, step, "vec_id long, vector binary, norm2 double")


def matrix(vectors: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of doubles; shorter vectors end in zeros."""
    out = np.zeros((len(vectors), dims))
    for row, v in enumerate(vectors.to_pylist()):
        out[row, :len(v) // 8] = np.frombuffer(v)
    return out


def lifted(x: np.ndarray, most: float, query: bool) -> np.ndarray:
    """One more coordinate makes all data equally long, so the greatest inner product is the least distance."""
    extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(most - (x * x).sum(1), 0))
    return np.column_stack([x, extra])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


def products(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Exact: sums of whole doubles below 2**53, else whole numbers of any size."""
    if most < 2**52:
        return a @ b.T
    big = lambda m: np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)
    return np.clip(big(a) @ big(b).T, -(2**63), 2**63 - 1)


def top_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def spared(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the best 2 k, of which any one id takes at most k: without that id, the k highest are still among them."""
    some = top_of(scores, ids, 2 * k)
    if len(some) and np.unique(ids[some], return_counts=True)[1].max() > k:
        some = np.lexsort((ids, -scores))
        by_id = some[np.argsort(ids[some], kind="stable")]
        first = np.searchsorted(ids[by_id], ids[by_id])
        taken = np.zeros(len(ids), bool)
        taken[by_id[np.arange(len(by_id)) - first < k]] = True
        some = some[taken[some]][:2 * k]
    return some


def top_k(data: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``data`` (see scaled_vectors) where ``is_query`` holds.

    Data and query vectors fall to their nearest pivot; a vector that many queries share is searched once. From each
    cell's radius and its 2 k least distances follows how far the last neighbour wanted in a query cell can be; a data
    row goes to a query cell only if it can be so near. Query cells are cut in chunks and their data in parts, both of
    bounded size, and the parts' best are merged. A query's own id is no candidate; since only afterwards it is known
    which id that is, 2 k rows are kept of each vector, at most k of one id. Repeated queries (id and vector) count
    once, repeated candidates each.
    """
    spark = data.sparkSession
    data = staged(data, "vectors")
    asked = data.filter(is_query).select("vec_id", "vector").distinct()
    facts = data.agg(F.count("*").alias("n"), F.max("norm2").alias("most"), F.max(F.octet_length("vector")).alias("bytes"),
                     F.count(F.when(is_query, 1)).alias("queries")).first()
    most, dims = facts["most"] or 0.0, max(1, (facts["bytes"] or 0) // 8)
    cells = min(MOST_CELLS, max(FEWEST_CELLS, -(-facts["queries"] // QUERIES_PER_CELL)))
    drawn = data.orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(cells).collect()
    if not drawn or not facts["queries"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = lifted(matrix(pa.array([bytes(r["vector"]) for r in drawn], pa.binary()), dims), most, False)
    cells = len(pivots)

    def place(query: bool):
        def step(batch: pa.RecordBatch):
            far = distances(lifted(matrix(batch.column("vector"), dims), most, query), pivots)
            cell = far.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int64)), pa.array(far[np.arange(len(cell)), cell])],
                                             [*batch.schema.names, "cell", "far"])
        return step

    placed = staged(arrow_map(data.select("vec_id", "vector"), place(False), "vec_id long, vector binary, cell long, far double"), "cells")
    # numbered as they are written, so the numbers stay as they are read
    queries = staged(arrow_map(asked.select("vector").distinct(), place(True), "vector binary, cell long, far double")
                     .withColumn("number", F.monotonically_increasing_id()), "cells")

    def nearest(batch: pa.RecordBatch):
        cell, far = batch.column("cell").to_numpy(), batch.column("far").to_numpy()
        order = np.lexsort((far, cell))
        cell, far = cell[order], far[order]
        first = np.searchsorted(cell, cell)
        few = np.arange(len(cell)) - first < 2 * k
        yield pa.RecordBatch.from_arrays([pa.array(cell[few]), pa.array(far[few])], ["cell", "far"])

    # one row for each id: rows of one id beyond k are never wanted
    apart = placed.groupBy("vec_id").agg(F.min(F.struct("far", "cell")).alias("row")).select("row.cell", "row.far")
    least = (arrow_map(apart, nearest, "cell long, far double")
             .withColumn("at", F.row_number().over(Window.partitionBy("cell").orderBy("far"))).filter(F.col("at") <= 2 * k).collect())
    radius = {r["cell"]: (r["n"], r["far"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    reach = {r["cell"]: (r["far"], r["n"]) for r in queries.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()}
    between, slack = distances(pivots, pivots), 1e-6 * (1 + most ** 0.5)
    bound, parts, chunks = np.full(cells, -1.0), np.zeros(cells, np.int64), np.zeros(cells, np.int64)
    for i, (wide, n) in reach.items():
        upper = np.sort([wide + between[i, r["cell"]] + r["far"] for r in least])
        bound[i] = (upper[2 * k - 1] if len(upper) >= 2 * k else np.inf) + slack
        parts[i] = max(1, -(-sum(c for j, (c, far) in radius.items() if between[i, j] - wide - far <= bound[i]) // PART_ROWS))
        chunks[i] = -(-n // CHUNK_ROWS)
    wanted = sorted(reach)

    def replicate(batch: pa.RecordBatch):
        cell, far = batch.column("cell").to_numpy(), batch.column("far").to_numpy()
        deal = np.arange(len(cell))
        for i in wanted:
            gap = np.abs(between[i, cell] - far) - reach[i][0]
            near = np.flatnonzero(gap <= bound[i])
            for chunk in range(chunks[i] if len(near) else 0):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(near), i)), pa.array(np.full(len(near), chunk, np.int64)), pa.array(deal[near] % parts[i]),
                     batch.column("vec_id").take(pa.array(near)), batch.column("vector").take(pa.array(near))], ["cell", "chunk", "part", "vec_id", "vector"])

    def spread(batch: pa.RecordBatch):
        cell = batch.column("cell").to_numpy()
        copies = parts[cell]
        rows = np.repeat(np.arange(len(copies)), copies)
        part = np.arange(len(rows)) - np.repeat(np.cumsum(copies) - copies, copies)
        chunk = (np.arange(len(cell)) % np.maximum(chunks[cell], 1))[rows]
        some = pa.array(rows)
        yield pa.RecordBatch.from_arrays([batch.column("cell").take(some), pa.array(chunk), pa.array(part), batch.column("number").take(some), batch.column("vector").take(some)],
                                         ["cell", "chunk", "part", "number", "vector"])

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, rows = right.column("vec_id").to_numpy(), matrix(right.column("vector"), dims)
            own, vectors = left.column("number").to_numpy(), left.column("vector")
            for at in range(0, len(own), QUERY_ROWS):
                scores = products(matrix(vectors.slice(at, QUERY_ROWS), dims), rows, most)
                for number, line in zip(own[at:at + QUERY_ROWS].tolist(), scores):
                    out += [(number, int(ids[b]), int(line[b])) for b in spared(line, ids, k).tolist()]
        cols = list(zip(*out)) or [[]] * 3
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("number", "vec_id", "score"), cols)})

    keys = ["cell", "chunk", "part"]
    asks = arrow_map(queries.select("number", "vector", "cell"), spread, "cell long, chunk long, part long, number long, vector binary")
    found = (asks.groupBy(*keys).cogroup(arrow_map(placed, replicate, "cell long, chunk long, part long, vec_id long, vector binary").groupBy(*keys))
             .applyInArrow(solve, "number long, vec_id long, score long"))
    same = Window.partitionBy("number", "vec_id").orderBy(F.desc("score"))
    order = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    best = (found.withColumn("at", F.row_number().over(same)).filter(F.col("at") <= k)
            .withColumn("at", F.row_number().over(order)).filter(F.col("at") <= 2 * k)
            .groupBy("number").agg(F.sort_array(F.collect_list(F.struct("at", "vec_id", "score"))).alias("best")))
    answers = asked.join(queries.select("number", "vector"), "vector").join(best, "number")
    own = F.slice(F.filter("best", lambda c: c["vec_id"] != F.col("vec_id")), 1, k)
    return (answers.select(F.col("vec_id").alias("query_id"), F.posexplode(own).alias("at", "c"))
            .select("query_id", (F.col("at") + 1).alias("rank"), F.col("c.vec_id").alias("vec_id"), F.col("c.score").alias("score")))
