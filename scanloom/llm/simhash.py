"""SimHash near-duplicates by a Gray-order hierarchical index over rotated fingerprints.

Two fingerprints that differ in at most DISTANCE bits agree on all bits of at least one of DISTANCE + 1 blocks. The
index therefore keeps the distinct fingerprints in DISTANCE + 1 orders: each starts with another block and follows the
Gray rank of the rotated fingerprint, so that neighbours differ in few bits. The top nodes of an order hold the bits
of its leading block, which must agree; below them, runs of neighbours form nodes that hold the bits all their members
share (a mask and a pattern). Two nodes whose shared bits already differ too often are dropped with all that is below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanloom.llm.common import LOWEST, arrow_map, doc_key, staged
from scanloom.llm.minhash import components

SHINGLE = 4  # words
DISTANCE = 4  # bits
SEED = 42
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # (first bit from the left, bits) that lead an order
RUNS = (512, 64, 8)  # members of a node, by level
LEAF = 4096  # fingerprints of one top node that travel together
HELD = 65_536  # fingerprints that a task indexes at once
PAIRS = 1 << 20  # pairs looked at in one step
FAN = 8  # leaves below a node where a top node has several


def fingerprint(text: str | None) -> int:
    """64 bits, each set where over half of the shingles' hashes set it; shingles count as often as they occur."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - SHINGLE + 1)
    starts, stops = [0, *(ends[:n - 1] + 1).tolist()], ends[len(words) - n:].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, HELD):
        hashes = np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[at:at + HELD], stops[at:at + HELD])), "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(key, fp) of each row."""
    def step(batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([fingerprint(t.as_py()) for t in part.column("__text")], pa.int64())], ["key", "fp"])
    return arrow_map(docs.select(doc_key().alias("key"), F.col("text").cast("string").alias("__text")), step, "key long, fp long")


def gray_rank(code: Column) -> Column:
    """Position of a 64-bit code in the reflected Gray order, as a signed number that sorts like it."""
    for step in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, step))
    return code.bitwiseXOR(F.lit(LOWEST))


def rotated(first: int) -> Column:
    """The fingerprint turned so that bit ``first`` (from the left) leads."""
    fp = F.col("fp")
    return fp if first == 0 else F.shiftleft(fp, first).bitwiseOR(F.shiftrightunsigned(fp, 64 - first))


class Index:
    """Nodes over ``codes``, whose ``segments`` (first members) are the top nodes; finds links and joins what they connect."""

    def __init__(self, codes: np.ndarray, segments: np.ndarray):
        self.codes, self.label = codes, np.arange(len(codes))
        self.levels, starts = [], np.asarray(segments, np.int64)
        for size in (None, *RUNS):
            if size:
                ends = np.append(starts[1:], len(codes))
                runs = -(-(ends - starts) // size)
                child = np.cumsum(runs) - runs
                starts = np.repeat(starts - child * size, runs) + np.arange(int(runs.sum())) * size
                self.levels[-1] += (child, runs)
            both, either = np.bitwise_and.reduceat(codes, starts), np.bitwise_or.reduceat(codes, starts)
            self.levels.append((starts, ~(both ^ either), both))
        ends = np.append(starts[1:], len(codes))
        self.levels[-1] += (starts, ends - starts)

    def _joined(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            if not (apart := x != y).any():
                break
            np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while not np.array_equal(far := label[label], label):
                label = far
        self.label = label

    def search(self, a: np.ndarray, b: np.ndarray, level: int = 0) -> None:
        """Link members below nodes ``a`` with members below nodes ``b`` (of one level, a <= b)."""
        starts, _, _, child, count = self.levels[level]
        low, high = np.minimum.reduceat(self.label, starts), np.maximum.reduceat(self.label, starts)
        apart = (low[a] != low[b]) | (low[a] != high[a]) | (low[b] != high[b])  # the others are one component already
        a, b = a[apart], b[apart]
        fans = count[a] * count[b]
        done = 0
        while done < len(a):
            size = max(1, int(np.searchsorted(np.cumsum(fans[done:]), PAIRS, "right")))
            x, y, fan = a[done:done + size], b[done:done + size], fans[done:done + size]
            done += size
            nth = np.arange(int(fan.sum())) - np.repeat(np.cumsum(fan) - fan, fan)
            wide = np.repeat(count[y], fan)
            i, j = np.repeat(child[x], fan) + nth // wide, np.repeat(child[y], fan) + nth % wide
            if level + 1 < len(self.levels):
                _, mask, value = self.levels[level + 1][:3]
                near = (i <= j) & (np.bitwise_count((value[i] ^ value[j]) & mask[i] & mask[j]) <= DISTANCE)
                self.search(i[near], j[near], level + 1)
            else:
                near = (i < j) & (np.bitwise_count(self.codes[i] ^ self.codes[j]) <= DISTANCE)
                self._joined(i[near], j[near])

    def edges(self) -> bytes:
        """Pairs of codes (int64) that connect each component, one less than it has members."""
        linked = np.flatnonzero(self.label != np.arange(len(self.label)))
        return np.stack([self.codes[linked], self.codes[self.label[linked]]], 1).tobytes()


LEAVES = "order int, block long, place long, members binary, both long, either long, rep long, edges binary"


def leaves(distinct: DataFrame) -> DataFrame:
    """The orders, cut into leaves of at most LEAF neighbours of one top node, each indexed by itself.

    Rows without members carry edges (pairs of fingerprints). A leaf is returned where its top node may have others;
    ``place`` grows along the order, ``both`` and ``either`` are the bits set in all or any of its members, and ``rep``
    is a member if all of them are one component already.
    """
    orders = F.array(*(F.struct(F.lit(n).alias("order"), gray_rank(rotated(first)).alias("rank"), F.shiftrightunsigned(rotated(first), 64 - bits).alias("block"))
                       for n, (first, bits) in enumerate(BLOCKS)))
    dealt = (distinct.select("fp", F.explode(orders).alias("o")).select("o.order", "o.rank", "o.block", "fp")
             .repartitionByRange("order", "rank").sortWithinPartitions("order", "rank").select("order", "block", "fp"))
    names = [f.split()[0] for f in LEAVES.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def indexed(order: np.ndarray, block: np.ndarray, codes: np.ndarray, place: int) -> pa.RecordBatch:
        tops = np.append(0, np.flatnonzero((order[1:] != order[:-1]) | (block[1:] != block[:-1])) + 1)
        ends = np.append(tops[1:], len(codes))
        cuts = np.concatenate([np.arange(a, b, LEAF) for a, b in zip(tops.tolist(), ends.tolist())])
        index = Index(codes, cuts)
        index.search(np.arange(len(cuts)), np.arange(len(cuts)))
        rows = [(None,) * 7 + (edges,)] if (edges := index.edges()) else []
        low, high = np.minimum.reduceat(index.label, cuts), np.maximum.reduceat(index.label, cuts)
        top = np.searchsorted(tops, cuts, "right") - 1
        several = (ends - tops)[top] > LEAF
        for k in np.flatnonzero(several | (top == 0) | (top == len(tops) - 1)).tolist():
            part = codes[cuts[k]:(cuts[k + 1] if k + 1 < len(cuts) else len(codes))]
            both, either, rep = (int(v.view(np.int64)) for v in (np.bitwise_and.reduce(part), np.bitwise_or.reduce(part), codes[low[k]]))
            rows.append((int(order[cuts[k]]), int(block[cuts[k]]), place + k, part.tobytes(), both, either, rep if low[k] == high[k] else None, None))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = TaskContext.get().partitionId() << 40, []
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            if sum(len(h[0]) for h in held) >= HELD:
                order, block, fp = (np.concatenate(c) for c in zip(*held))
                yield indexed(order, block, fp.view(np.uint64), place)
                place, held = place + len(fp), []
        if sum(len(h[0]) for h in held):
            order, block, fp = (np.concatenate(c) for c in zip(*held))
            yield indexed(order, block, fp.view(np.uint64), place)

    return dealt.mapInArrow(run, LEAVES)


def _exploded(edges: DataFrame) -> DataFrame:
    def step(batch: pa.RecordBatch):
        for blob in batch.column(0):
            a, b = np.frombuffer(blob.as_buffer(), np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
    return arrow_map(edges.filter("edges is not null").select("edges"), step, "a long, b long")


def _near(a: str, b: str) -> Column:
    """Whether the bits that nodes ``a`` and ``b`` share among their members leave room for a link."""
    shared = [F.col(f"{n}.both").bitwiseXOR(F.bitwise_not(F.col(f"{n}.either"))) for n in (a, b)]  # all set or all clear
    differ = F.col(f"{a}.both").bitwiseXOR(F.col(f"{b}.both")).bitwiseAND(shared[0]).bitwiseAND(shared[1])
    joined = F.col(f"{a}.component") == F.col(f"{b}.component")
    return (F.bit_count(differ) <= DISTANCE) & ~F.coalesce(joined, F.lit(False))


def links_across(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges (a, b) between leaves of one top node, searched from the top down in both leaves' trees at once.

    FAN neighbouring leaves or nodes make a node. A pair of nodes is dropped when the bits that each shares differ too
    often, or when both are one component (``labels``) already, so large groups of copies cost little more than once.
    Only leaf keys are numbered by window, one row for up to LEAF fingerprints.
    """
    top = ["order", "block"]
    own = Window.partitionBy(*top)
    keys = (found.filter("members is not null").select(*top, "place", "both", "either", "rep")
            .join(labels.select(F.col("id").alias("rep"), F.col("component").alias("known")), "rep", "left")
            .withColumns({"component": F.coalesce("known", "rep"), "leaves": F.count("*").over(own), "node0": F.row_number().over(own.orderBy("place")) - 1})
            .filter("leaves > 1"))
    keys = staged(keys.select(*top, "place", "both", "either", "component", "leaves", F.col("node0").cast("long")), "leaf-keys")
    most = keys.agg(F.max("leaves")).first()[0]
    if most is None:
        return labels.sparkSession.createDataFrame([], "a long, b long")
    height = 1
    while FAN ** height < most:
        height += 1

    def nodes(level: int, name: str) -> DataFrame:
        node = F.shiftright("node0", 3 * level)
        return (keys.groupBy(*top, node.alias("node"))
                .agg(F.bit_and("both").alias("both"), F.bit_or("either").alias("either"), F.count("*").alias("n"), F.count("component").alias("known"),
                     F.min("component").alias("low"), F.max("component").alias("high"))
                .select(*top, F.shiftright("node", 3).alias(f"{name}_up"),
                        F.struct("node", "both", "either", F.expr("case when n = known and low = high then low end").alias("component")).alias(name)))

    pairs = nodes(height, "a").join(nodes(height, "b"), top).select(*top, F.col("a.node").alias("a_up"), F.col("b.node").alias("b_up"))
    for level in range(height - 1, -1, -1):
        halves = pairs.join(nodes(level, "a"), [*top, "a_up"])
        order = F.col("a.node") < F.col("b.node") if level == 0 else F.col("a.node") <= F.col("b.node")
        below = nodes(level, "b").select(*(F.col(c).alias(f"_{c}") for c in top), F.col("b_up").alias("_up"), "b")
        pairs = staged(halves.join(below, (F.col("order") == F.col("_order")) & (F.col("block") == F.col("_block")) & (F.col("b_up") == F.col("_up"))
                                   & order & _near("a", "b"))
                       .select(*top, F.col("a.node").alias("a_up"), F.col("b.node").alias("b_up")), "node-pairs")
    members = keys.select(*top, "place", "node0").join(found.filter("members is not null").select(*top, "place", "members"), [*top, "place"])
    side = lambda s: members.select(*top, F.col("node0").alias(f"{s}_up"), F.col("members").alias(s))
    both = pairs.join(side("a"), [*top, "a_up"]).join(side("b"), [*top, "b_up"]).select("a", "b")

    def step(batch: pa.RecordBatch):
        for x, y in zip(batch.column("a"), batch.column("b")):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            index = Index(np.concatenate([x, y]), np.array([0, len(x)]))
            index.search(np.array([0]), np.array([1]))
            a, b = np.frombuffer(index.edges(), np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
    return arrow_map(both, step, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(key, fp, component): one row per row of ``docs``; ``component`` is the smallest key reachable over links.

    Equal fingerprints are one member of the index, so exact copies, repeated rows and documents without words
    (fingerprint 0, linked like any other) cost one entry. A null id is the smallest key. Texts are read whole, in
    steps of HELD shingles. An empty table gives no rows. Only doc_id and text are read; other columns are left out.
    """
    marked = staged(fingerprints(docs), "fingerprints")
    distinct = staged(marked.groupBy("fp").agg(F.min("key").alias("key")), "distinct")
    found = staged(leaves(distinct), "leaves")
    links = staged(_exploded(found), "links")
    labels = components(links)
    more = staged(links_across(found, labels), "links")
    if not more.isEmpty():
        labels = components(links.union(more))
    grouped = distinct.join(labels.withColumnRenamed("id", "fp"), "fp", "left").withColumn("group", F.coalesce("component", "fp"))
    least = grouped.groupBy("group").agg(F.min("key").alias("least"))
    of_fp = staged(grouped.join(least, "group").select("fp", F.col("least").alias("component")), "of-fingerprint")
    return marked.join(of_fp, "fp").select("key", "fp", "component")


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id; a null id stays null and is its component's smallest."""
    back = lambda c: F.when(F.col(c) != LOWEST, F.col(c))
    return near_duplicates(docs).select(back("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                        back("component").alias("component_id"))
