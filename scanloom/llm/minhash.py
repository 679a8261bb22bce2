"""Near-duplicate documents by MinHash with tensored banding; every link is confirmed on the full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.common import LOWEST, arrow_map, doc_key, staged, text_tag
from scanloom.llm.repeats import Spans, mixed
from scanloom.llm.substring import word_hashes

SHINGLE = 5  # words
PERCENT = 75  # similarity from which documents are linked
# Two collections of HALF half-keys, each of WIDTH minhashes; a table for every pair of half-keys. 2 * HALF * WIDTH
# minhashes stand for HALF**2 tables. At similarity s a pair shares a table with (1 - (1 - s**WIDTH)**HALF)**2:
# 0.9999 at 0.75, 0.99999 at 0.8.
HALF, WIDTH = 12, 2
AGREE = 20  # of the 48 minhashes that a compared pair must share; at similarity 0.75 fewer come with 1 in 10 million
BLOCK = 512  # documents that one task looks up among the others of their cluster
PART = 65_536  # others of a cluster that one task holds against them
CHUNK = 2048  # others compared at a time

_DRAWS = np.random.default_rng(75).integers(0, 1 << 63, (2, 2 * HALF * WIDTH), np.int64).astype(np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of the lower-cased words; fewer words than a shingle make one."""
    hashes = word_hashes((text or "").encode("utf-8", "replace").lower().split())
    if not len(hashes):
        return hashes
    n = max(1, len(hashes) - SHINGLE + 1)
    starts = np.arange(n)
    return np.unique(Spans(hashes).hashed(starts, np.minimum(starts + SHINGLE, len(hashes))))


def minhashes(found: np.ndarray) -> np.ndarray:
    least = np.full(_DRAWS.shape[1], np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 8192):
        part = (found[at:at + 8192] ^ _DRAWS[0][:, None]) * (_DRAWS[1][:, None] | np.uint64(1))
        np.minimum(least, (part ^ (part >> np.uint64(32))).min(1), out=least)
    return least


def sketches(docs: DataFrame) -> DataFrame:
    """Per row its key, tag, set size, two hashes of the set, half-keys of both collections, and 16 bits of each minhash."""
    def step(batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows = []
            for text in part.column("__text").to_pylist():
                found = shingles(text)
                least = minhashes(found)
                ids = mixed(np.array([np.bitwise_xor.reduce(mixed(found)) if len(found) else 0, found.sum(dtype=np.uint64)], np.uint64)
                            + np.uint64(len(found)))
                halves = mixed((least.reshape(2 * HALF, WIDTH) * np.uint64(0x9E3779B97F4A7C15) ** np.arange(1, WIDTH + 1, dtype=np.uint64)).sum(1, dtype=np.uint64))
                rows.append((len(found), ids.view(np.int64), halves.view(np.int64), (least >> np.uint64(48)).astype(np.uint16).view(np.int16)))
            n, ids, halves, lanes = (np.stack([r[k] for r in rows]) for k in range(4))
            lists = lambda m, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m).ravel(), kind))
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("tag"), pa.array(n, pa.int64()), pa.array(ids[:, 0]), pa.array(ids[:, 1]),
                 lists(halves[:, :HALF], pa.int64()), lists(halves[:, HALF:], pa.int64()), lists(lanes, pa.int16())],
                ["key", "tag", "n", "set1", "set2", "left", "right", "lanes"])
    return arrow_map(docs.select("key", "tag", "__text"), step,
                     "key long, tag long, n long, set1 long, set2 long, left array<long>, right array<long>, lanes array<short>")


def _info(n: str = "n", tag: str = "tag") -> Column:
    return F.shiftleft(F.col(tag), 32).bitwiseOR(F.col(n))


def _size(info: str) -> Column:
    return F.col(info).bitwiseAND(F.lit(0xFFFFFFFF))


def _sizes_fit(a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def tables(classes: DataFrame) -> DataFrame:
    """(bucket, id, info) for all pairs of half-keys."""
    return (classes.select("id", "info", F.posexplode("left").alias("i", "a"), "right")
            .select("id", "info", "i", "a", F.posexplode("right").alias("j", "b"))
            .select(F.xxhash64("i", "a", "j", "b").alias("bucket"), "id", "info"))


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, a_info, b, b_info) whose full shingle sets reach the similarity, compared where both texts meet."""
    texts = docs.select("key", "tag", "__text")
    side = lambda s: texts.select(F.col("key").alias(s), F.col("tag").alias(f"{s}_tag"), F.col("__text").alias(f"{s}_text"))
    tagged = pairs.select("a", F.shiftright("a_info", 32).alias("a_tag"), "b", F.shiftright("b_info", 32).alias("b_tag"))
    both = tagged.join(side("b"), ["b", "b_tag"]).join(side("a"), ["a", "a_tag"]).select("a", "b", "a_text", "b_text")

    def step(batch: pa.RecordBatch):
        last, own, good = None, None, []
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for n, (x, y) in enumerate(zip(part.column("a_text").to_pylist(), part.column("b_text").to_pylist())):
                if x != last:
                    last, own = x, shingles(x)
                other = shingles(y)
                shared = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * shared >= PERCENT * (len(own) + len(other) - shared):
                    good.append(at + n)
        yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(good, pa.int64())), batch.column("b").take(pa.array(good, pa.int64()))], ["a", "b"])
    return arrow_map(both, step, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the least id reachable over ``links`` (a, b).

    In each round every vertex moves to its least neighbour's least neighbour, and edges are kept between the places
    moved to; the least vertex of a component never moves. Rounds are written tables and end when no edge is left.
    """
    edges = staged(links.select("a", "b").union(links.select("b", "a")).filter("a != b").distinct(), "edges")
    labels = staged(links.select(F.col("a").alias("id")).union(links.select("b")).distinct().withColumn("component", F.col("id")), "labels")
    while not edges.isEmpty():
        near = staged(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("to")), "moves")
        moves = staged(near.join(near.select(F.col("id").alias("to"), F.col("to").alias("far")), "to").select("id", F.col("far").alias("to")), "moves")
        end = lambda c: moves.select(F.col("id").alias(c), F.col("to").alias(f"{c}_to"))
        edges = staged(edges.join(end("a"), "a").join(end("b"), "b").filter("a_to != b_to")
                       .select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).distinct(), "edges")
        labels = staged(labels.join(moves.withColumnRenamed("id", "component"), "component", "left")
                        .select("id", F.coalesce("to", "component").alias("component")), "labels")
    return labels


def _clusters(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster, id, info, component, minor): documents that share a table key with one of another component so far.

    A cluster holds all documents that keys of several components connect. Its minor documents are those outside of its
    largest component; every pair of different components has one.
    """
    own = Window.partitionBy("bucket")
    apart = staged(shared.select("bucket", "id", "info").join(labels, "id", "left")
                   .withColumn("component", F.coalesce("component", "id"))
                   .withColumns({"low": F.min("component").over(own), "high": F.max("component").over(own), "first": F.min("id").over(own)})
                   .filter("low < high").select("first", "id", "info", "component").distinct(), "apart")
    clusters = components(apart.select(F.col("first").alias("a"), F.col("id").alias("b")))
    members = apart.select("id", "info", "component").distinct().join(clusters.withColumnRenamed("component", "cluster"), "id")
    main = (members.groupBy("cluster", "component").agg(F.count("*").alias("n"))
            .groupBy("cluster").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("members")))
    return members.join(main, "cluster").select("cluster", "id", "info", "component", "members", (F.col("component") != F.col("main.component")).alias("minor"))


def _links_across(clusters: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): links between different components of a cluster, found in the task that compares; no pair leaves it unlinked.

    Minor documents are dealt to blocks of BLOCK, their cluster's documents to parts of PART; a task streams one part
    past one block. Pairs must fit in size and agree on AGREE minhashes, then the full sets decide. Once a document is
    linked to a component, the task compares it with no more of that component.
    """
    numbered = (clusters.filter("minor").select("cluster", "id", "info")
                .withColumn("block", F.floor((F.row_number().over(Window.partitionBy("cluster").orderBy("id", "info")) - 1) / BLOCK)))
    blocks = numbered.groupBy("cluster").agg((F.max("block") + 1).alias("blocks"))
    placed = (clusters.join(numbered, ["cluster", "id", "info"], "left").join(blocks, "cluster")
              .withColumn("parts", F.ceil(F.col("members") / PART)).withColumn("tag", F.shiftright("info", 32)))
    texts = docs.select(F.col("key").alias("id"), "tag", "__text")

    def sets(batch: pa.RecordBatch):
        keep = ["cluster", "id", "component", "block", "blocks", "parts"]
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            found = [shingles(t) for t in part.column("__text").to_pylist()]
            lanes = [(minhashes(f) >> np.uint64(48)).astype(np.uint16).tobytes() for f in found]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array([f.tobytes() for f in found], pa.binary()), pa.array(lanes, pa.binary())],
                                             [*keep, "shingles", "lanes"])

    found = arrow_map(placed.join(texts, ["id", "tag"]).select("cluster", "id", "component", "block", "blocks", "parts", "__text"), sets,
                      "cluster long, id long, component long, block long, blocks long, parts long, shingles binary, lanes binary")
    columns = ["cluster", "block", "part", "role", "id", "component", "shingles", "lanes"]
    both = F.explode(F.array(*(F.lit(r) for r in (0, 1))))
    dealt = (found.withColumn("role", both).filter("role = 1 or block is not null")
             .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("role") == 0, F.col("parts")).otherwise(F.col("blocks")) - 1)))
             .withColumn("part", F.when(F.col("role") == 0, F.col("copy")).otherwise(F.pmod(F.xxhash64("id"), "parts")))
             .withColumn("block", F.when(F.col("role") == 0, F.col("block")).otherwise(F.col("copy")))
             .select(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, minors, linked = None, [], []
        for batch in batches:
            got: list[tuple[int, int]] = []
            head = list(zip(*(batch.column(c).to_pylist() for c in ("cluster", "block", "part", "role"))))
            ids, comps = (batch.column(c).to_numpy() for c in ("id", "component"))
            sets = [np.frombuffer(v, np.uint64) for v in batch.column("shingles").to_pylist()]
            lanes = np.frombuffer(b"".join(batch.column("lanes").to_pylist()), np.uint16).reshape(len(ids), -1)
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            start = 0
            while start < len(head):
                end = start + 1
                while end < len(head) and end - start < CHUNK and head[end] == head[start]:
                    end += 1
                if head[start][:3] != group:
                    group, minors, linked = head[start][:3], [], []
                if head[start][3] == 0:
                    minors += [(int(ids[r]), int(comps[r]), sets[r], lanes[r]) for r in range(start, end)]
                    linked += [{int(comps[r])} for r in range(start, end)]
                else:
                    for (own, _, mine, lane), done in zip(minors, linked):
                        n = sizes[start:end]
                        fit = 100 * np.minimum(n, len(mine)) >= PERCENT * np.maximum(n, len(mine))
                        for known in done:
                            fit &= comps[start:end] != known
                        some = start + np.flatnonzero(fit)
                        some = some[(lanes[some] == lane).sum(1) >= AGREE]
                        if not len(some):
                            continue
                        theirs = np.concatenate([sets[r] for r in some.tolist()])
                        at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                        shared = np.add.reduceat((mine[at] == theirs).astype(np.int64), np.cumsum(sizes[some]) - sizes[some])
                        for r in some[100 * shared >= PERCENT * (len(mine) + sizes[some] - shared)].tolist():
                            if int(comps[r]) not in done:
                                done.add(int(comps[r]))
                                got.append((own, int(ids[r])))
                start = end
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)], ["a", "b"])

    keys = ["cluster", "block", "part"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys, "role", "id").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(key, tag, n_shingles, component): one row per row of ``docs``.

    Documents of one shingle set form a class, represented by its smallest id. Representatives are entered into all
    tables; each is compared with its keys' smallest id, and after the components of those links, with the documents of
    other components that shared keys connect it with. Documents without words are linked with nothing. Rows of one id count as
    one document for components; a null id is the smallest. Chance of missing a link at the threshold: 1 in 10,000.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(doc_key().alias("key"), text.alias("__text")).withColumn("tag", text_tag("__text"))
    sketched = staged(sketches(keyed), "sketches")
    classes = (sketched.filter("n > 0").groupBy("set1", "set2")
               .agg(F.min(F.struct("key", "tag")).alias("first"), F.first("n").alias("n"), F.first("left").alias("left"),
                    F.first("right").alias("right"), F.first("lanes").alias("lanes"))
               .select("set1", "set2", F.col("first.key").alias("id"), _info("n", "first.tag").alias("info"), "left", "right", "lanes"))
    classes = staged(classes, "classes")
    own = Window.partitionBy("bucket")
    shared = staged(tables(classes).withColumns({"members": F.count("*").over(own), "first": F.min(F.struct("id", "info")).over(own)})
                    .filter("members > 1").select("bucket", "id", "info", "first"), "tables")
    lead = (shared.filter((F.col("first.id") != F.col("id")) & _sizes_fit(_size("first.info"), _size("info")))
            .select(F.col("first.id").alias("a"), F.col("first.info").alias("a_info"), F.col("id").alias("b"), F.col("info").alias("b_info"))
            .distinct())
    lanes = lambda s: classes.select(F.col("id").alias(s), F.col("info").alias(f"{s}_info"), F.col("lanes").alias(f"{s}_lanes"))
    agree = F.aggregate(F.zip_with("a_lanes", "b_lanes", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    likely = lead.join(lanes("b"), ["b", "b_info"]).join(lanes("a"), ["a", "a_info"]).filter(agree >= AGREE)
    links = staged(confirmed(likely.select("a", "a_info", "b", "b_info"), keyed), "links")
    found = components(links)
    more = staged(_links_across(_clusters(shared, found), keyed), "links")
    if not more.isEmpty():
        found = components(links.union(more))
    return (sketched.select("key", "tag", "n", "set1", "set2")
            .join(classes.select("set1", "set2", "id"), ["set1", "set2"], "left")
            .join(found, "id", "left")
            .select("key", "tag", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("key")).alias("component")))


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; a null id stays null and is its component's smallest."""
    back = lambda c: F.when(F.col(c) != LOWEST, F.col(c))
    return near_duplicates(docs).select(back("key").alias("doc_id"), "n_shingles", back("component").alias("component_id"),
                                        (F.col("key") == F.col("component")).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without all but the smallest id of each component; of rows equal in id and text one stays."""
    kept = near_duplicates(docs).filter(F.col("key") == F.col("component")).select(F.col("key").alias("__key"), F.col("tag").alias("__tag")).distinct()
    keyed = docs.withColumns({"__key": doc_key(), "__tag": text_tag()})
    return keyed.join(kept, ["__key", "__tag"], "left_semi").dropDuplicates(["__key", "__tag"]).select(*docs.columns)
