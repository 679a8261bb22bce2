"""How far the word use of sources differs, counted exactly through minimal perfect hashes.

A first pass finds, per language, the terms frequent enough to keep. Those are dealt to shards; each shard becomes a
minimal perfect hash with its keys. A second pass counts only kept terms, in dense arrays with one slot a term, per
group (language, source). All figures are whole numbers, so the order of work never shows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanloom.llm.common import arrow_map, staged
from scanloom.llm.repeats import mixed

LEAST_DOCS = 30  # documents of a language that must hold a term
SHARD = 16_384  # terms of a shard, about
BROADCAST_BYTES = 64 << 20  # hashes that one recounting pass holds; more take more passes
CELLS = 1 << 21  # dense slots that a task holds before it hands them on
HELD_TERMS = 1 << 19  # counted terms that a task holds in the first pass
SALTS = 8  # parts in which a group's counts are added up first
SOURCES = 32  # sources of a block that are compared with those of another
TOP = 50
SEED = 42
SCALE, ADDED = 1_000_000_000, 5

_TERMS = bytes((b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20) for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def terms(text: str | None) -> list[bytes]:
    """Runs of letters and of characters beyond ASCII, with A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_TERMS).split()


def term_hashes(found: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest
    return np.fromiter((xxh64_intdigest(t, SEED) for t in found), np.uint64, len(found))


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """As ``pmod(xxhash64(term), shards)``."""
    return np.mod(hashes.view(np.int64), shards)


class PerfectHash:
    """Slots 0 to n - 1 for n keys: a bucket's displacement sends its keys to slots of their own.

    ``find`` compares the stored key, so other terms are told apart without error. ``moves`` holds a displacement per
    bucket, or ``-1 - slot`` for a bucket of one key.
    """

    def __init__(self, seed: int, moves: np.ndarray, ends: np.ndarray, keys: bytes):
        self.seed, self.moves, self.ends, self.keys = np.uint64(seed), moves, ends, keys

    @staticmethod
    def _slots(spread: np.ndarray, moves: np.ndarray, n: int) -> np.ndarray:
        return (mixed(spread + moves.astype(np.uint64) * _STEP) % np.uint64(n)).astype(np.int64)

    @classmethod
    def build(cls, keys: list[bytes]) -> PerfectHash:
        n, hashes = len(keys), term_hashes(keys)
        if len(np.unique(hashes)) < n:
            raise ValueError("two terms of a shard share a 64-bit hash: choose another SEED")
        for seed in range(1, 1000):
            spread = mixed(hashes ^ mixed(np.array([seed], np.uint64)))
            if (moves := cls._displaced(spread, n)) is not None:
                break
        slots = cls._of(spread, moves, n)
        ordered = [keys[k] for k in np.argsort(slots).tolist()]
        return cls(seed, moves, np.cumsum([len(k) for k in ordered], dtype=np.int64), b"".join(ordered))

    @classmethod
    def _displaced(cls, spread: np.ndarray, n: int) -> np.ndarray | None:
        buckets = max(1, n // 4)
        bucket = (spread >> np.uint64(33)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket.astype(np.int64), minlength=buckets)
        ends = np.cumsum(sizes)
        moves, free = np.zeros(buckets, np.int64), np.ones(n, bool)
        for k in np.argsort(-sizes, kind="stable").tolist():
            if sizes[k] <= 1:
                break
            own, first, window = spread[order[ends[k] - sizes[k]:ends[k]]], 0, 16
            while True:
                tried = np.arange(first, first + window)
                slots = np.sort(cls._slots(own[:, None], tried[None, :], n), axis=0)
                good = np.flatnonzero(free[slots].all(0) & (slots[1:] != slots[:-1]).all(0))
                if len(good):
                    moves[k] = first + good[0]
                    free[slots[:, good[0]]] = False
                    break
                first, window = first + window, min(4096, 2 * window)
                if first > 1 << 22:
                    return None
        single = np.flatnonzero(sizes == 1)
        moves[single] = -1 - np.flatnonzero(free)[:len(single)]
        return moves

    @classmethod
    def _of(cls, spread: np.ndarray, moves: np.ndarray, n: int) -> np.ndarray:
        own = moves[((spread >> np.uint64(33)) % np.uint64(len(moves))).astype(np.int64)]
        return np.where(own < 0, -1 - own, cls._slots(spread, np.maximum(own, 0), n))

    def find(self, found: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """The slot of each term, -1 if it is not a key."""
        slots = self._of(mixed(hashes ^ mixed(np.array([self.seed], np.uint64))), self.moves, len(self.ends))
        starts, ends = np.append(0, self.ends[:-1])[slots].tolist(), self.ends[slots].tolist()
        keys = self.keys
        same = np.fromiter((keys[a:b] == t for a, b, t in zip(starts, ends, found)), bool, len(found))
        return np.where(same, slots, -1)


HASHES = "lang string, shard long, n long, seed long, moves binary, ends binary, keys binary"


def _grouped(docs: DataFrame) -> DataFrame:
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(empty("lang").alias("lang"), empty("source").alias("source"), F.col("text").cast("string").alias("text"))


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """(lang, term) of the terms that at least ``least`` rows of the language hold; counted in tasks first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush():
            for lang, counts in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array([t.decode() for t in counts], pa.string()),
                                                  pa.array(list(counts.values()), pa.int64())], ["lang", "term", "docs"])
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                held.setdefault(lang, Counter()).update(set(terms(text.as_py())))
            if sum(map(len, held.values())) >= HELD_TERMS:
                yield from flush()
                held = {}
        yield from flush()
    counted = docs.select("lang", "text").mapInArrow(run, "lang string, term string, docs long")
    return counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least).select("lang", "term")


def perfect_hashes(kept: DataFrame) -> DataFrame:
    """One row per shard of a language's kept terms; their number follows from the language's terms."""
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v")).withColumn("shards", F.ceil(F.col("v") / SHARD))
    dealt = kept.join(sizes, "lang").select("lang", F.pmod(F.xxhash64("term"), "shards").alias("shard"), "term")

    def build(table: pa.Table) -> pa.Table:
        made = PerfectHash.build([t.encode() for t in table.column("term").to_pylist()])
        return pa.table({"lang": table.column("lang").slice(0, 1), "shard": table.column("shard").slice(0, 1), "n": pa.array([len(made.ends)]),
                         "seed": pa.array([int(made.seed)]), "moves": pa.array([made.moves.tobytes()], pa.binary()),
                         "ends": pa.array([made.ends.tobytes()], pa.binary()), "keys": pa.array([made.keys], pa.binary())})
    return dealt.groupBy("lang", "shard").applyInArrow(build, HASHES)


COUNTS = "lang string, source string, shard long, salt int, slots binary, counts binary"


def recount(docs: DataFrame, hashes: list, shards: dict[str, int]) -> DataFrame:
    """Partial counts of the terms in ``hashes`` (rows of perfect_hashes, broadcast), per group and shard."""
    from pyspark import TaskContext

    shared = docs.sparkSession.sparkContext.broadcast(
        ({}, shards, [(h["lang"], h["shard"], h["seed"], bytes(h["moves"]), bytes(h["ends"]), bytes(h["keys"])) for h in hashes]))
    names = [f.split()[0] for f in COUNTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang, of, packed = shared.value
        if not by_lang:  # once in a worker
            for lang, shard, seed, moves, ends, keys in packed:
                by_lang.setdefault(lang, {})[shard] = PerfectHash(seed, np.frombuffer(moves, np.int64), np.frombuffer(ends, np.int64), keys)
        salt = TaskContext.get().partitionId() % SALTS
        held: dict[tuple, np.ndarray] = {}

        def flush():
            if rows := [(*key, salt, (at := np.flatnonzero(slots)).astype("<i4").tobytes(), slots[at].tobytes()) for key, slots in held.items()]:
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            words: dict[tuple, Counter] = {}
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text")):
                if lang in by_lang:
                    words.setdefault((lang, source), Counter()).update(terms(text.as_py()))
            for (lang, source), counts in words.items():
                found, hashes = list(counts), term_hashes(list(counts))
                times = np.fromiter(counts.values(), np.int64, len(counts))
                shard = shard_of(hashes, of[lang])
                for s, perfect in by_lang[lang].items():
                    some = np.flatnonzero(shard == s)
                    slot = perfect.find([found[k] for k in some.tolist()], hashes[some])
                    known = slot >= 0
                    if known.any():
                        if (lang, source, s) not in held:
                            held[lang, source, s] = np.zeros(len(perfect.ends), np.int64)
                        held[lang, source, s][slot[known]] += times[some[known]]
                if sum(map(len, held.values())) >= CELLS:
                    yield from flush()
                    held = {}
        yield from flush()

    return docs.mapInArrow(run, COUNTS)


def _added(parts: DataFrame, keys: list[str]) -> DataFrame:
    """``parts`` with equal ``keys`` added up as a stream, so that no group is held; keys that go are dropped."""
    kept = [f"{c} {parts.schema[c].dataType.simpleString()}" for c in keys]

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for slots, counts in zip(batch.column("slots"), batch.column("counts")):
                at = np.frombuffer(slots.as_buffer(), "<i4")
                if len(at) and at[-1] >= len(total):
                    total = np.append(total, np.zeros(int(at[-1]) + 1 - len(total), np.int64))
                total[at] += np.frombuffer(counts.as_buffer(), np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([*(pa.array([k.as_py()], k.type) for k in key), pa.array([at.astype("<i4").tobytes()], pa.binary()),
                                          pa.array([total[at].tobytes()], pa.binary()), pa.array([int(total.sum())])],
                                         [*keys, "slots", "counts", "total"])
    return (parts.select(*keys, "slots", "counts").groupBy(*keys)
            .applyInArrow(add, ", ".join([*kept, "slots binary", "counts binary", "total long"])))


def shares(slots: bytes | None, counts: bytes | None, n: int, total: int, v: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, 1 + floor(SCALE * (count + ADDED) / (total + ADDED * v))) of ``n`` slots, in whole numbers below 2**53."""
    dense = np.zeros(n, np.int64)
    if slots:
        dense[np.frombuffer(slots, "<i4")] = np.frombuffer(counts, np.int64)
    whole = total + ADDED * v
    p, rest = np.divmod(dense + ADDED, whole)
    for _ in range(3):  # three decimal digits at a time
        digits, rest = np.divmod(rest * 1000, whole)
        p = p * 1000 + digits
    return dense, p + 1


def group_shares(groups: DataFrame, hashes: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per group and shard its shares as int32 by slot, and its terms used more than in the language (the TOP of a shard)."""
    per_lang = _added(counts, ["lang", "shard"])
    sizes = hashes.groupBy("lang").agg(F.sum("n").alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("total").alias("total"))
    lang_totals = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    known = (groups.join(totals, ["lang", "source"], "left").join(lang_totals, "lang", "left").join(sizes, "lang")
             .na.fill(0, ["total", "lang_total"]))
    rows = (known.join(hashes.select("lang", "shard", "n", "ends", "keys"), "lang")
            .join(counts.drop("total"), ["lang", "source", "shard"], "left")
            .join(per_lang.select("lang", "shard", F.col("slots").alias("lang_slots"), F.col("counts").alias("lang_counts")), ["lang", "shard"], "left")
            .select("lang", "source", "number", "shard", "n", "v", "total", "lang_total", "slots", "counts", "lang_slots", "lang_counts", "ends", "keys"))

    def step(batch: pa.RecordBatch):
        for r in range(batch.num_rows):
            lang, source, number, shard, n, v, total, lang_total, slots, counts, lang_slots, lang_counts, ends, keys = (c[r].as_py() for c in batch.columns)
            dense, p = shares(slots, counts, n, total, v)
            _, q = shares(lang_slots, lang_counts, n, lang_total, v)
            at = np.flatnonzero((dense > 0) & (p > q))
            value = p[at] - q[at]
            if len(at) > TOP:  # with all that tie with the last
                pick = value >= np.partition(value, len(value) - TOP)[len(value) - TOP]
                at, value = at[pick], value[pick]
            bounds = np.append(0, np.frombuffer(ends, np.int64))
            best = sorted((-int(x), keys[bounds[k]:bounds[k + 1]]) for k, x in zip(at.tolist(), value))[:TOP]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([source]), pa.array([number], pa.int64()), pa.array([shard]), pa.array([p.astype("<i4").tobytes()], pa.binary()),
                 pa.array([[{"item": k.decode(), "value": -x} for x, k in best]], pa.list_(pa.struct([("item", pa.string()), ("value", pa.int64())])))],
                ["lang", "source", "number", "shard", "shares", "best"])
    made = staged(arrow_map(rows, step, "lang string, source string, number long, shard long, shares binary, best array<struct<item:string,value:long>>"), "shares")
    return made.drop("best"), made.select("lang", "source", F.explode("best").alias("b")).select("lang", "source", "b.item", "b.value")


def source_distances(made: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, one, other, value): sums of absolute differences of shares of each two sources of a language, one < other.

    Sources are dealt to blocks; a task compares one block with another within one shard.
    """
    blocks = groups.groupBy("lang").agg((F.floor(F.max("number") / SOURCES) + 1).alias("blocks"))
    own = F.floor(F.col("number") / SOURCES)
    met = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = (made.join(blocks, "lang").withColumn("own", own).select("*", met.alias("met"))
             .select("lang", "shard", F.least("own", "met").alias("x"), F.greatest("own", "met").alias("y"), "own", "number", "shares"))

    def compare(table: pa.Table) -> pa.Table:
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        number, own = table.column("number").to_numpy(), table.column("own").to_numpy()
        p = np.stack([np.frombuffer(s.as_buffer(), "<i4") for s in table.column("shares")]).astype(np.int64)
        rows = [(a, b, int(np.abs(p[i] - p[j]).sum())) for i, a in enumerate(number.tolist()) if own[i] == x
                for j, b in enumerate(number.tolist()) if own[j] == y and a < b]
        one, other, value = zip(*rows) if rows else ((), (), ())
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(rows), pa.string()), "one": pa.array(one, pa.int64()),
                         "other": pa.array(other, pa.int64()), "value": pa.array(value, pa.int64())})
    return (dealt.groupBy("lang", "shard", "x", "y").applyInArrow(compare, "lang string, one long, other long, value long")
            .groupBy("lang", "one", "other").agg(F.sum("value").alias("value")))


def audit(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """lang, source, part, item, value, rank: how each source's use of kept terms differs from other sources and from its language.

    Null lang, source and text count as ''. Part ``pair`` ranks all other sources of the language by the sum of
    differences, 0 where it keeps no term; part ``term`` the TOP terms a source uses more than its language. Ties go by
    item in UTF-8 order. Repeated rows count as often as they occur; an empty table gives no rows. Texts are read
    whole; columns other than lang, source and text are left out. Hashes of about BROADCAST_BYTES are broadcast at a
    time: the driver sees one shard's worth after the other, and only their sizes beforehand.
    """
    spark = docs.sparkSession
    docs = _grouped(docs)
    kept = staged(kept_terms(docs, least), "kept")
    hashes = staged(perfect_hashes(kept), "hashes")
    sizes = hashes.select("lang", "shard", (F.octet_length("keys") + F.octet_length("ends") + F.octet_length("moves")).alias("bytes")).orderBy("lang", "shard").collect()
    shards = Counter(s["lang"] for s in sizes)
    rounds, held = [], BROADCAST_BYTES + 1
    for s in sizes:
        if held + s["bytes"] > BROADCAST_BYTES:
            rounds.append([])
            held = 0
        rounds[-1].append((s["lang"], s["shard"]))
        held += s["bytes"]
    counts = spark.createDataFrame([], "lang string, source string, shard long, slots binary, counts binary, total long")
    for some in rounds:
        wanted = spark.createDataFrame(some, "lang string, shard long")
        parts = recount(docs, hashes.join(F.broadcast(wanted), ["lang", "shard"]).collect(), dict(shards))
        counts = counts.union(staged(_added(_added(parts, ["lang", "source", "shard", "salt"]), ["lang", "source", "shard"]), "counts"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # one row per source
    groups = staged(docs.select("lang", "source").distinct().withColumn("number", number.cast("long")), "groups")
    made, best = group_shares(groups, hashes, counts)
    distances = source_distances(made, groups)
    both = distances.select("lang", "one", "other", "value").union(distances.select("lang", "other", "one", "value"))
    named = lambda c, name: groups.select("lang", F.col("number").alias(c), F.col("source").alias(name))
    pairs = (named("one", "source").join(named("other", "item"), "lang").filter("one != other")
             .join(both, ["lang", "one", "other"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).cast("long").alias("value")))

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        order: list[Column] = [F.desc("value"), F.asc("item")]
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
    return ranked(pairs, "pair").union(ranked(best, "term").filter(F.col("rank") <= TOP))
