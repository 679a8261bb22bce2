"""Repeated windows across documents: anchored runs, decided by content, settled exactly in their buckets.

A window is ``width`` consecutive symbols (bytes or words). Each window is led by its anchor: of the ``anchor``-symbol
grams inside, the one of the least hash, leftmost on ties. Consecutive windows led by the same occurrence form a run.
Equal windows have equal anchors at equal offsets, so they meet in the anchor's bucket. Within one run all windows
differ. Runs of equal content are equal window by window, hence only the first of each content takes part in the exact
step, and only where its anchor leads runs of other content too.

An anchor is short, so in a large corpus most runs of one anchor share nothing but it. A run is therefore halved: windows
with more than half of their other symbols before the anchor, and the rest. All windows of a half hold the same core, the
anchor with the symbols before it or after it. Equal windows have equal cores, so halves alone with theirs are done, and
the others meet by anchor and core.

Identity of content is a 64-bit anchor hash and a 64-bit hash of the whole run, compared within one anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.common import arrow_map, by_groups, doc_key, staged, text_tag

BASE = 0x9E3779B97F4A7C15
TILE = 1 << 17  # symbols hashed at a time
FLUSH = 1 << 22  # symbols whose equal runs are combined before the shuffle
BUCKET_ROWS = 1024  # runs of one core beyond which its windows travel singly, dealt by content
BLOCK_BYTES = 1 << 22  # packed bytes settled at a time


@dataclass(frozen=True)
class Unit:
    """What a symbol is: how texts split into symbols, hash, and join; and the exact step on packed runs."""

    width: int
    anchor: int
    split: Callable[[str | None], Any]
    hashes: Callable[[Any], np.ndarray]
    join: Callable[[Any], bytes]
    repeated: Callable[[list[bytes], int], np.ndarray]  # flags of all windows, in order
    block: int = 1 << 22  # packed bytes settled at a time, at most


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))])
                 for b in (BASE, pow(BASE, -1, 1 << 64)))


class Spans:
    """Hashes of any stretch of a sequence of 64-bit symbols, by prefix sums of a polynomial."""

    def __init__(self, values: np.ndarray):
        size = 1 << max(10, len(values)).bit_length()
        up, self.down = _powers(size)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:len(values)], out=self.sums[1:])

    def hashed(self, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])


def leaders(grams: np.ndarray, span: int) -> np.ndarray:
    """Position of the leftmost least of ``grams[i:i + span]`` for each i."""
    best, at, done = grams, np.arange(len(grams), dtype=np.int32), 1
    while done < span:
        move = min(done, span - done)
        later = best[move:] < best[:-move]
        at = np.where(later, at[move:], at[:-move])
        best = np.minimum(best[move:], best[:-move])
        done += move
    return at


def runs_of(values: np.ndarray, sizes: np.ndarray, width: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(start, windows, anchor hash, content hash, cores) of the runs of consecutive stretches of ``sizes`` symbols.

    ``cores`` is one number: 28 bits of the hash of the first half's core, 28 of the second's, 8 bits windows of the first.
    """
    if len(values) < width:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    spans, n = Spans(values), len(values)
    grams = spans.hashed(slice(0, n - anchor + 1), slice(anchor, n + 1))
    lead = leaders(grams, width - anchor + 1)
    fits = np.repeat(np.cumsum(sizes), sizes)[:len(lead)] - np.arange(len(lead)) >= width
    new = np.concatenate([[True], lead[1:] != lead[:-1]])
    starts = np.flatnonzero(fits & (new | np.concatenate([[True], ~fits[:-1]])))
    ends = np.flatnonzero(fits & np.concatenate([new[1:] | ~fits[1:], [True]]))
    at, windows, half = lead[starts].astype(np.int64), ends - starts + 1, (width - anchor) // 2
    first = np.clip(at - half - starts, 0, windows)  # the others start at most half a window's other symbols before the anchor
    one = np.where(first > 0, spans.hashed(np.maximum(at - half - 1, 0), at + anchor), np.uint64(0))
    two = np.where(first < windows, spans.hashed(at, np.minimum(at - half + width, n)), np.uint64(0))
    cores = (one >> np.uint64(36) << np.uint64(36)) | (two >> np.uint64(36) << np.uint64(8)) | first.astype(np.uint64)
    return starts, windows, grams[at], spans.hashed(starts, ends + width), cores


def place(tag: np.ndarray | int, start: np.ndarray, windows: np.ndarray | int) -> np.ndarray:
    """One ordered number: 23 bits tag, 32 bits start, 8 bits number of windows."""
    return (np.asarray(tag, np.int64) << 40) | (np.asarray(start, np.int64) << 8) | np.asarray(windows, np.int64)


def merged(keys: np.ndarray, places: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs in document order as (key, tag and start, end) of the stretches they cover together."""
    starts, doc = (places >> 8) & 0xFFFFFFFF, places >> 40
    ends = starts + (places & 0xFF) + width - 1
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1]) | (starts[1:] > ends[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(keys) - 1]]) if len(first) else first
    return keys[first], places[first] & ~np.int64(0xFF), ends[last]


ROWS = "anchor long, content long, key long, place long, end long, cores long"


def _rows(anchor, content, keys, places, ends, cores) -> pa.RecordBatch:
    cols = [np.asarray(c).view(np.int64) for c in (anchor, content, keys, places, ends, cores)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["anchor", "content", "key", "place", "end", "cores"])


def _find_runs(docs: DataFrame, unit: Unit) -> DataFrame:
    """Runs (end 0), one of each content per flush; later ones of the flush come out as covered stretches (end > 0)."""
    width = unit.width

    def flush(tiles: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not tiles:
            return
        keys, places, anchors, contents, cores = (np.concatenate(c) for c in zip(*tiles))
        order = np.argsort(anchors * np.uint64(3) + contents, kind="stable")  # rows are in document order, ties keep it
        twice = np.zeros(len(order), bool)  # the same run of a repeated row
        twice[1:] = ((anchors[order[1:]] == anchors[order[:-1]]) & (keys[order[1:]] == keys[order[:-1]])
                     & (places[order[1:]] == places[order[:-1]]))
        order = order[~twice]
        again = np.zeros(len(order), bool)
        a, c = anchors[order], contents[order]
        again[1:] = (a[1:] == a[:-1]) & (c[1:] == c[:-1])
        covered = np.sort(order[again])
        fresh = order[~again]
        yield _rows(anchors[fresh], contents[fresh], keys[fresh], places[fresh], np.zeros(len(fresh), np.int64), cores[fresh])
        if len(covered):
            keys, places, ends = merged(keys[covered], places[covered], width)
            spread = mixed(places.view(np.uint64) + keys.view(np.uint64))
            yield _rows(spread, spread, keys, places, ends, np.zeros(len(keys), np.int64))

    def step(batch: pa.RecordBatch):
        keys, tags = (batch.column(c).to_numpy() for c in ("key", "tag"))
        texts, tiles, held = batch.column("__text"), [], 0
        stack: list[tuple] = []  # (key, tag, start, hashes) waiting for a full tile

        def hashed() -> None:
            sizes = np.array([len(s[3]) for s in stack])
            starts, windows, anchors, contents, cores = runs_of(np.concatenate([s[3] for s in stack]), sizes, width, unit.anchor)
            before = np.cumsum(sizes) - sizes
            own = np.searchsorted(before, starts, side="right") - 1
            doc = np.array([(s[0], s[1], s[2]) for s in stack], np.int64)[own]
            tiles.append((doc[:, 0], place(doc[:, 1], doc[:, 2] + starts - before[own], windows), anchors, contents, cores))
            stack.clear()

        waiting = 0
        for row in np.lexsort((tags, keys)).tolist():
            values = unit.hashes(unit.split(texts[row].as_py()))
            for at in range(0, max(0, len(values) - width) + 1, TILE):
                part = values[at:at + TILE + width - 1]
                if len(part) < width:
                    continue
                stack.append((keys[row], tags[row], at, part))
                waiting += len(part)
                if waiting >= TILE:
                    hashed()
                    held, waiting = held + waiting, 0
            if held >= FLUSH:
                yield from flush(tiles)
                tiles, held = [], 0
        if stack:
            hashed()
        yield from flush(tiles)
    return arrow_map(docs.select("key", "tag", "__text"), step, ROWS)


def _decided(runs: DataFrame) -> DataFrame:
    """Covered stretches (end > 0) and, of the runs left, the halves to settle (end 0), with their core (29 bits) and the
    number of runs left that have it. Only an anchor with several contents, and then a core with several, needs settling."""
    first = Window.partitionBy("anchor").orderBy("content", "key", "place")
    before = lambda c: F.lag(c).over(first) == F.col(c)
    covered = F.col("end") > 0
    once = runs.withColumn("twice", before("content") & before("key") & before("place")).filter(F.col("twice").isNull() | ~F.col("twice"))
    done = covered | F.col("again")
    several = (once.withColumn("again", F.coalesce(before("content"), F.lit(False)) & ~covered)
               .withColumn("contents", F.sum(F.when(done, 0).otherwise(1)).over(Window.partitionBy("anchor")))
               .filter(done | (F.col("contents") > 1)))
    windows, first = F.col("place").bitwiseAND(F.lit(0xFF)), F.col("cores").bitwiseAND(F.lit(0xFF))
    halves = F.array(
        F.struct((F.col("place") - windows + first).alias("place"), F.shiftrightunsigned("cores", 36).alias("core"), first.alias("n")),
        F.struct((F.col("place") + F.shiftleft(first, 8) - first).alias("place"),
                 F.shiftrightunsigned("cores", 8).bitwiseAND(F.lit((1 << 28) - 1)).bitwiseOR(F.lit(1 << 28)).alias("core"), (windows - first).alias("n")))
    whole = F.array(F.struct("place", F.lit(-1).cast("long").alias("core"), F.lit(1).cast("long").alias("n")))
    return (several.withColumn("half", F.explode(F.when(done, whole).otherwise(halves))).filter("half.n > 0")
            .select("anchor", "key", F.col("half.place").alias("place"), "end", "again", F.col("half.core").alias("core"))
            .withColumn("contents", F.count("*").over(Window.partitionBy("anchor", "core")))
            .filter((F.col("core") < 0) | (F.col("contents") > 1)))


def _packed(docs: DataFrame, runs: DataFrame, unit: Unit) -> DataFrame:
    """The halves as packed strings, dealt by anchor and core. Of cores with many contents each window travels singly, dealt
    by its content too; equal ones of a batch are combined (the later come out with an empty string)."""
    width = unit.width
    by_doc = (runs.withColumn("tag", F.shiftright("place", 40)).groupBy("key", "tag")
              .agg(F.sort_array(F.collect_list(F.struct("place", "anchor", "core", "contents"))).alias("__runs")))
    rows = docs.select("key", "tag", "__text").join(by_doc, ["key", "tag"])

    def step(batch: pa.RecordBatch):
        keys, tags = batch.column("key").to_pylist(), batch.column("tag").to_pylist()
        texts, lists = batch.column("__text"), batch.column("__runs")
        seen: dict[tuple[int, bytes], tuple] = {}
        out: list[tuple] = []
        size = 0
        for row in sorted(range(len(keys)), key=lambda r: (keys[r], tags[r])):
            symbols, inner = unit.split(texts[row].as_py()), lists[row].values
            for spot, anchor, core, contents in zip(*(inner.field(f).to_pylist() for f in ("place", "anchor", "core", "contents"))):
                start, windows = (spot >> 8) & 0xFFFFFFFF, spot & 0xFF
                parts = contents // BUCKET_ROWS + 1
                if parts == 1:
                    out.append((anchor, core, keys[row], spot, unit.join(symbols[start:start + windows + width - 1])))
                    size += len(out[-1][4])
                    continue
                for at in range(start, start + windows):
                    window = unit.join(symbols[at:at + width])
                    own = int(place(tags[row], at, 1))
                    fresh = seen.setdefault((anchor, window), (keys[row], own)) == (keys[row], own)
                    deal = xxhash.xxh64_intdigest(window if fresh else own.to_bytes(8, "little")) % (parts * 32)
                    out.append((anchor, core | deal << 29, keys[row], own, window if fresh else b""))
                    size += len(window) * fresh
            if size > BLOCK_BYTES:
                yield _strings(out)
                out, size, seen = [], 0, {}
        if out:
            yield _strings(out)
    return arrow_map(rows, step, "anchor long, part long, key long, place long, string binary")


def _strings(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())],
                                      ["anchor", "part", "key", "place", "string"])


def _settled(packed: DataFrame, unit: Unit) -> DataFrame:
    """(key, place, end): stretches whose windows start earlier too, found bucket by bucket, many buckets at a time."""
    width = unit.width

    def settle(table: pa.Table) -> pa.RecordBatch:
        keys, places, anchors, parts = (table.column(c).to_numpy() for c in ("key", "place", "anchor", "part"))
        sizes = pc.binary_length(table.column("string")).to_numpy()
        new = np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (parts[1:] != parts[:-1])])
        block = np.maximum.accumulate(np.where(new, (np.cumsum(sizes) - sizes) // unit.block, 0))  # groups stay whole
        order = np.lexsort((places, keys, block))
        again = (keys[order[1:]] == keys[order[:-1]]) & (places[order[1:]] == places[order[:-1]])
        order = order[np.concatenate([[True], ~again])]  # a repeated row brings its runs twice
        strings = table.column("string").to_pylist()
        keys, places, strings = keys[order], places[order], [strings[i] for i in order.tolist()]
        empty = np.array([not s for s in strings], bool)
        real = np.flatnonzero(~empty)
        block = block[order[real]]
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(real)]
        flags = np.concatenate([unit.repeated([strings[i] for i in real[a:b].tolist()], width) for a, b in zip(cuts, cuts[1:])])
        windows = places[real] & 0xFF
        owner = np.repeat(real, windows)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        hit, whole = np.flatnonzero(flags), np.flatnonzero(empty)
        found_keys = np.concatenate([keys[owner[hit]], keys[whole]])
        found = np.concatenate([(places[owner[hit]] & ~np.int64(0xFF)) + (offset[hit] << 8) + 1, places[whole]])
        order = np.lexsort((found, found_keys))
        got = merged(found_keys[order], found[order], width)
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in got], ["key", "place", "end"])

    keys = ["anchor", "part"]
    return by_groups(packed.repartition(*keys).sortWithinPartitions(*keys), keys, settle, "key long, place long, end long", min(BLOCK_BYTES, unit.block))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with its order (``key``, ``tag``) and text without null under internal names."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("__text", text).withColumns({"__key": doc_key(), "__tag": text_tag("__text")})


def repeated_stretches(docs: DataFrame, unit: Unit) -> DataFrame:
    """(key, tag, spans): per document with any, the stretches of symbols covered by windows that start earlier.

    Earlier is a smaller id, or an earlier start in the same document. Rows equal in id and text are one document;
    rows of one id with different texts are ordered by a hash of the text; a null id is the smallest.
    """
    ids = keyed(docs).select(F.col("__key").alias("key"), F.col("__tag").alias("tag"), "__text")
    decided = staged(_decided(_find_runs(ids, unit)), "runs")
    waiting = decided.filter((F.col("end") == 0) & ~F.col("again"))
    settled = staged(_settled(_packed(ids, waiting, unit), unit), "settled")
    start = F.shiftright("place", 8).bitwiseAND(F.lit(0xFFFFFFFF))
    end = F.when(F.col("again"), start + F.col("place").bitwiseAND(F.lit(0xFF)) + unit.width - 1).otherwise(F.col("end"))
    covered = decided.filter((F.col("end") > 0) | F.col("again")).select("key", "place", end.alias("end"))
    return (covered.unionByName(settled)
            .select("key", F.shiftright("place", 40).alias("tag"), F.struct(start.alias("start"), F.col("end")).alias("span"))
            .groupBy("key", "tag").agg(F.collect_list("span").alias("spans")))


def without_repeats(docs: DataFrame, unit: Unit, keep: list[str], result: Callable[[Any, np.ndarray], list], schema: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """Columns ``keep`` of every row with ``result(symbols, mask of removed symbols)`` as the columns of ``schema``."""
    names = [n for n, _, _ in schema]
    keep = [c for c in keep if c not in names]
    spans = repeated_stretches(docs, unit)
    read = (keyed(docs).select(*keep, "__key", "__tag", "__text")
            .join(spans.select(F.col("key").alias("__key"), F.col("tag").alias("__tag"), F.col("spans").alias("__spans")),
                  ["__key", "__tag"], "left").select(*keep, "__text", "__spans"))

    def step(batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = []
            for text, spans in zip(part.column("__text").to_pylist(), part.column("__spans")):
                symbols = unit.split(text)
                edges = np.zeros(len(symbols) + 1, np.int64)
                if spans.is_valid:
                    inner = spans.values
                    np.add.at(edges, inner.field("start").to_numpy(), 1)
                    np.add.at(edges, inner.field("end").to_numpy(), -1)
                rows.append(result(symbols, np.cumsum(edges[:-1]) > 0))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in keep), *(pa.array(c, kind) for c, (_, kind, _) in zip(zip(*rows), schema))], [*keep, *names])
    made = [F.lit(None).cast(sql).alias(n) for n, _, sql in schema]
    return arrow_map(read, step, read.select(*keep, *made).schema)
