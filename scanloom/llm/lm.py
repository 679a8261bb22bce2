"""Interpolated modified Kneser-Ney bigrams: counted in Spark, kept as sorted hash arrays that workers map into memory."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import arrow_map, shared_folder, staged
from scanloom.llm.repeats import mixed
from scanloom.llm.substring import word_hashes

BEGIN, END = np.uint64(0x6265_6769_6E00_0001), np.uint64(0x656E_6400_0000_0002)
FLUSH = 1 << 20  # tokens combined before the shuffle
SHARD_BYTES, FEWEST_SHARDS = 1 << 24, 8  # text whose pairs make one shard
SALT = 8  # shards a context's followers are spread over, so no context lies in one task
ESCAPE = 255  # counts are bytes; larger ones follow in a list of their own


def tokens_of(text: str | None) -> np.ndarray:
    return word_hashes((text or "").encode("utf-8", "replace").lower().split())


def pair_hash(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return mixed(one * np.uint64(0x9E3779B97F4A7C15) + two)


def shard_of(one: np.ndarray, two: np.ndarray, shards: int) -> np.ndarray:
    return ((mixed(one ^ np.uint64(7)) >> np.uint64(8)) + (mixed(two) >> np.uint64(8)) % np.uint64(SALT)) % np.uint64(shards)


def word_shard(words: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(words ^ np.uint64(99)) >> np.uint64(8)) % np.uint64(shards)


def _combined(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a row of each key, in key order; the keys; their summed counts)."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return order[first], keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def _dump(*arrays: np.ndarray) -> bytes:
    return np.array([a.nbytes for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


def _load(blob, *kinds) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, np.int64, len(kinds))
    ends = 8 * len(kinds) + np.cumsum(sizes)
    return [np.frombuffer(blob, kind, int(n) // np.dtype(kind).itemsize, int(end - n)) for kind, n, end in zip(kinds, sizes, ends)]


def _small(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(counts, ESCAPE).astype(np.uint8), counts[counts >= ESCAPE].astype(np.uint64)


def _whole(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    counts = small.astype(np.int64)
    counts[small == ESCAPE] = large
    return counts


def _count_pairs(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, blob): the pairs of a flush with their counts, first words written once, one blob for each shard."""
    def flush(texts: list[np.ndarray]) -> pa.RecordBatch:
        one = np.concatenate([x for t in texts for x in ([BEGIN], t)]).astype(np.uint64)
        two = np.concatenate([x for t in texts for x in (t, [END])]).astype(np.uint64)
        rows, _, counts = _combined(pair_hash(one, two), np.ones(len(one), np.int64))
        one, two = one[rows], two[rows]
        shard = shard_of(one, two, shards).astype(np.int64)
        order = np.lexsort((one, shard))
        one, two, counts, shard = one[order], two[order], counts[order], shard[order]
        edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        blobs = []
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(shard)]):
            starts = np.flatnonzero(np.concatenate([[True], one[a + 1:b] != one[a:b - 1]]))
            lengths = np.diff(np.append(starts, b - a)).astype(np.uint32)
            blobs.append(_dump(one[a:b][starts], lengths, two[a:b], *_small(counts[a:b])))
        return pa.RecordBatch.from_arrays([pa.array(shard[edges], pa.int64()), pa.array(blobs, pa.binary())], ["shard", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for text in batch.column("text"):
                held.append(tokens_of(text.as_py()))
                size += len(held[-1]) + 1
                if size >= FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)
    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "shard long, blob binary")


def _write(folder: str, name: str, data: bytes) -> str:
    """A file of its own for every attempt; the row that names it decides which one counts."""
    from pyarrow.fs import FileSystem

    system, path = FileSystem.from_uri(folder)
    path = f"{path}/{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(path) as out:
        out.write(data)
    return f"{folder}/{path.rsplit('/', 1)[1]}"


def mapped(uri: str, *kinds) -> list[np.ndarray]:
    """Arrays of a model file, mapped into memory; a file in a remote store is copied to the worker's disk first."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    system, path = FileSystem.from_uri(uri)
    if not isinstance(system, LocalFileSystem):
        local = os.path.join(tempfile.gettempdir(), path.rsplit("/", 1)[1])
        if not os.path.exists(local):
            with system.open_input_stream(path) as source, open(f"{local}.{os.getpid()}", "wb") as out:
                shutil.copyfileobj(source, out)
            os.replace(f"{local}.{os.getpid()}", local)
        path = local
    return _load(np.memmap(path, np.uint8, "r"), *kinds)


PAIR_KINDS = (np.uint64, np.uint8, np.uint64)  # pair hash, count, large counts
WORD_KINDS = (np.uint64, np.uint64, np.uint32, np.uint32, np.uint32, np.uint32)  # hash, count, followers seen 1, 2, 3+ times, distinct predecessors


def _merge_pairs(table: pa.Table, folder: str, word_shards: int) -> pa.Table:
    """Writes the shard's pairs, sorted by hash; passes on its pair statistics and what its words gain, by word shard."""
    parts = []
    for blob in table.column("blob"):
        first, lengths, two, small, large = _load(blob.as_buffer(), np.uint64, np.uint32, np.uint64, np.uint8, np.uint64)
        parts.append((np.repeat(first, lengths), two, _whole(small, large)))
    one, two, counts = (np.concatenate([p[k] for p in parts]) for k in range(3))
    rows, hashes, counts = _combined(pair_hash(one, two), counts)
    one, two = one[rows], two[rows]
    shard = table.column("shard")[0].as_py()
    path = _write(folder, f"pairs-{shard}", _dump(hashes, *_small(counts)))
    head = {"kind": "pairs", "shard": shard, "path": path, "stats": [int((counts == k).sum()) for k in (1, 2, 3, 4)] + [len(counts), 0]}
    context, at = np.unique(one, return_inverse=True)
    total = np.bincount(at, counts).astype(np.uint64)
    seen = [np.bincount(at[pick], minlength=len(context)).astype(np.uint32) for pick in (counts == 1, counts == 2, counts > 2)]
    follower, before = np.unique(two, return_counts=True)
    rows = [head]
    of_context, of_follower = word_shard(context, word_shards), word_shard(follower, word_shards)
    for w in np.unique(np.concatenate([of_context, of_follower])).tolist():
        a, b = of_context == w, of_follower == w
        rows.append({"kind": "words", "shard": w, "stats": [], "blob": _dump(context[a], total[a], *(s[a] for s in seen), follower[b], before[b].astype(np.uint32))})
    return pa.Table.from_pylist(rows, ROWS)


ROWS = pa.schema([("kind", pa.string()), ("shard", pa.int64()), ("path", pa.string()), ("stats", pa.list_(pa.int64())), ("blob", pa.binary())])
ROWS_SQL = "kind string, shard long, path string, stats array<long>, blob binary"


def _merge_words(table: pa.Table, folder: str) -> pa.Table:
    words, sums, who, before = [], [], [], []
    for blob in table.column("blob"):
        context, total, s1, s2, s3, follower, n = _load(blob.as_buffer(), np.uint64, np.uint64, np.uint32, np.uint32, np.uint32, np.uint64, np.uint32)
        words.append(context)
        sums.append(np.stack([total.astype(np.int64), s1, s2, s3]))
        who.append(follower)
        before.append(n)
    words, sums, who, before = np.concatenate(words), np.concatenate(sums, 1), np.concatenate(who), np.concatenate(before)
    keys, at = np.unique(np.concatenate([words, who]), return_inverse=True)
    columns = [np.bincount(at[:len(words)], row, len(keys)).astype(np.int64) for row in sums]
    distinct = np.bincount(at[len(words):], before, len(keys)).astype(np.int64)
    shard = table.column("shard")[0].as_py()
    path = _write(folder, f"words-{shard}", _dump(keys, columns[0].astype(np.uint64), *(c.astype(np.uint32) for c in columns[1:]), distinct.astype(np.uint32)))
    begin = keys == BEGIN
    stats = [int((distinct == k).sum()) for k in (1, 2, 3, 4)] + [int((distinct > 0).sum()), int(columns[0][~begin].sum()), int(columns[0][begin].sum()), int((distinct > 2).sum())]
    return pa.Table.from_pylist([{"kind": "words", "shard": shard, "path": path, "stats": stats}], ROWS)


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Of counts 0, 1, 2 and 3 or more; in a corpus too small for the estimate, as far as it goes."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    estimate = [k - (k + 1) * y * b / a if a else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([0.0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate(estimate, 1))])


@dataclass
class Model:
    """Where the shards' files are, and the totals. It holds no n-gram itself."""

    pairs: dict[int, str]
    words: dict[int, str]
    pair_shards: int
    word_shards: int
    pair_discounts: np.ndarray
    word_discounts: np.ndarray
    tokens: int  # of the training texts, ends included
    vocabulary: int  # distinct tokens
    types: int  # distinct pairs
    rest: float  # mass the unigram level leaves to unknown tokens
    ends: int  # training texts


def train(docs: DataFrame) -> Model:
    """Counts of all rows of ``docs`` (column text; null is empty): pairs are combined in each task, merged by shard,
    and written as sorted arrays to the shared folder; word statistics are summed from the shards the same way. The number
    of shards follows the size of the texts, so a shard stays as large as it is when the corpus grows."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("n")).first()["n"]
    shards = max(FEWEST_SHARDS, -(-(size or 0) // SHARD_BYTES))
    word_shards = max(4, shards // 4)
    folder = shared_folder(spark, "lm")
    from pyarrow.fs import FileSystem  # the folder is made once, by the driver
    if "://" not in folder:
        folder = f"file://{folder}" if not folder.startswith("file:") else folder.replace("file:", "file://", 1)
    system, path = FileSystem.from_uri(folder)
    system.create_dir(path)
    merged = staged(_count_pairs(docs, shards).groupBy("shard").applyInArrow(lambda t: _merge_pairs(t, folder, word_shards), ROWS_SQL), "pairs")
    summed = staged(merged.filter("kind = 'words'").groupBy("shard").applyInArrow(lambda t: _merge_words(t, folder), ROWS_SQL), "words")
    pairs = merged.filter("kind = 'pairs'").select("shard", "path", "stats").collect()
    words = summed.select("shard", "path", "stats").collect()
    n = np.sum([r["stats"] for r in pairs], 0).tolist() if pairs else [0] * 6
    m = np.sum([r["stats"] for r in words], 0).tolist() if words else [0] * 8
    lower = discounts(*m[:4])
    rest = float(lower[1] * m[0] + lower[2] * m[1] + lower[3] * m[7]) / n[4] if n[4] else 1.0
    return Model({r["shard"]: r["path"] for r in pairs}, {r["shard"]: r["path"] for r in words}, shards, word_shards, discounts(*n[:4]),
                 lower, m[5] + m[6], m[4], n[4], rest, m[6])


class Lookup:
    """A worker's view of the model: files are mapped when first asked for."""

    def __init__(self, model: Model):
        self.model, self.files = model, {}

    def _file(self, kind: str, shard: int) -> list[np.ndarray] | None:
        if (kind, shard) not in self.files:
            path = getattr(self.model, kind).get(shard)
            arrays = path and mapped(path, *(PAIR_KINDS if kind == "pairs" else WORD_KINDS))
            if path and kind == "pairs":
                arrays.append(np.flatnonzero(arrays[1] == ESCAPE))
            self.files[kind, shard] = arrays
        return self.files[kind, shard]

    def _find(self, kind: str, keys: np.ndarray, shard: np.ndarray, columns: int) -> np.ndarray:
        """The rows' columns for sorted look-ups in each shard; zeros where a key is not there."""
        out = np.zeros((columns, len(keys)), np.int64)
        order = np.lexsort((keys, shard))
        ranked = shard[order]
        edges = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(order) else []
        for a, b in zip(edges, [*edges[1:], len(order)]):
            arrays = self._file(kind, int(ranked[a]))
            if arrays is None or not len(arrays[0]):
                continue
            rows = order[a:b]
            at = np.searchsorted(arrays[0], keys[rows])
            at[at == len(arrays[0])] = 0
            there = arrays[0][at] == keys[rows]
            if kind == "pairs":
                counts = arrays[1][at].astype(np.int64)
                large = np.flatnonzero(there & (counts == ESCAPE))
                counts[large] = arrays[2][np.searchsorted(arrays[3], at[large])]
                out[0, rows] = np.where(there, counts, 0)
            else:
                for c in range(columns):
                    out[c, rows] = np.where(there, arrays[c + 1][at].astype(np.int64), 0)
        return out

    def score(self, texts: list[np.ndarray]) -> dict[str, np.ndarray]:
        """Per text: tokens, known tokens, the base score and the model's log10 probability."""
        m = self.model
        sizes = np.array([len(t) + 1 for t in texts])
        two = np.concatenate([x for t in texts for x in (t, [END])]).astype(np.uint64)
        one = np.concatenate([[BEGIN], two[:-1]]).astype(np.uint64)
        one[np.cumsum(sizes)[:-1]] = BEGIN
        words, at = np.unique(np.concatenate([one, two]), return_inverse=True)
        count, f1, f2, f3, before = self._find("words", words, word_shard(words, m.word_shards), 5)
        d, e = m.pair_discounts, m.word_discounts
        low = np.maximum(before - e[np.minimum(before, 3)], 0) / max(m.types, 1) + m.rest / (m.vocabulary + 1)
        back = np.where(count > 0, (d[1] * f1 + d[2] * f2 + d[3] * f3) / np.maximum(count, 1), 1.0)
        i, j = at[:len(one)], at[len(one):]
        pairs, own = np.unique(i * len(words) + j, return_inverse=True)
        a, b = words[pairs // len(words)], words[pairs % len(words)]
        c = self._find("pairs", pair_hash(a, b), shard_of(a, b, m.pair_shards).astype(np.int64), 1)[0]
        first = pairs // len(words)
        p = np.maximum(c - d[np.minimum(c, 3)], 0) / np.maximum(count[first], 1) + back[first] * low[pairs % len(words)]
        tokens = np.where(words == END, m.ends, np.where(words == BEGIN, 0, count))
        base = np.log10((tokens + 0.1) / (m.tokens + 0.1 * (m.vocabulary + 1)))
        starts = np.cumsum(sizes) - sizes
        return {"n_tokens": sizes, "n_known": np.add.reduceat((tokens > 0)[j].astype(np.int64), starts),
                "base_score": np.add.reduceat(base[j], starts), "score": np.add.reduceat(np.log10(p)[own], starts)}


_lookups: dict[str, Lookup] = {}


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of every row with n_tokens, n_known, base_score, score (log10) and perplexity per token."""
    made = ["n_tokens", "n_known", "base_score", "score", "perplexity"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    key = uuid.uuid4().hex

    def step(batch: pa.RecordBatch):
        if key not in _lookups:
            _lookups.clear()
            _lookups[key] = Lookup(model)
        start, held, size = 0, [], 0
        texts = batch.column("__text")
        for row in range(batch.num_rows):
            held.append(tokens_of(texts[row].as_py()))
            size += len(held[-1])
            if size >= 1 << 19 or row == batch.num_rows - 1:
                part = batch.slice(start, len(held))
                found = _lookups[key].score(held)
                found["perplexity"] = 10 ** (-found["score"] / found["n_tokens"])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(found[c]) for c in made)], [*keep, *made])
                start, held, size = row + 1, [], 0
    read = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    extra = [F.lit(0).cast("long").alias(c) for c in made[:2]] + [F.lit(0.0).alias(c) for c in made[2:]]
    return arrow_map(read, step, read.select(*keep, *extra).schema)
