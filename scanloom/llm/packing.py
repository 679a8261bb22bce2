"""Best-fit decreasing packing of tokenised documents with a segment tree over remaining capacities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import arrow_map, staged

CAPACITY = 4096
END_ID = 1
TOKENS_PER_BLOCK = 4096 * CAPACITY  # what one task packs; each block leaves about one open sequence
PIECES_PER_BLOCK = 1 << 19  # at most about so many pieces, however short
CACHED_WORDS, CACHED_BYTES = 1_500_000, 48

_loaded: dict[str, "WordEncoder"] = {}


class WordEncoder(dict):
    """Ids (little-endian uint32 bytes) of white-space separated words.

    The tokenizer drops white space and never joins across it, so a text's ids are its words' ids in a row.
    A special token's string in a text is that token, as in the library's own encoding of the text. Words are kept as
    they are. A worker keeps the encoder between tasks; it starts anew when full.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > CACHED_WORDS:
            self.clear()
            new = list(words)
        for at in range(0, len(new), 4096):
            some = new[at:at + 4096]
            found = self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
            for word, encoding in zip(some, found):
                self[word] = np.asarray(encoding.ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [(t or "").encode("utf-8", "replace").split() for t in texts]
        short = [[w for w in words if len(w) <= CACHED_BYTES] for words in split]
        self.learn(set().union(*short))
        long = {w for words, kept in zip(split, short) if len(kept) < len(words) for w in words if len(w) > CACHED_BYTES}
        own = {w: np.asarray(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes() for w in long}
        return [b"".join([self[w] for w in words]) if len(kept) == len(words)
                else b"".join([own[w] if len(w) > CACHED_BYTES else self[w] for w in words])
                for words, kept in zip(split, short)]


def encoder(path: str) -> WordEncoder:
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


def tokenised_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids): each document's ids and the end id, cut only beyond ``capacity``.

    ``ids`` holds little-endian uint32. A null or empty text is the end id alone. Other columns are not read.
    """
    def step(batch: pa.RecordBatch):
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for at in range(0, len(ids), 512):
            rows = []
            for doc, data in zip(ids[at:at + 512], encoder(tokenizer).encode(texts.slice(at, 512).to_pylist())):
                data += END_ID.to_bytes(4, "little")
                for piece, start in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[start:start + 4 * capacity]
                    rows.append((doc, piece, start // 4, len(part) // 4, part))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
                 pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.binary())],
                ["doc_id", "piece", "start", "length", "ids"])
    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), step,
                     "doc_id long, piece int, start long, length long, ids binary")


class CapacityTree:
    """Which remaining capacities have an open bin, as a segment tree; finds the tightest that fits."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, bin_id: int) -> None:
        if not self.bins[room]:
            at = room + self.leaves
            while at and not self.open[at]:
                self.open[at] = True
                at >>= 1
        self.bins[room].append(bin_id)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, bin) of the least room of at least ``need``, taken out of the tree."""
        at = need + self.leaves
        if not self.open[at]:
            while at > 1 and (at & 1 or not self.open[at ^ 1]):
                at >>= 1
            if at <= 1:
                return None
            at ^= 1
            while at < self.leaves:
                at = 2 * at if self.open[2 * at] else 2 * at + 1
        room = at - self.leaves
        found = self.bins[room].pop()
        if not self.bins[room]:
            self.open[at] = False
            while at > 1 and not self.open[at ^ 1]:
                at >>= 1
                self.open[at] = False
        return room, found


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; the longest go first, each into the tightest open bin."""
    tree, n_bins = CapacityTree(capacity), 0
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        room, at = tree.take(need) or (capacity, n_bins)
        n_bins += at == n_bins
        bins[i], offsets[i] = at, capacity - room
        if room > need:
            tree.put(room - need, at)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, tokens_per_block: int = TOKENS_PER_BLOCK) -> DataFrame:
    """``pieces`` (any columns, ``length`` of 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    Rows are dealt at random into blocks of about ``tokens_per_block`` tokens, and of PIECES_PER_BLOCK rows at most,
    whatever their keys, so no block grows with the table; each block is packed best-fit decreasing. Blocks close with one open sequence each
    (one in 4096 at the default). An empty table gives an empty result; ties are broken within the block.
    """
    dealt = staged(pieces.drop("sequence_id", "offset").withColumn("__deal", F.rand(29)), "pieces")
    total, rows = dealt.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    blocks = max(1, round(total / tokens_per_block), -(-rows // PIECES_PER_BLOCK))
    dealt = dealt.withColumn("__block", F.floor(F.col("__deal") * blocks).cast("long")).drop("__deal")
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]

    def run(table: pa.Table) -> pa.Table:
        block = table.column("__block")[0].as_py()
        bins, offsets = best_fit_decreasing(table.column("length").to_numpy(), capacity)
        return (table.select(names).append_column("sequence_id", pa.array(bins + (block << 32)))
                .append_column("offset", pa.array(offsets)))

    schema = dealt.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return dealt.groupBy("__block").applyInArrow(run, schema)
