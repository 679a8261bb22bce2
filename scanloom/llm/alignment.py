"""Cross-tokenizer alignment by pointer jumping, with corpus-wide counts of linked id pairs.

Both tokenizers cut the same bytes. Every token points to the farthest-right token that overlaps it; following the
pointers, doubled at each step, every token of a connected run arrives at the run's last token, which labels the group.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import arrow_map, staged

BLOCK_LINKS = 1 << 17  # links of a block of documents; a document with more is a block of its own
BATCH_CHARS = 1 << 20  # texts encoded at a time; a longer text is encoded by itself
SPACE = "▁"
CUT = re.compile("(?<=[!-~À-ɏ]) (?=[!-~À-ɏ])")  # a space where both tokenizers always begin a token
CACHED, CACHED_CHARS = 400_000, 6_000_000  # parts that a worker remembers and their length; it starts anew when full

_loaded: dict[tuple[str, str], "Tokenizers"] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable character that a byte-level vocabulary writes for each byte: itself, or the next one from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class Tokenizers:
    """Tokenizer A (byte-level BPE, tokenizers JSON) and B (sentencepiece), with the bytes of every token."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        size = self.a.get_vocab_size()
        self.a_bytes = [bytes(alphabet[c] for c in t) if (t := self.a.id_to_token(i)) and all(c in alphabet for c in t) else (t or "").encode() for i in range(size)]
        self.b_bytes = [self._piece(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.fromiter(map(len, t), np.int64, len(t)) for t in (self.a_bytes, self.b_bytes))
        ids = np.arange(max(size, len(self.b_bytes))).astype("S6")
        self.written = {c: np.char.add(c, ids) for c in (b",", b"|", b";")}
        self._forget()
        # B never joins across such a space unless a piece holds one after something else
        self.apart = not any(re.search(f"[^{SPACE}]{SPACE}", self.b.id_to_piece(i)) for i in range(len(self.b_bytes)))

    @staticmethod
    def _piece(piece: str) -> bytes:
        if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
            return bytes([int(piece[3:5], 16)])
        return piece.replace(SPACE, " ").encode()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # part -> row of the columns
        self.chars, self.a_ids, self.b_ids = 0, np.empty(0, np.int32), np.empty(0, np.int32)
        self.a_at, self.b_at, self.same = np.zeros(1, np.int64), np.zeros(1, np.int64), np.empty(0, bool)

    def _learn(self, parts: list[str]) -> None:
        """Enter new parts: their ids by A and B, and whether the tokens are the bytes of a space and the part."""
        for at in range(0, len(parts), 4096):
            some = parts[at:at + 4096]
            found = ([e.ids for e in self.a.encode_batch_fast([" " + p for p in some], add_special_tokens=False)], self.b.encode(some, num_threads=1))
            whole = [b" " + p.encode("utf-8", "replace") for p in some]
            same, ids, ends = np.ones(len(some), bool), [], []
            sizes = np.cumsum(np.fromiter(map(len, whole), np.int64, len(whole)))
            for own, written, size in zip(found, (self.a_bytes, self.b_bytes), (self.a_sizes, self.b_sizes)):
                flat = list(chain.from_iterable(own))
                ids.append(np.array(flat, np.int32))
                ends.append(np.cumsum(np.fromiter(map(len, own), np.int64, len(own))))
                reached = np.append(0, np.cumsum(size[ids[-1]]))[ends[-1]]
                if not np.array_equal(reached, sizes) or b"".join([written[i] for i in flat]) != b"".join(whole):
                    same &= np.fromiter((b"".join([written[i] for i in x]) == w for x, w in zip(own, whole)), bool, len(own))
            self.known.update(zip(some, range(len(self.known), len(self.known) + len(some))))
            self.a_at, self.b_at = np.append(self.a_at, len(self.a_ids) + ends[0]), np.append(self.b_at, len(self.b_ids) + ends[1])
            self.a_ids, self.b_ids, self.same = np.append(self.a_ids, ids[0]), np.append(self.b_ids, ids[1]), np.append(self.same, same)
            self.chars += sum(map(len, some))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A's ids, B's ids, A's per text, B's per text), none for empty texts and texts that the tokens do not spell.

        A text's parts between cuts are encoded once and remembered, as neither tokenizer joins them; a text with a part
        that is not spelled is tried as a whole.
        """
        parts = [CUT.split(t) if self.apart else [t] for t in texts]
        new = [p for p in set().union(*parts) if p not in self.known]
        if len(self.known) + len(new) > CACHED or self.chars > CACHED_CHARS:
            self._forget()
            new = list(set().union(*parts))
        self._learn(new)
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        rows = np.fromiter((self.known[p] for own in parts for p in own), np.int64, int(n.sum()))
        of = np.repeat(np.arange(len(parts)), n)
        odd = np.unique(of[~self.same[rows]]).tolist()
        if odd:
            again = [texts[d] for d in odd]
            self._learn([t for t in dict.fromkeys(again) if t not in self.known])
            keep = ~np.isin(of, odd)
            rows, of = np.append(rows[keep], [self.known[t] for t in again]), np.append(of[keep], odd)
            order = np.argsort(of, kind="stable")
            rows, of = rows[order], of[order]
        spelled = self.same[rows] & np.fromiter(map(bool, texts), bool, len(texts))[of]
        rows, of = rows[spelled], of[spelled]
        out = []
        for ids, at in ((self.a_ids, self.a_at), (self.b_ids, self.b_at)):
            size = at[rows + 1] - at[rows]
            places = np.arange(int(size.sum())) + np.repeat(at[rows] - (np.cumsum(size) - size), size)
            out += [ids[places].astype(np.int64), np.bincount(of, size, len(texts)).astype(np.int64)]
        return out[0], out[2], out[1], out[3]


def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Tokenizers(a_path, b_path)
    return _loaded[a_path, b_path]


def group_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group (from 0, by place) of each A and B token; ends grow and the last ones are equal.

    Tokens are vertices, A's before B's. Each points to the token of the other kind that covers its last byte, the
    farthest-right one that overlaps it, if that ends later; where both end together B's token is the terminal.
    """
    n = len(a_ends)
    to_b, to_a = np.searchsorted(b_ends, a_ends), np.searchsorted(a_ends, b_ends)
    after = a_ends[to_a] > b_ends
    successor = np.concatenate([n + to_b, np.where(after, to_a, n + np.arange(len(b_ends)))])
    while not np.array_equal(far := successor[successor], successor):
        successor = far
    terminal = np.zeros(len(successor), np.int64)
    terminal[n:][~after] = 1
    group = (np.cumsum(terminal) - 1)[successor]
    return group[:n], group[n:]


def aligned(pair: Tokenizers, texts: list[str]) -> list[tuple[int, int, int, str, np.ndarray]]:
    """Per text: tokens of A and B, groups, digest of the groups, and the linked id pairs (A's id << 32 | B's)."""
    a, b, n_a, n_b = pair.encode(texts)
    out = [(0, 0, 0, "", np.empty(0, np.int64))] * len(texts)
    if not len(a):
        return out
    a_ends, b_ends = np.cumsum(pair.a_sizes[a]), np.cumsum(pair.b_sizes[b])  # texts in a row: each starts where both ended
    a_group, b_group = group_ends(a_ends, b_ends)
    at = np.searchsorted(b_ends, a_ends)
    ends_with = b_ends[at] == a_ends
    links, link_at = a[ends_with] << 32 | b[at[ends_with]], np.append(0, np.cumsum(ends_with))
    group = np.concatenate([a_group, b_group])
    order = np.argsort(2 * group + np.repeat([0, 1], [len(a), len(b)]), kind="stable")
    group, from_b = group[order], order >= len(a)
    both = np.concatenate([a, b])[order]
    written = pair.written[b","][both]
    new_group, new_side = np.append(True, group[1:] != group[:-1]), np.append(False, from_b[1:] & ~from_b[:-1])
    written[new_group] = pair.written[b";"][both[new_group]]
    written[new_side] = pair.written[b"|"][both[new_side]]
    a_at, b_at = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
    for d in np.flatnonzero(n_a).tolist():
        text = written[a_at[d] + b_at[d]:a_at[d + 1] + b_at[d + 1]].tobytes().translate(None, b"\0")
        own = links[link_at[a_at[d]]:link_at[a_at[d + 1]]]
        groups = int(b_group[b_at[d + 1] - 1] - b_group[b_at[d]] + 1)
        out[d] = (int(n_a[d]), int(n_b[d]), groups, hashlib.sha256(text[1:]).hexdigest(), own)
    return out


BLOCKS = ("block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, digests array<string>, "
          "n_links array<long>, links binary, pairs array<long>, counts array<long>")


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per block of documents, with its distinct linked pairs; ``links`` holds int32 places among them."""
    names = [f.split()[0] for f in BLOCKS.split(", ")]

    def packed(block: int, held: list[tuple]) -> pa.RecordBatch:
        doc, n_a, n_b, groups, digests, links = zip(*held)
        pairs, at, counts = np.unique(np.concatenate(links), return_inverse=True, return_counts=True)
        listed = lambda v, kind=pa.int64(): pa.array([v], pa.list_(kind))
        return pa.RecordBatch.from_arrays(
            [pa.array([block]), listed(doc), listed(n_a), listed(n_b), listed(groups), listed(digests, pa.string()), listed([len(v) for v in links]),
             pa.array([at.astype("<i4").tobytes()], pa.binary()), listed(pairs), listed(counts)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        pair = tokenizers(a_path, b_path)
        for batch in batches:
            doc_ids, texts = (c.to_pylist() for c in batch.columns)
            texts = [t or "" for t in texts]
            start = 0
            while start < len(texts):
                end, chars = start + 1, len(texts[start])
                while end < len(texts) and chars + len(texts[end]) <= BATCH_CHARS:
                    chars += len(texts[end])
                    end += 1
                for doc, found in zip(doc_ids[start:end], aligned(pair, texts[start:end])):
                    held.append((doc, *found))
                    size += len(found[-1]) + 1
                    if size >= BLOCK_LINKS:
                        yield packed(block, held)
                        block, held, size = block + 1, [], 0
                start = end
        if held:
            yield packed(block, held)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, BLOCKS)


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per row of ``docs``.

    A pair of ids is counted over the whole corpus: each block of documents asks once for each of its distinct pairs,
    and gets back their counts and whether one is the highest of its B id (ties are all highest). Null and empty texts,
    and texts whose tokens are not their bytes, have no tokens: zeros and an empty digest. Repeated rows count as often
    as they occur. Texts are aligned whole. Only doc_id and text are read; other columns are left out.
    """
    blocks = staged(aligned_blocks(docs, a_path, b_path), "aligned")
    asked = blocks.select("block", F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("block", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    counted = staged(asked.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))), "pair-counts")
    best = counted.groupBy("b").agg(F.max("count").alias("most"))
    known = counted.join(best, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = (asked.select("block", "pair").join(known, "pair").groupBy("block")
               .agg(F.sort_array(F.collect_list(F.struct("pair", "count", "best"))).alias("found"))
               .select("block", F.col("found.count").alias("count"), F.col("found.best").alias("best")))
    both = blocks.drop("pairs", "counts").join(answers, "block", "left")

    def step(batch: pa.RecordBatch):
        for row in range(batch.num_rows):
            own = batch.slice(row, 1)
            lists = {c: own.column(c).flatten() for c in ("doc_ids", "n_a", "n_b", "n_groups", "digests", "n_links", "count", "best")}
            n = lists["n_links"].to_numpy()
            at = np.frombuffer(own.column("links")[0].as_buffer(), "<i4")
            ends = np.append(0, np.cumsum(n))
            totals = []
            for values in (lists["best"], lists["count"]):
                values = values.to_numpy(zero_copy_only=False).astype(np.int64) if len(at) else np.empty(0, np.int64)
                running = np.append(0, np.cumsum(values[at]))
                totals.append(pa.array(running[ends[1:]] - running[ends[:-1]]))
            yield pa.RecordBatch.from_arrays([lists["doc_ids"], lists["n_a"], lists["n_b"], lists["n_groups"], lists["n_links"], *totals, lists["digests"]],
                                             ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
    return arrow_map(both, step, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
